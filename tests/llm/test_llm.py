"""The training-data operators against brute force, exact round trips and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tracewright.llm import embeddings, encoding, mixing, pii, quality, repeats, simhash, token_counts, token_shards, warc
from tracewright.llm.bpe import Codec, encode_all
from tracewright.llm.common import DOC_COLUMNS
from tracewright.llm.components import components
from tracewright.llm.perfect_hash import PerfectHash, probe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, LOWER = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIRT = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'S", "'ll", "1", "23", "!", "?!", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", " ", "İ", "Σ", "日本", "é", "😀", "٣", "the", "Hello", "\0", "aaaaaaa", "<|", "\r\n", "ǅ"]


def texts(n, seed=1, parts=DIRT, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def documents(spark, rows, lang="en", source="s"):
    made = [(i, t, lang, source, len(t or "")) for i, t in rows]
    return spark.createDataFrame(made, DOCS).withColumn("extra", F.lit(1)).withColumn("component_id", F.lit("clash")).withColumn("m_id", F.lit(0))


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.mark.parametrize("path", [BYTE, LOWER], ids=["bytes", "words"])
def test_codec_equals_library(path):
    library, codec = Tokenizer.from_file(path), Codec(path)
    some = [*texts(1500), "", None, "a" * 3000, "ab" * 2000 + " x", "the" * 500, "é" * 400]
    for t, got in zip(some, encode_all(codec, some)):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(t)[:80]
        if path == BYTE:
            assert codec.decode(got).decode() == library.decode(ids, skip_special_tokens=False)
    assert 0 < codec.n_failed < codec.n_words


def test_bpe_digests_and_round_trip(spark):
    rows = [(1, "Hello there"), (2, None), (2, ""), (2, ""), (None, "x\n\ny")]
    got = encoding.round_trip_digests(documents(spark, rows), BYTE).collect()
    assert len(got) == 5
    ids = Tokenizer.from_file(BYTE).encode("Hello there", add_special_tokens=False).ids
    first = next(r for r in got if r.doc_id == 1)
    assert (first.n_tokens, first.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert first.decoded_sha256 == hashlib.sha256(b"Hello there").hexdigest()
    back = encoding.decode(encoding.encode(documents(spark, rows), BYTE), BYTE)
    assert {(r.text or "") == r.decoded for r in back.collect()} == {True}
    assert encoding.round_trip_digests(documents(spark, []), BYTE).count() == 0


def test_token_counts(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "a b c", "a b c", "word " * 6000])]
    sums = token_counts.token_length_histogram(documents(spark, rows), BYTE)
    sizes = [len(Tokenizer.from_file(BYTE).encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    for r in sums.collect():
        assert r.n_docs == sizes.count(r.n_tokens) and r.docs_from == sum(s >= r.n_tokens for s in sizes)
        assert r.tokens_from == sum(s for s in sizes if s >= r.n_tokens) and r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
    assert token_counts.truncated_total(sums, 2).first()[0] == sum(min(s, 2) for s in sizes)
    assert token_counts.length_quantile(sums, 0.5).first()[0] == sorted(sizes)[2]
    assert token_counts.token_length_histogram(documents(spark, []), BYTE).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 60, 5000, replace=False).astype(np.uint64)
    made = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made.find(keys).tolist()) == list(range(5000))
    raw = PerfectHash.build(keys).to_bytes()
    assert [probe(raw, int(k)) for k in keys[:700]] == made.find(keys[:700]).tolist()
    assert sum(probe(raw, (1 << 61) + i) >= 0 for i in range(300)) <= 1
    other = np.arange(100, dtype=np.uint64) + np.uint64(1 << 61)
    assert (made.find(other) >= 0).sum() <= 1
    assert PerfectHash.build(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


def test_token_shards(spark, tmp_path):
    rows = [(5, "a b"), (5, "a b"), (None, "x"), (None, None), (3, ""), (2, "hello " * 3000), (9, "z")]
    token_shards.write_shards(documents(spark, rows), LOWER, 2, str(tmp_path / "s"), parts=3, shard_ids=500)
    got = token_shards.scan_documents(spark, str(tmp_path / "s")).orderBy("start").collect()
    library, at = Tokenizer.from_file(LOWER), 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = token_shards.lookup(spark, str(tmp_path / "s"), [3, 5, 77]).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in found) == [(3, 1), (5, 3), (5, 3)]
    assert sorted(len(r.ids) for r in token_shards.lookup(spark, str(tmp_path / "s"), [None]).collect()) == [1, 2]
    assert token_shards.lookup(spark, str(tmp_path / "s"), [4, 8]).count() == 0 == token_shards.lookup(spark, str(tmp_path / "s"), []).count()
    plan = token_shards.lookup(spark, str(tmp_path / "s"), [3, 5])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(high,3)" in plan and "LessThanOrEqual(low,5)" in plan


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, prose):
    rows = [(r.doc_id, r.text) for r in prose.select("doc_id", "text").collect()][:120] + [(1000 + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "A b", "a  B", "x y z"])]
    base = [(2000 + i, "w0 w1 w2 w3 " * 3 + f"q{i}") for i in range(20)]
    rows += base
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = {rows[i][0]: (f"{fps[i]:016x}", min(groups[find(i)])) for i in range(len(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == want
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == DOC_COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_balls_reach_two_bits(spark):
    rng = random.Random(4)
    start = [rng.getrandbits(64) for _ in range(20)]
    made = start + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in start] + [start[0] ^ (1 << 63), start[0] ^ 7]
    signed = [x - (1 << 64) if x >> 63 else x for x in made]
    links = simhash.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long"))
    nodes = {r.node: r.root for r in components(links.select("u", "v")).collect()}
    for i, x in enumerate(made):
        for y in made[:i]:
            if (x ^ y).bit_count() <= 2:
                a, b = (z - (1 << 64) if z >> 63 else z for z in (x, y))
                assert nodes.get(a, a) == nodes.get(b, b)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}


def brute_counts(s):
    w, text = WORD.findall(s or ""), s or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    p, q = (np.array(x, float) / sum(x) for x in (p, q))
    half = lambda a: sum(x * np.log2(x / m) for x, m in zip(a, (p + q) / 2) if x > 0) / 2
    return np.sqrt(max(0, half(p) + half(q)))


def test_quality_equals_brute_force(spark, prose):
    odd = [None, "", "\n\n", "a\na\n a\n\x0b", "x " * 50, " ".join(f"w{i % 9}" for i in range(40)), "a b c d e f g h a b c d e f g h", "#*$%&|<>" * 5, "é ü " * 30]
    rows = [(r.doc_id, r.text) for r in prose.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, want = got[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.kept_documents(documents(spark, rows)).columns == DOC_COLUMNS
    assert quality.judge(documents(spark, [])).count() == 0


def test_js_distance(spark):
    for p, q in [([1, 0, 3], [2, 2, 2]), ([1, 0], [0, 1]), ([5, 5], [1, 1])]:
        got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("x")).first().x
        assert abs(got - js(p, q)) < 1e-9


def test_quality_keeps_labelled_good_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.judge(d).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] >= 0.99 and kept[0] < 0.6


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PERSONAL = ["a@b.c", "@", "b.c", "_x", "d@e.f.g", "1.2.3.4", "255", "256", ".", "1", "+1 (555) 123-4567", "+", "(", "4539 1488 0343 6467", "4539148803436467", " ", "-", "é", "😀", "9", "00", "%", "\n", "call (212) 555-1234 ", "joe [at] x [dot] com", "visa 4111/1111/1111/1111 "]


def counts_as(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    return kind == "email" or (16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0)


def test_pii_equals_plain_patterns(spark):
    some = [*texts(600, 5, PERSONAL, 12), None, "", "a." * 20_000 + "@", "1" * 30_000, "x@y" + ".z" * 20_000, "+1" + "(" * 20_000, "1 " * 20_000]
    got = {r.doc_id: r for r in pii.find(documents(spark, list(enumerate(some)))).collect()}
    for i, t in enumerate(some):
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t or "") if counts_as(k, m[0])]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), repr(t)[:80]
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_secret == len(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    assert pii.find(documents(spark, [])).count() == 0


def test_pii_model_on_held_out_rows():
    rng = random.Random(99)
    made = [pii._generated(rng) for _ in range(2000)]
    x = np.array([pii._row_features(k, s, b, left, right) for k, s, _, b, left, right in made])
    y = np.array([g for _, _, g, *_ in made])
    chosen = pii.model().score(x) >= pii.model().threshold
    assert y[chosen].mean() >= 0.95 and chosen[y == 1].mean() >= 0.75


#: Written by hand, not by the generator: (text, what is to be found in it, or nothing).
OTHER_SOURCE = [
    ("please write to anna.schmidt [at] example [dot] org soon", "email"), ("mail me: j.doe(at)posteo.de", "email"), ("contact bob at gmail dot com for more", "email"),
    ("we met at noon.Then we left", ""), ("he was at home.sweet home", ""), ("sold (at) auction", ""), ("look at this.value now", ""),
    ("our server 10 . 0 . 13 . 200 is down", "ip"), ("host 192[.]168[.]7[.]12", "ip"), ("items 3 . 400 . 999 . 12", ""), ("section 300. 400. 500. 600 of it", ""),
    ("card: 4111.1111.1111.1111 exp", "card"), ("visa 5500/0055/5555/5559 ok", "card"), ("payment 3782_822463_10005", "card"), ("part 1234.5678.9012.3456 x", ""), ("serial 9999_8888_7777_6666", ""),
    ("call (212) 555-0187 now", "phone"), ("tel: 0049 171 555 0199", "phone"), ("fax 030/4567 8901", "phone"), ("lot 123.456.7890x", ""),
    ('token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"', "secret"), ("api key: AKfycbx7Q9mZt2R4uVwXyZ01ab3d", "secret"), ("export SECRET=f3ef4d6b2755a36d7d9c25bd72c4d5f6", "secret"),
    ("internationalization and characteristically", ""), ("see docs/guides/install/linux now", ""), ("____________________", ""), ("a state-of-the-art-machine-learning way", ""), ("number 12345678901234567890", ""),
]


def test_pii_method_on_another_source(spark):
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, [(i, t) for i, (t, _) in enumerate(OTHER_SOURCE)])).collect()}
    right = sum((want in got[i]) if want else not got[i] for i, (_, want) in enumerate(OTHER_SOURCE))
    missed = [(t, got[i]) for i, (t, want) in enumerate(OTHER_SOURCE) if not ((want in got[i]) if want else not got[i])]
    assert right >= 0.9 * len(OTHER_SOURCE), missed


def test_redaction(spark):
    rows = [(1, "mail a@b.cd or +1 (555) 123-4567 now"), (2, None), (3, "😀 1.2.3.4 end"), (4, "plain")]
    got = {r.doc_id: r for r in pii.redacted_documents(documents(spark, rows)).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE] now" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "😀 [IP] end" and got[4].text == "plain"


def brute_targets(sizes):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    free, target, left = set(names), {}, sum(sizes.values())
    while over := [n for n in free if left * weight[n] > 3 * sizes[n] * sum(weight[m] for m in free)]:
        for n in over:
            target[n] = 3 * sizes[n]
            free.discard(n)
        left = sum(sizes.values()) - sum(target.values())
    return target | {n: left * weight[n] / sum(weight[m] for m in free) for n in free}


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 900])), "en", rng.choice(["b", "a", "a", "a", "é", "z", None]), 1) for i in range(300)] + [(7, None, "en", "a", 0), (900, "x y", "en", "tiny", 3), (5, "q " * 400, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(dict(sizes)), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), s
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mixed_documents(df).columns == DOC_COLUMNS
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def highest_quotients(weights, seats):
    """Plain Sainte-Laguë: a seat at a time to the highest quotient, ties to the first."""
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_apportionment_equals_highest_quotients(spark):
    rng = random.Random(8)
    groups = [[rng.choice([0, 1, 1, 2, 7, 100, 5000]) + 0.0 for _ in range(rng.randint(1, 30))] for _ in range(25)]
    groups = [g for g in groups if sum(g)]
    seats = [rng.randint(0, 200) for _ in groups]
    rows = [(g, k, w, n) for g, (ws, n) in enumerate(zip(groups, seats)) for k, w in enumerate(ws)]
    got = collections.defaultdict(dict)
    for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, w double, n long"), "w", F.col("n"), ["g"], ["k"]).collect():
        got[r.g][r.k] = r.quota
    for g, (ws, n) in enumerate(zip(groups, seats)):
        assert [got[g][k] for k in range(len(ws))] == highest_quotients(ws, n)


def test_shards_take_their_quota_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_SHARD", 40)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 3, 50, 700]), "en", rng.choice("aaaab"), 1) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).withColumn("m_id", F.lit(1)).withColumn("shard", F.lit("clash"))
    got = mixing.mix(df).collect()
    by, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        by[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.005 * t and abs(by[s] - t) <= 0.05 * t
    whole = sum(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert whole < len(got)


def brute_repeats(all_texts):
    raw = [(t or "").encode() for t in all_texts]
    seen = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                mark[i : i + 400] = b"\1" * 400
        yield len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    w = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    p, q = w(900), w(420)
    some = [w(300) + p + w(500), w(10) + p + w(20), p[100:600] + w(900), p[100:600] + w(10) + q, q + q, w(399), p[:400], "a" * 3000, "ab " * 900 + p[5:420], "Der " * 500, "Der " * 700 + q[3:], None, "", w(5000), w(5000)]
    some += [w(200) + p[:450] + w(300) for _ in range(25)]
    rows = [*enumerate(some), (3, some[3]), (None, w(600))]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, rows)).collect())
    want = collections.Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows])))
    assert got == want
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("class", T.StringType())])


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 64))
    x = [c / np.linalg.norm(c) + rng.normal(size=64) * s / 8 for c in centre for s in rng.uniform(0.0, 0.35, 40)]
    rows = [(i, v.tolist(), int(i % 40 >= 35), "c") for i, v in enumerate(x)]
    rows += [(1000, rows[3][1], 0, "c"), (1001, rows[3][1], 0, "c"), (1002, rows[3][1], None, "c"), (1003, [0.0] * 64, 0, "c"), (1004, None, 0, "c"), (1005, [float("nan")] * 64, 0, "c"), (1006, rows[3][1][:32], 0, "c"), (1007, [None] * 64, 0, "c"), (1008, [], 0, "c")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    ok = [(i, np.array(np.float32(v), float), label) for i, v, label, _ in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, *_ in rows}, collections.Counter()
    find = lambda i: i if root[i] == i else find(root[i])
    for a, (i, u, k) in enumerate(ok):
        for j, v, m in ok[:a]:
            if k == m and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[i] += 1
                links[j] += 1
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    assert sum(n for n, *_ in got.values()) >= 0.999 * sum(links.values()) > 2000
    wrong = [i for i, *_ in rows if got[i] != (links[i], find(i), find(i) == i)]
    assert len(wrong) <= 0.01 * len(rows) and all(got[i][0] <= links[i] for i in wrong)
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "é" * (i * 37 % 900)) for i in range(300)] + [(None, None, None), (5, "a b\n", "x"), (7, "http://h/7", "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"), parts=3, segment_bytes=20_000)
    one = warc.replica(spark, str(tmp_path / "a"))
    records = warc.inventory(one).collect()
    assert len(records) == len(rows) and all(r.intact for r in records)
    fields, body = warc.parse(warc.record(5, "a b\n", "x"))
    assert (fields["WARC-Target-URI"], body) == ("a%20b%0A", b"x")
    assert warc.audit(warc.trees(one), warc.trees(one)).count() == 0
    two = warc.damage(one, 50)
    found = warc.audit(warc.trees(one), warc.trees(two)).collect()
    assert sorted(r.page_id for r in found) == [0, 50, 100, 150, 200, 250] and {r.state for r in found} == {"changed"}
    lost = one.filter("NOT (part = 1 AND seq = 0)")
    gone = warc.audit(warc.trees(one), warc.trees(lost)).collect()
    assert {r.state for r in gone} == {"missing"} and len(gone) == len(one.filter("part = 1 AND seq = 0").first().page_ids)
    roots = lambda r: warc.part_roots(warc.trees(r))
    assert warc.set_root(roots(one)) != warc.set_root(roots(two)) and warc.set_root(roots(one)) == warc.set_root(roots(one))
    # Only the part and the segment with the one changed record differ.
    hurt = warc.damage(one, 263)
    a, b = ({r.part: r.root for r in roots(x).collect()} for x in (one, hurt.filter("true")))
    assert sorted(r.page_id for r in warc.audit(warc.trees(one), warc.trees(hurt)).collect()) == [0, 263] and sum(a[k] != b[k] for k in a) == 2
    nothing = spark.createDataFrame([], df.schema)
    warc.write(nothing, str(tmp_path / "none"))
    empty = warc.replica(spark, str(tmp_path / "none"))
    assert warc.audit(warc.trees(empty), warc.trees(empty)).count() == 0 and warc.inventory(empty).count() == 0
    assert {r.state for r in warc.audit(warc.trees(empty), warc.trees(one)).collect()} == {"added"}
    leaves = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(400)]
    other = [*leaves[:37], b"x" * 32, *leaves[38:]]
    assert warc.differing(warc.tree(leaves), warc.tree(other)) == [37] and warc.tree([])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == DOC_COLUMNS
        seen[name] = docs.toPandas()
        docs = spark.createDataFrame(seen[name]) if "ids" not in seen[name] else docs
    judged = {r.doc_id for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).filter("kept").collect()}
    assert set(seen["quality rules"].doc_id) == judged
    fps = {i: brute_fingerprint(t) for i, t in zip(seen["quality rules"].doc_id, seen["quality rules"].text)}
    kept = seen["SimHash near-dedup"].doc_id.tolist()
    assert all((fps[a] ^ fps[b]).bit_count() > 2 for i, a in enumerate(kept) for b in kept[:i])
    assert not any(re.search(PLAIN["email"], t) for t in seen["PII"].text)
    last = seen["BPE encoding"]
    library = Tokenizer.from_file(BYTE)
    mixed = collections.Counter(zip(seen["mixing sources"].doc_id, (tuple(library.encode(t, add_special_tokens=False).ids) for t in seen["mixing sources"].text)))
    assert mixed == collections.Counter(zip(last.doc_id, (tuple(np.frombuffer(bytes(x), "<u4").tolist()) for x in last.ids)))
