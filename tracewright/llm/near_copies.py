"""The pipeline's near-duplicate stage: ball hashing of SimHashes of 5-word shingles, pairs verified by exact Jaccard.

Operator 4's query is bound to 3-word shingles and 2 bits, within which hardly any
near copy falls. Here every text has a SimHash of 512 bits over its distinct
shingles, cut into words, and the words meet in the middle as the fingerprints of
operator 4 do: two words differ in at most 2 bits exactly when some third word
differs from each in at most 1, and texts of which a word does so are candidates. At
a Jaccard similarity of 0.8 a bit differs with chance acos(8/9)/pi = 0.15, so the
number of words is set from their width for the wanted recall, and the width grows
with the logarithm of the number of texts, so that chance meetings stay in
proportion to it. The ball around a word is spelled out only in the task that holds
it: words are dealt by their upper bits, and go on to one sector for each such bit.
Candidates far apart in all bits are dropped, the others are compared by their whole
shingle sets.

Texts with the same words are one node from the start. A bucket is the nodes that
meet in one ball. Each node is first compared with the least node of the balls
around its own words. What then stands in several components is
compared in three steps, each across the components that the one before has left:

1. nodes that share a shingle which at most RARE nodes have, among the rarest that
   a text near them has to share one of (prefix filtering): at most RARE nodes meet
   on a shingle, however large their bucket is;
2. in each bucket, every node with LEADERS others, by which most nodes that belong
   to a large component join it;
3. in each bucket, every pair that could still be linked: it shares no rare shingle,
   so texts of m and n shingles, s and t of them rare, share c = min(m - s, n - t)
   at most, which makes their similarity c / (m + n - c) at most.

So no pair that could be linked goes unseen, and members of a large group that are
near its texts without being linked to them meet few of them, unless all but a few
of their shingles are common ones: only these are compared with one another.

Null text is read as empty; texts without words are one node. A text of fewer than
five words has one shingle, the whole sequence, and is near its exact copies only.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, Stage, shuffle_width, whole_text
from .components import components

WORDS = 5
#: Least Jaccard similarity of near copies, in percent.
LEAST_PERCENT = 80
SKETCH_BITS = 512
#: Candidates further apart are not compared: at 0.8 about 78 bits differ (96 in texts of 5 shingles), by chance 256.
MOST_BITS = 160
#: Words within twice as many bits meet in a ball of this radius.
BALL = 1
#: Bits of a word beyond the logarithm of the number of texts, and the least width.
SPARE_BITS, LEAST_BITS = 8, 16
#: Words in which a pair at exactly the least similarity meets, on average.
MEETINGS = 5
#: A sector holds about 2 to this power words, and the least number of upper bits that tell sectors apart.
SECTOR_BITS, LEAST_TOP = 14, 2
#: Nodes that have a rare shingle, at most; nodes of a bucket that all others are compared with before every pair is.
RARE, LEADERS = 64, 8

_hash = partial(xxhash.xxh64_intdigest, seed=42)
#: Odd constants that make eight words of one hash.
_ODD = np.random.default_rng(42).integers(1, 1 << 63, SKETCH_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = [b" ".join(words)] if len(words) < WORDS else map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    return np.unique(np.fromiter(map(_hash, parts), np.uint64))


def sketch(h: np.ndarray) -> bytes:
    """SimHash of SKETCH_BITS bits of shingle hashes."""
    ones = np.zeros(SKETCH_BITS, np.int64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * _ODD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        # Sums of at most 255 rows fit a byte.
        ones += sum(bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255))
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def plan_words(n: int) -> np.ndarray:
    """Bit positions of the words of sketches for ``n`` texts, a row per word."""
    width = max(LEAST_BITS, n.bit_length() + SPARE_BITS)
    share = LEAST_PERCENT / 100
    differ = math.acos(2 * share / (1 + share)) / math.pi
    meets = sum(math.comb(width, i) * differ**i * (1 - differ) ** (width - i) for i in range(2 * BALL + 1))
    rng, each, count = np.random.default_rng(7), SKETCH_BITS // width, math.ceil(MEETINGS / meets)
    dealt = [rng.permutation(SKETCH_BITS)[: each * width].reshape(each, width) for _ in range(-(-count // each))]
    return np.concatenate(dealt)[:count]


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, sketch): a row for every row; the sketch is null below five words, where none is needed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = [_words(t) for t in part.column(2).to_pylist()]
                nodes = np.array([_hash(b" ".join(w)) for w in words], np.uint64).view(np.int64)
                made = [sketch(shingles(w)) if len(w) >= WORDS else None for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array(made, pa.binary())], names=["doc_id", "text_key", "node", "sketch"])

    read = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    return read.mapInArrow(run, "doc_id long, text_key long, node long, sketch binary")


def _dealt(nodes: DataFrame, words: np.ndarray, top: int) -> DataFrame:
    """(at, node): every word of each node's sketch, dealt to the sectors that hold the ball around it. A sector is a
    word's number and ``top`` upper bits: one holds the word and those that differ in a lower bit, ``top`` hold one each."""
    count, width = words.shape
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    flips = np.concatenate([np.zeros(1, np.int64), np.int64(1) << np.arange(top, dtype=np.int64)])
    numbers = np.arange(count, dtype=np.int64) << top

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                values = np.zeros((len(bits), count), np.int64)
                for column, weight in zip(words.T, weights):
                    values += bits[:, column] * weight
                sectors = numbers[:, None] | ((values >> (width - top))[:, :, None] ^ flips)
                to = (sectors << 40) | values[:, :, None]
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), to[0].size))], names=["at", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "at long, node long")


def _met(values: np.ndarray, nodes: np.ndarray, sector: int, width: int, top: int) -> pa.RecordBatch:
    """(band, nodes, own) of one sector: the nodes within BALL bits of each word, if they are two or more, and those it is
    the word of (both, if it is the word of one of two). Two words alone meet on two words, of which the lesser is taken; equal ones are taken on themselves."""
    low = width - top
    above = np.int64(sector & ((1 << top) - 1)) << low
    mask = np.int64((1 << low) - 1)
    own = np.flatnonzero(values & ~mask == above)
    flips = np.int64(1) << np.arange(low, dtype=np.int64)
    center = np.concatenate([above | (values & mask), (values[own, None] ^ flips).ravel()])
    who = np.concatenate([np.arange(len(values)), np.repeat(own, low)])
    order = np.lexsort((values[who], center))
    center, who = center[order], who[order]
    start = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
    sizes = np.diff(np.r_[start, len(center)])
    several = sizes > 1
    start, sizes = start[several], sizes[several]
    value = values[who]
    change = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    first, last = value[start], value[start + sizes - 1]
    kinds = change[start + sizes - 1] - change[start] + 1
    at = center[start]
    taken = np.where(kinds == 1, at == first, (kinds > 2) | (at < at ^ first ^ last))
    at, start, sizes, pair = at[taken], start[taken], sizes[taken], (kinds == 2)[taken]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    members = np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])
    hit = value[members] == center[members]
    hub = np.logical_or.reduceat(hit, offsets[:-1]) if len(hit) else hit
    hit |= np.repeat(pair & hub, sizes)
    hits = np.concatenate([[0], np.cumsum(hit)])[offsets]
    who = nodes[who[members]]
    lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(w)) for o, w in ((offsets, who), (hits, who[hit]))]
    return pa.RecordBatch.from_arrays([pa.array((np.int64(sector >> top) << 40) | at), *lists], names=["band", "nodes", "own"])


def _buckets(nodes: DataFrame, n: int) -> DataFrame:
    """(band, nodes, own) of the balls that several of ``n`` nodes meet in; own: those around whose word it is."""
    words = plan_words(n)
    width, top = words.shape[1], max(LEAST_TOP, n.bit_length() - SECTOR_BITS)

    def run(batches):
        held, sector = [], None
        for batch in batches:
            at, node = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.diff(at >> 40)) + 1
            for part, who in zip(np.split(at, cuts), np.split(node, cuts)):
                if not len(part):
                    continue
                if held and sector != part[0] >> 40:
                    yield _met(*map(np.concatenate, zip(*held)), int(sector), width, top)
                    held = []
                sector = part[0] >> 40
                held.append((part & np.int64((1 << 40) - 1), who))
        if held:
            yield _met(*map(np.concatenate, zip(*held)), int(sector), width, top)

    dealt = _dealt(nodes, words, top).repartition(shuffle_width(nodes.sparkSession), F.shiftright("at", 40)).sortWithinPartitions("at")
    return dealt.mapInArrow(run, "band long, nodes array<long>, own array<long>")


def _near(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (u, v) of nodes whose shingle sets have the least similarity, and (node, shingles) of the nodes compared."""

    def close(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            few = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= MOST_BITS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(few))

    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingles(_words(t)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    of = lambda name, *columns: nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    sketched = pairs.join(of("u", "sketch"), "u").join(of("v", "sketch"), "v").select("u", "v", "u_sketch", "v_sketch")
    left = Stage(sketched.mapInArrow(close, "u long, v long"), "close").read()
    wanted = left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct().join(nodes, "node")
    wanted = wanted.select("node", F.col("first.doc_id").alias("k_id"), F.col("first.text_key").alias("k_text"))
    known = docs.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_key"))
    met = known.join(wanted, known.doc_id.eqNullSafe(wanted.k_id) & (known.text_key == wanted.k_text)).select("node", "text").dropDuplicates(["node"])
    held = Stage(met.mapInArrow(sets, "node long, shingles array<long>"), "shingles").read()
    both = left.join(held.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * same >= LEAST_PERCENT * (F.size("a") + F.size("b") - same)).select("u", "v"), held


def _rarity(held: DataFrame) -> DataFrame:
    """(node, size, own, index) of each node of ``held``: its shingles, how many of them RARE nodes of it have at most,
    and of these the ones that others have too among its rarest shingles: any text that has the least similarity to it
    shares one of its rarest size - ceil(least * size) + 1, by the order of (number of nodes, shingle)."""
    each = held.select("node", F.explode("shingles").alias("shingle"))
    counted = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter(F.col("n") <= RARE)
    counted = Stage(counted, "rare").read()
    once = counted.filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("once"))
    some = each.join(counted.filter("n > 1").select("shingle", "n"), "shingle")
    some = some.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("some"))
    rarest = F.expr(f"size - ({LEAST_PERCENT} * size + 99) div 100 + 1 - once")
    known = held.select("node", F.size("shingles").cast("long").alias("size")).join(once, "node", "left").join(some, "node", "left").na.fill(0, ["once"])
    some = F.coalesce(F.col("some.shingle"), F.array().cast("array<long>"))
    return known.select("node", "size", (F.col("once") + F.size(some)).alias("own"), F.slice(some, 1, F.greatest(F.lit(0), rarest).cast("int")).alias("index"))


def _sharing(bounds: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes of different components that share a shingle of both indexes, at most RARE nodes a shingle."""
    one = bounds.join(roots, bounds.node == roots.u, "left").select(F.col("node").alias("u"), F.coalesce("root", "node").alias("root"), "size", F.explode("index").alias("shingle"))
    two = one.select("shingle", *(F.col(c).alias(f"v_{c}") for c in ("u", "root", "size")))
    able = 100 * F.least("size", "v_size") >= LEAST_PERCENT * F.greatest("size", "v_size")
    return one.join(two, "shingle").filter((F.col("root") != F.col("v_root")) & (F.col("u") > F.col("v_u")) & able).select("u", F.col("v_u").alias("v")).distinct()


def _mixed(buckets: DataFrame, roots: DataFrame, bounds: DataFrame) -> DataFrame:
    """(band, u, root, size, own) of the nodes of buckets that hold several components; size and own are null where not known."""
    spread = buckets.select("band", F.explode("nodes").alias("u")).join(roots, "u", "left").select("band", "u", F.coalesce("root", "u").alias("root"))
    spread = Stage(spread, "spread").read()
    several = spread.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    return spread.join(several, "band", "left_semi").join(bounds.select(F.col("node").alias("u"), "size", "own"), "u", "left")


def _to_leaders(mixed: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes with known bounds and up to LEADERS such nodes of their bucket that could be linked to them."""
    known = mixed.filter("size IS NOT NULL")
    least = [F.min(F.struct(F.xxhash64("u", "band", F.lit(i)).alias("h"), F.col("u").alias("v"), *(F.col(c).alias(f"v_{c}") for c in ("root", "size", "own")))) for i in range(LEADERS)]
    leaders = known.groupBy("band").agg(F.array(*least).alias("leaders")).select("band", F.explode(F.array_distinct("leaders")).alias("leader")).select("band", "leader.*")
    met = known.join(leaders, "band").filter((F.col("root") != F.col("v_root")) & _could_link())
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _across(mixed: DataFrame) -> DataFrame:
    """All pairs (u, v) of nodes of a bucket, of different components, that could be linked without sharing a shingle of their indexes."""
    other = mixed.select("band", F.col("u").alias("v"), *(F.col(c).alias(f"v_{c}") for c in ("root", "size", "own")))
    return mixed.join(other, "band").filter((F.col("root") != F.col("v_root")) & (F.col("u") > F.col("v")) & _could_link()).select("u", "v").distinct()


def _could_link() -> Column:
    """Whether nodes of (size, own) and (v_size, v_own) may have the least similarity; where either is not known, they may."""
    shared = F.least(F.col("size") - F.col("own"), F.col("v_size") - F.col("v_own"))
    known = F.col("size").isNotNull() & F.col("v_size").isNotNull()
    return ~known | ((100 + LEAST_PERCENT) * shared >= LEAST_PERCENT * (F.col("size") + F.col("v_size")))


def _rooted(docs: DataFrame) -> DataFrame:
    """(node, first, root) of every distinct sequence of words; first is its least (doc_id, text_key)."""
    made = Stage(_sketches(docs), "sketches").read()
    least = F.min(F.struct("doc_id", "text_key")).alias("first")
    nodes = Stage(made.groupBy("node").agg(least, F.min("sketch").alias("sketch")), "nodes").read()
    able = nodes.filter("sketch IS NOT NULL")
    buckets = Stage(_buckets(able, able.count()), "buckets").read()
    first = buckets.select(F.array_min("nodes").alias("v"), F.explode("own").alias("u")).filter(F.col("u") != F.col("v")).distinct()
    links, held = _near(first, able, docs)
    links, tried = Stage(links, "near").read(), first
    bounds = Stage(_rarity(held), "bounds").read()

    def rooted() -> DataFrame:
        return components(links).withColumnRenamed("node", "u")

    def more(pairs: DataFrame) -> None:
        nonlocal links, tried
        pairs = Stage(pairs.join(tried, ["u", "v"], "left_anti"), "pairs").read()
        links, tried = links.union(Stage(_near(pairs, able, docs)[0], "near").read()), tried.union(pairs)

    more(_sharing(bounds, rooted()))
    more(_to_leaders(_mixed(buckets, rooted(), bounds)))
    more(_across(Stage(_mixed(buckets, rooted(), bounds), "mixed").read()))
    roots = components(links)
    return nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of documents, one row of each group of near copies: the one with the
    least doc_id (a null doc_id first; of rows with one doc_id, one text)."""
    first = _rooted(docs).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_key").alias("k_text"))
    known = docs.select(DOC_COLUMNS).withColumn("k_row", F.xxhash64(whole_text()))
    met = known.join(first, known.doc_id.eqNullSafe(F.col("k_id")) & (F.col("k_row") == F.col("k_text")), "left_semi")
    return met.dropDuplicates(["doc_id", "k_row"]).select(DOC_COLUMNS)
