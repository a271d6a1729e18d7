"""Operator 8: removal of every byte under a 400-byte string that starts twice in the corpus, by suffix sorting.

Shards hold what can be equal. Every 400-byte window is owned by an anchor, the least
hash among its 32-byte substrings, so equal windows have equal anchors at equal
offsets, and an exchange by anchor brings them together. The windows of one anchor
occurrence form a fragment; inside a repeated passage the fragments repeat as wholes:

1. fragments are counted by a 128-bit digest. An anchor whose fragments are one
   single fragment is settled: it repeats, or it is unique and is dropped;
2. where one anchor has different fragments (the rims of repeated passages), offsets
   are taken in RANGES ranges; all windows of a range hold the same bytes around the
   anchor, so that two fragments can share a window of a range only if they share
   these bytes. Fragments that share none are dropped, others cut to their ranges;
3. of what is left one copy of each is fetched, and each shard sorts all suffixes of
   its fragments by external induced sorting (see ``suffix_sort``), whose queues
   carry suffixes and common-prefix values: neighbours in suffix order that share
   400 bytes or more are windows that occur twice;
4. the window starts found go back to all documents that hold the fragment.

Copies are collapsed before they are shuffled (per document, then by partial
aggregation). An anchor with more than FRAGMENTS_A_SHARD different fragments is dealt
by the window's offset to the anchor, as only windows of one offset can be equal, and
within an offset by a hash of the window: a fragment goes, window by window, to the
offsets it spans and no others. No group is capped. A document longer than PIECE
bytes is searched piece by piece with overlap; pieces only add rims.

Null text is empty. Texts shorter than a window keep all bytes. Rows with equal
doc_id and text are documents of their own and repeat each other. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, forget_at_exit, scratch_path, shuffle_width, whole_text
from .suffix_sort import sort_texts

WINDOW = 400
GRAM = 32
PIECE = 1 << 20
#: Different fragments of an anchor that one shard compares.
FRAGMENTS_A_SHARD = 2048
#: Bytes that a task sorts together, but for an anchor's own.
BYTES_AT_ONCE = 2 << 20
#: Offsets that a window can have to its anchor, and ranges of them.
OFFSETS, RANGES = WINDOW - GRAM + 1, 4
STEP = -(-OFFSETS // RANGES)

_POSITION = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, np.uint64, endpoint=False) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all substrings of GRAM bytes, a power of two, from those of their halves."""
    h, size = _TABLE[data], 1
    while size < GRAM:
        h = h[:-size] * _FACTOR + h[size:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def fragments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: per fragment the first window's start, the number of windows, the anchor's position and its hash."""
    n = len(data) - WINDOW + 1
    gram = gram_hashes(data)
    least = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    wide, size = WINDOW - GRAM + 1, 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[wide - size : wide - size + n])
    at = (least & _POSITION).astype(np.int64)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return start, np.diff(np.r_[start, n]), at[start], gram[at[start]].view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "anchor", "f1", "f2", "windows", "lead", "starts"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for batch in batches:
        for row in range(0, batch.num_rows, 512):
            part = batch.slice(row, 512)
            columns: list[list] = [[] for _ in names]
            for doc, key, text in zip(*(c.to_pylist() for c in part.columns)):
                raw = text.encode()
                found: dict[tuple, list] = {}
                for at in range(0, max(1, len(raw) - WINDOW + 1), PIECE):
                    piece = raw[at : at + PIECE + WINDOW - 1]
                    if len(piece) < WINDOW:
                        continue
                    view = memoryview(piece)
                    for s, n, p, anchor in zip(*(a.tolist() for a in fragments(np.frombuffer(piece, np.uint8)))):
                        digest = hashlib.blake2b(view[s : s + n + WINDOW - 1], digest_size=16).digest()
                        found.setdefault((anchor, digest, n, p - s), []).append(at + s)
                for (anchor, digest, n, lead), starts in found.items():
                    f1, f2 = np.frombuffer(digest, "<i8").tolist()
                    for column, v in zip(columns, (doc, key, anchor, f1, f2, n, lead, starts)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _compare(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From pieces of fragments (anchor, shard, part, f1, f2, base, piece), a group of the first three together:
        (anchor, f1, f2, at) with ``at`` the starts, in the fragment, of windows that another fragment holds too."""
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            order, shared, left = sort_texts([r[6] for r in held], WINDOW, folder)
            same = shared >= WINDOW
            found = np.sort(order[(same | np.r_[same[1:], False]) & (left[order] >= WINDOW)])
            ends = np.cumsum([len(r[6]) + 1 for r in held])
            who = np.searchsorted(ends, found, side="right")
            at = found - (ends - [len(r[6]) + 1 for r in held])[who] + np.array([r[5] for r in held], np.int64)[who]
            rows = np.flatnonzero(np.bincount(who, minlength=len(held)))
            cuts = np.searchsorted(who, np.r_[rows, len(held)])
            columns = [[held[i][k] for i in rows.tolist()] for k in (0, 3, 4)] + [[at[a:b] for a, b in zip(cuts, cuts[1:])]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.list_(pa.int32())])], names=["anchor", "f1", "f2", "at"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[:3] != held[-1][:3] and size >= BYTES_AT_ONCE:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield flush()

    return run


def removed_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, b) of bytes under windows with the given sorted distinct starts."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + WINDOW])
    return starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] + WINDOW


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    types = [pa.int64()] * 4 + [pa.string(), pa.string()]
    for batch in batches:
        for row in range(0, batch.num_rows, 512):
            columns: list[list] = [[] for _ in names]
            for doc, text, found in zip(*(c.to_pylist() for c in batch.slice(row, 512).columns)):
                raw = text.encode()
                spans = [np.add.outer(np.array(f["starts"]), np.arange(f["windows"]) if f["at"] is None else np.array(f["at"])).ravel() for f in found or []]
                a, b = removed_runs(np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64))
                cuts = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                for column, v in zip(columns, (doc, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace"))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, found): of documents that hold repeated windows, array<struct<starts, windows, at>>:
    fragments at ``starts`` of which the windows ``at``, or all if null, occur elsewhere too."""
    width = shuffle_width(docs.sparkSession)
    schema = "doc_id long, text_key long, anchor long, f1 long, f2 long, windows int, lead int, starts array<bigint>"
    cut = Stage(docs.select("doc_id", "text_key", "text").mapInArrow(_cut, schema), "fragments").read()
    digests = [m(c).alias(f"{m.__name__}_{c}") for c in ("f1", "f2") for m in (F.min, F.max)]
    met = cut.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n"), *digests).filter("n > 1")
    alike = (F.col("min_f1") == F.col("max_f1")) & (F.col("min_f2") == F.col("max_f2"))
    some = Stage(cut.join(met.select("anchor", alike.alias("alike")), "anchor"), "repeated-anchors").read()
    whole = some.filter("alike").select("doc_id", "text_key", "starts", "windows", F.lit(None).cast("array<int>").alias("at"))
    # Different fragments of an anchor, one occurrence of each.
    key = ["anchor", "f1", "f2"]
    rims = some.filter(~F.col("alike")).groupBy(*key).agg(
        F.sum(F.size("starts")).alias("n"), F.min(F.struct("doc_id", "text_key", F.col("starts")[0].alias("start"), "windows", "lead")).alias("one")
    )
    rims = Stage(rims.select(*key, "n", "one.*"), "rims").read()
    places = rims.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*key, "start", "windows", "lead")).alias("rims"))
    texts = docs.join(places.withColumnsRenamed({"doc_id": "p_id", "text_key": "p_key"}), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")))
    fetched = texts.select("text", "rims").mapInArrow(_fetch, "anchor long, f1 long, f2 long, windows int, lead int, cores array<bigint>, fragment binary")
    fetched = Stage(fetched.dropDuplicates(key), "rim-bytes").read()
    cores = fetched.select(*key, F.posexplode("cores").alias("range", "core")).filter("core IS NOT NULL")
    met = cores.groupBy("anchor", "range", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    able = cores.join(met, ["anchor", "range", "core"], "left_semi").groupBy(*key).agg((F.min("range") * STEP).alias("low"), (F.max("range") * STEP + STEP - 1).alias("high"))
    able = Stage(able, "able").read()
    dealt = _dealt(fetched.join(able, key), able).repartition(width, "anchor", "shard", "part").sortWithinPartitions("anchor", "shard", "part")
    folder = scratch_path(docs.sparkSession, "queues")
    forget_at_exit(docs.sparkSession, folder)
    compared = dealt.mapInArrow(_compare(folder), "anchor long, f1 long, f2 long, at array<int>").groupBy(*key).agg(F.flatten(F.collect_list("at")).alias("at"))
    verdict = Stage(rims.select(*key, "n").join(compared, key, "left").filter("n > 1 OR at IS NOT NULL"), "verdicts").read()
    part = some.filter(~F.col("alike")).join(verdict, key).select("doc_id", "text_key", "starts", "windows", F.when(F.col("n") > 1, None).otherwise(F.col("at")).alias("at"))
    found = whole.unionByName(part)
    return found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("starts", "windows", "at")).alias("found"))


def _dealt(fragments: DataFrame, able: DataFrame) -> DataFrame:
    """(anchor, shard, part, f1, f2, base, piece): the bytes of each fragment's windows with offsets from low to high, by
    shard; ``base`` is the first window's place in the fragment. Few fragments of an anchor are one shard; of many, each offset is one, in parts."""
    n = able.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shards = F.when(F.col("n") > FRAGMENTS_A_SHARD, OFFSETS).otherwise(1)
    f = fragments.join(n, "anchor").withColumn("shards", shards).withColumn("parts", F.when(F.col("n") > FRAGMENTS_A_SHARD, F.expr(f"(n + {FRAGMENTS_A_SHARD} - 1) div {FRAGMENTS_A_SHARD}")).otherwise(1))
    f = f.withColumn("shard", F.explode(F.expr(f"sequence(greatest(lead - windows + 1, low) * shards div {OFFSETS}, least(lead, high) * shards div {OFFSETS})")))
    first = F.expr(f"cast(greatest(0, lead - high, lead - ((shard + 1) * {OFFSETS} + shards - 1) div shards + 1) AS int)")
    last = F.expr(f"cast(least(windows - 1, lead - low, lead - (shard * {OFFSETS} + shards - 1) div shards) AS int)")
    piece = F.substring("fragment", first + 1, last - first + WINDOW)
    f = f.select("anchor", F.col("shard").cast("int").alias("shard"), "parts", "f1", "f2", first.alias("base"), piece.alias("piece"))
    return f.select("anchor", "shard", F.pmod(F.xxhash64("piece"), "parts").cast("int").alias("part"), "f1", "f2", "base", "piece")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "f1", "f2", "windows", "lead", "cores", "fragment"]
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.binary()]

    def core(piece: bytes, lead: int, windows: int, k: int) -> int | None:
        """Hash of the bytes that all windows of a range of offsets hold; null if the fragment has no such window."""
        if lead < k * STEP or lead - windows + 1 >= (k + 1) * STEP:
            return None
        return int.from_bytes(hashlib.blake2b(piece[lead - k * STEP : lead - (k + 1) * STEP + WINDOW + 1], digest_size=8).digest(), "little", signed=True)

    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            columns: list[list] = [[] for _ in names]
            for text, rims in zip(*(c.to_pylist() for c in batch.slice(row, 256).columns)):
                raw = text.encode()
                for r in rims:
                    piece, lead = raw[r["start"] : r["start"] + r["windows"] + WINDOW - 1], r["lead"]
                    cores = [core(piece, lead, r["windows"], k) for k in range(RANGES)]
                    for column, v in zip(columns, (r["anchor"], r["f1"], r["f2"], r["windows"], lead, cores, piece)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def remove_repeats(df: DataFrame) -> DataFrame:
    """Per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining text (the kept bytes, with
    a replacement character where a removed byte was a part of a character)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    found = repeated_windows(docs).withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    met = docs.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return met.select("doc_id", "text", "found").mapInArrow(_remove, schema)
