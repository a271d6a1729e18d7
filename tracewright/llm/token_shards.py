"""Operator 3: token-ID shards with a minimal perfect hash index.

File format. A data set is a Parquet table of shards, a row per shard in
ascending doc_id order, written without column compression so that ``payload``
is the raw ids: little-endian, uint16 where the vocabulary allows and uint32
else. With it a shard holds its place (part, seq), ``width`` of an id in bytes,
n_ids, ``low`` and ``high`` (its least and greatest doc_id), ``nulls`` (documents
without one, which stand first), ``index`` (a minimal perfect hash of the document
keys with stored fingerprints) and ``entries`` (by slot: doc_id, first id and
number of ids, int64 each). Shards are ordered, so that a keyed access skips all
but those whose range holds the key, by the statistics of the file; in a shard it
hashes the key, reads one slot, compares the fingerprint, and slices the payload.
No list of keys is read or searched.
Spark's committer makes shards appear whole or not at all; a shard ends at
SHARD_IDS ids or after the document that passes it, so that memory is bounded by
a shard and one document.

Documents are dealt by ranges of doc_id; ``start`` of a document over the whole
set is the sum over earlier parts, earlier shards of its part, and its offset.
Rows with one doc_id keep all their ids: they are told apart by their occurrence,
in the order of their texts. A null doc_id sorts first. Null and empty texts have
the end id only. An empty table gives an empty data set.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, encode_all
from .common import shuffle_width, whole_text
from .perfect_hash import PerfectHash, mix, mix_one, probe

SHARD_IDS = 1 << 20
SHARD_SCHEMA = "part int, seq int, width int, n_ids long, low long, high long, nulls int, index binary, entries binary, payload binary"
COLUMNS = ["part", "seq", "width", "low", "high", "nulls", "index", "entries", "payload"]
#: Stands for a null doc_id before mixing.
NULL_KEY = 0x9D5A11E7


def document_keys(doc_ids: list[int | None]) -> np.ndarray:
    """uint64 keys of documents in order: the id itself; a mix of id and occurrence from the second on, and for null."""
    keys = np.array([NULL_KEY if d is None else d for d in doc_ids], np.int64).view(np.uint64)
    seen = 0
    for i, d in enumerate(doc_ids):
        seen = seen + 1 if i and d == doc_ids[i - 1] else 0
        if seen or d is None:
            keys[i] = mix(mix(keys[i : i + 1], 77), 1000 + seen)[0]
    return keys


def key_of(doc_id: int | None, occurrence: int) -> int:
    """The key that :func:`document_keys` gives the occurrence (from 0) of a doc_id."""
    key = (NULL_KEY if doc_id is None else doc_id) & (1 << 64) - 1
    return mix_one(mix_one(key, 77), 1000 + occurrence) if occurrence or doc_id is None else key


def _shard(part: int, seq: int, width: int, docs: list[int | None], ids: list[bytes]) -> list:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    firsts = np.cumsum(sizes) - sizes
    keys = document_keys(docs)
    found = PerfectHash.build(keys)
    entries = np.zeros((len(docs), 3), "<i8")
    entries[found.find(keys)] = np.stack([np.array([d or 0 for d in docs], np.int64), firsts, sizes], axis=1)
    payload = b"".join(ids) if width == 4 else np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes()
    nulls = docs.count(None)
    ends = (docs[nulls], docs[-1]) if nulls < len(docs) else (None, None)
    return [part, seq, width, int(sizes.sum()), *ends, nulls, found.to_bytes(), entries.tobytes(), payload]


def write_shards(df: DataFrame, tokenizer: str, end_id: int, path: str, parts: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encodes ``text`` of each row, appends ``end_id``, and writes the shards of (doc_id, text) to ``path``."""
    numbers = [("part", pa.int32()), ("seq", pa.int32()), ("width", pa.int32()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.int32())]
    schema = pa.schema([*numbers, *((n, pa.binary()) for n in ("index", "entries", "payload"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        width, end = 2 if c.size <= 1 << 16 else 4, int(end_id).to_bytes(4, "little")
        part, seq = TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_shard(part, seq, width, docs, ids), schema)], schema=schema)

        for batch in batches:
            made = encode_all(c, batch.column(1).to_pylist())
            for doc, x in zip(batch.column(0).to_pylist(), made):
                docs.append(doc)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= shard_ids:
                    yield pack()
                    seq, docs, ids, size = seq + 1, [], [], 0
        if docs:
            yield pack()

    read = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = read.repartitionByRange(parts or shuffle_width(df.sparkSession), *order).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids of all earlier shards. A row per part meets in one task, not more."""
    sizes = shards.select("part", "seq", "n_ids")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier().orderBy("part")), zero).alias("part_start"))
    inner = F.coalesce(F.sum("n_ids").over(earlier("part").orderBy("seq")), zero)
    return sizes.withColumn("inner", inner).join(parts, "part").select("part", "seq", (F.col("inner") + F.col("part_start")).alias("shard_start"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, seq, width, low, high, nulls, index, entries, payload) of every shard; entries as an array, payload not copied."""
    for batch in batches:
        for row in range(batch.num_rows):
            *numbers, index, entries, payload = (c[row] for c in batch.columns)
            yield *(c.as_py() for c in numbers), index.as_py(), np.frombuffer(entries.as_buffer(), "<i8").reshape(-1, 3), memoryview(payload.as_buffer())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, seq, doc_id, first id in the shard, ids as raw little-endian bytes, width) in order; fails if the
    shard's index does not lead to its entries."""
    for part, seq, width, _, _, nulls, index, entries, raw in _shards(batches):
        order = np.lexsort((entries[:, 0], entries[:, 1]))
        docs = [None] * nulls + entries[order[nulls:], 0].tolist()
        if (PerfectHash.from_bytes(index).find(document_keys(docs)) != order).any():
            raise ValueError(f"shard {part}, {seq} does not hold its own keys")
        for doc, (first, n) in zip(docs, entries[order, 1:].tolist()):
            yield part, seq, doc, first, raw[first * width : (first + n) * width], width


def _wide(raw: memoryview, width: int) -> bytes:
    return bytes(raw) if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the data set, from its files: (doc_id, start, n_tokens, ids_crc32), the crc over its
    ids as little-endian uint32. Only these figures are joined with the starts of shards, never payloads."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[] for _ in range(6)]
        for part, seq, doc, first, raw, width in _documents(batches):
            for column, v in zip(columns, (part, seq, doc, first, len(raw) // width, zlib.crc32(_wide(raw, width)))):
                column.append(v)
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"])

    found = shards.select(COLUMNS).mapInArrow(run, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long")
    met = found.join(shard_starts(shards), ["part", "seq"])
    return met.select("doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids array<int>) of the asked documents; null asks for documents without a doc_id.

    Shards whose range holds no asked key are skipped by the files' statistics. In the
    others each asked key costs one probe of the index, one slot and one slice; the
    occurrences of a doc_id are probed until one is not there."""
    wanted = sorted({d for d in doc_ids if d is not None})
    with_null = None in doc_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, width, low, high, nulls, index, entries, raw in _shards(batches):
            here = [None] if with_null and nulls else []
            if low is not None:
                here += wanted[bisect_left(wanted, low) : bisect_right(wanted, high)]
            for doc in here:
                occurrence = 0
                while (slot := probe(index, key_of(doc, occurrence))) >= 0 and (doc is None or entries[slot, 0] == doc):
                    _, first, n = entries[slot].tolist()
                    ids = np.frombuffer(_wide(raw[first * width : (first + n) * width], width), "<u4").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    occurrence += 1

    may = F.lit(with_null) & (F.col("nulls") > 0)
    if wanted:
        in_range = (F.col("high") >= wanted[0]) & (F.col("low") <= wanted[-1])
        may = (may | in_range) if with_null else in_range
    return spark.read.parquet(path).filter(may).select(COLUMNS).mapInArrow(run, "doc_id long, ids array<int>")
