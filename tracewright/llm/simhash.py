"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2 bits exactly when some third value differs
from each in at most 1 bit. So every *distinct* fingerprint emits itself and its
64 one-bit variants, the variants are shuffled, and fingerprints that meet on
one are linked. Exact and near copies that share a fingerprint are collapsed
before, so a variant is met by 65 fingerprints at most however large a group of
copies is: no bucket is capped and no pair of copies is spelled out. Each member
of a bucket is linked to the bucket's least member after the distance check; all
members of a bucket are within 2 bits of each other, so no reachability is lost.

Null text is read as empty. A text of one or two words has one shingle, the
whole sequence; a text without words has fingerprint zero, linked like any other.
Repeated rows and ties give equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, Stage, whole_text
from .components import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted together.
BITS_AT_ONCE = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text, unsigned."""
    # On bytes, lower() changes A-Z only and split() cuts at \x20 and \x09-\x0D only.
    w = text.encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.fromiter(map(_hash, parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BITS_AT_ONCE):
        some = h[at : at + BITS_AT_ONCE]
        ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long, a row for every row of
    ``df``; text_key tells rows with one doc_id and different texts apart."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = np.array([fingerprint(t) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made)], names=["doc_id", "text_key", "fp"])

    read = df.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    return read.mapInArrow(run, "doc_id long, text_key long, fp long")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` at most 2 bits apart that connect
    everything such pairs connect: each fingerprint with the least one of each ball it is in."""
    variants = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    balls = (
        distinct_fps.select("fp", F.explode(variants).alias("variant"))
        .groupBy("variant")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )
    met = balls.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter(F.col("u") != F.col("v")).distinct()
    return met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def _classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, root) of all distinct fingerprints."""
    fps = Stage(fingerprints(df), "fingerprints").read()
    distinct = Stage(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least")), "distinct").read()
    roots = components(links(distinct))
    return fps, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for every row of ``df``; component_id is
    the least doc_id reachable over links, the document's own included (null if none has one)."""
    fps, rooted = _classes(df)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of documents, one row of each group of near copies: the one with the
    least doc_id (a null doc_id first; of rows with one doc_id, one text)."""
    _, rooted = _classes(docs)
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_key").alias("k_text"))
    known = docs.select(DOC_COLUMNS).withColumn("k_row", F.xxhash64(whole_text()))
    met = known.join(first, known.doc_id.eqNullSafe(F.col("k_id")) & (F.col("k_row") == F.col("k_text")), "left_semi")
    return met.dropDuplicates(["doc_id", "k_row"]).select(DOC_COLUMNS)
