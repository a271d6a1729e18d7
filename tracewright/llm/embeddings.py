"""Operator 9: embedding near-duplicates by cross-polytope hashing.

Each of TABLES tables rotates a vector by HASHES pseudo-random rotations (three
rounds of random signs and a fast Hadamard transform) and takes the signed axis
nearest to each rotated vector; the axes together are the bucket. Multiprobe adds
the bucket in which the least certain axis is replaced by its runner-up. Vectors
of one label that meet in a bucket are verified by their cosine in double
precision, so nothing below the threshold is linked; at the threshold the chance
that a pair meets in no bucket is measured in the tests and the README.

Equal vectors of a label are one class with a multiplicity. Only ids are shuffled
to find buckets with company; vectors travel to those alone. A bucket of any size
is cut into blocks of BLOCK members and every pair of blocks is verified by some
task; no bucket is capped. A pair counts in the least bucket that it shares, so
link counts need no pair table: a task gives back, per member, its number of
links and the least member it reaches there.

A vector that is null, empty, zero, or holds null or non-finite components, or
whose label is null, links with nothing. Vectors of different lengths do not
link. Repeated rows are vectors of their own, linked with each other. A null
vec_id is never the least one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, shuffle_width
from .components import components

COSINE = 0.98
TABLES = 4
HASHES = 2
BLOCK = 256
SEED = 20240607
#: Rows verified together.
ROWS_AT_ONCE = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=64)
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(SEED + width).choice([-1.0, 1.0], (TABLES, HASHES, 3, width))


def buckets(unit: np.ndarray) -> np.ndarray:
    """Of unit vectors (rows): the home bucket and the probe of every table, 2 * TABLES int64 columns."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    rows, out = np.arange(n), []
    for t in range(TABLES):
        home, other, margin = [], [], []
        for k in range(HASHES):
            x = padded
            for s in _signs(width)[t, k]:
                x = hadamard(x * s)
            size = np.abs(x)
            first = size.argmax(axis=1)
            top = size[rows, first].copy()
            size[rows, first] = -1.0
            second = size.argmax(axis=1)
            home.append(2 * first + (x[rows, first] > 0))
            other.append(2 * second + (x[rows, second] > 0))
            margin.append(top - size[rows, second])
        least = np.argmin(margin, axis=0)
        for probe in (False, True):
            code = np.full(n, t, np.int64)
            for k in range(HASHES):
                code = code * (2 * width) + (np.where(least == k, other[k], home[k]) if probe else home[k])
            out.append(code)
    return np.stack(out, axis=1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            n = part.num_rows
            labels, vectors = part.column(1).to_pylist(), part.column(2).to_pylist()
            keys, codes, by_size = [None] * n, [None] * n, {}
            for i, (label, v) in enumerate(zip(labels, vectors)):
                if label is not None and v and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                x = np.array([vectors[i] for i in rows], np.float64)
                norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(x).all(axis=1) & (norm > 0) & np.isfinite(norm)
                rows, x, norm = np.array(rows)[good], x[good], norm[good]
                if len(rows):
                    for i, v, c in zip(rows.tolist(), x, buckets(x / norm[:, None])):
                        keys[i] = hashlib.blake2b((v + 0.0).tobytes() + str(labels[i]).encode(), digest_size=16).digest()
                        codes[i] = c.tolist()
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(keys, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["vec_id", "label", "embedding", "class", "codes"]
            )


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n nodes' components over the links a-b."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def _verified(columns: list, threshold: float) -> pa.RecordBatch | None:
    """Links among complete groups of rows; sorted so that a group's rows stand together."""
    group, bucket, same, block, classes, times, vectors, codes = columns
    known, index = np.unique(np.array(classes, dtype="S16").view("V16"), return_inverse=True)
    x = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    links = np.zeros(len(known), np.int64)
    la, lb = [], []
    for step in range(1, len(group)):
        i = np.flatnonzero(group[:-step] == group[step:])
        if not len(i):
            break
        j = i + step
        keep = same[i] | (block[i] != block[j])
        i, j = i[keep], j[keep]
        hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[hit], j[hit]
        if len(i):
            shared = (codes[i][:, :, None] == codes[j][:, None, :]).any(axis=2)
            own = np.where(shared, codes[i], np.iinfo(np.int64).max).min(axis=1) == bucket[i]
            i, j = i[own], j[own]
            np.add.at(links, index[i], times[j])
            np.add.at(links, index[j], times[i])
            la.append(index[i])
            lb.append(index[j])
    at = np.flatnonzero(links)
    if not len(at):
        return None
    root = _local_roots(len(known), np.concatenate(la), np.concatenate(lb))
    name = lambda k: pa.array([known[i].tobytes() for i in k], pa.binary())
    return pa.RecordBatch.from_arrays([name(at), pa.array(links[at]), name(root[at])], names=["class", "n", "root"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(k).to_numpy(zero_copy_only=False) for k in ("label", "dim", "bucket", "low", "high")]
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            # The last group may go on in the next batch.
            end = table.num_rows if last else int(np.flatnonzero(new)[-1])
            held[:] = table.slice(end).to_batches() if end < table.num_rows else []
            at, starts = 0, np.append(np.flatnonzero(new), table.num_rows)
            while at < end:
                to = int(starts[np.searchsorted(starts, min(at + ROWS_AT_ONCE, end), side="left")])
                part = table.slice(at, min(to, end) - at)
                # Groups of vectors of one length stand together, but a slice may hold several lengths.
                dims = part.column("dim").to_numpy()
                for d in np.unique(dims):
                    some = part.filter(pa.array(dims == d))
                    col = lambda n: some.column(n).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    flat = lambda n: some.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    fresh = np.cumsum(new[at : at + part.num_rows])[dims == d]
                    columns = [
                        fresh, col("bucket"), col("low") == col("high"), col("block"), some.column("class").to_pylist(), col("times"),
                        flat("embedding").astype(np.float64).reshape(some.num_rows, -1), flat("codes").reshape(some.num_rows, -1),
                    ]
                    made = _verified(columns, threshold)
                    if made is not None:
                        yield made
                at += part.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def near_duplicates(df: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Per row of ``df`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    read = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    hashed = Stage(read.mapInArrow(_hashed, "vec_id long, label long, embedding array<double>, class binary, codes array<long>"), "hashed").read()
    some = F.first  # all rows of a class hold the same
    classes = hashed.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"), some("label").alias("label"), some("embedding").alias("embedding"), some("codes").alias("codes")
    )
    classes = Stage(classes.withColumn("dim", F.size("embedding")), "classes").read()
    key = ["label", "dim", "bucket"]
    members = classes.select("class", "label", "dim", F.explode(F.array_distinct("codes")).alias("bucket"))
    company = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = members.join(company, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("class", "bucket"), F.col("blocks")).cast("int"))
    met = met.join(classes.select("class", "times", "embedding", "codes"), "class")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "times", "embedding", "codes")
    group = [*key, "low", "high"]
    dealt = met.repartition(shuffle_width(df.sparkSession), *group).sortWithinPartitions(*group)
    found = Stage(dealt.mapInArrow(_verify(threshold), "class binary, n long, root binary"), "found").read()
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("class").agg(F.sum("n").alias("n"))
    rooted = classes.select("class", "times", "least").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class")).join(links, "class", "left")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("class", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = hashed.select("vec_id", "class").join(known, "class", "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
