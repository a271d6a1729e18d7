"""Operator 10: WARC sets with a Merkle fixity audit.

Web pages become WARC/1.1 response records, laid end to end in page_id order in
segments: a segment is a run of records of about SEGMENT_BYTES, a row of a
Parquet table whose ``body`` is the segment's raw bytes, with the ordered offset
ranges of its records beside it. Over a segment stands a hash tree: a leaf is the
SHA-256 of a record's range and the SHA-256 of its bytes, an inner node the
SHA-256 of up to FANOUT children in order, and the roots of segments are the
leaves of the tree of a part and those of the whole set.

An audit compares two replicas, such as two copies in two stores. Each is hashed
once where it lies, into a table of trees about a hundredth of its size; pages
never travel. The roots of the two sets are compared first, and nothing more is read
if they agree; then the roots of parts, the roots of the segments of parts that
differ, and the stored levels of the segments that differ, from their roots down,
so that records under equal branches are neither listed nor compared. What is found
are records: ``changed`` (other bytes in the same place of the order), ``missing``
or ``added``.

Null url and html are empty; a null page_id sorts first and names a record
``null``. Repeated pages are records of their own. Pages of any size are whole
records: memory is bounded by a segment and one page. Empty tables give empty sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, shuffle_width

SEGMENT_BYTES = 4 << 20
FANOUT = 16
#: Fixed value: the date of all records, so that equal pages give equal bytes.
RECORD_DATE = "2024-01-01T00:00:00Z"
COLUMNS = ["part", "seq", "page_ids", "offsets", "body"]
SEGMENT_SCHEMA = "part int, seq int, page_ids array<bigint>, offsets array<bigint>, body binary"

_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("page_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("body", pa.binary())])


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC response record; one line feed in the url would end the header, so control characters are escaped."""
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    name = "null" if page_id is None else str(page_id)
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Date: {RECORD_DATE}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    )
    return head.encode() + http + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP body of a record; fails on a damaged frame."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    return fields, block.partition(b"\r\n\r\n")[2]


def tree(leaves: list[bytes]) -> list[list[bytes]]:
    """Levels of hashes from the leaves to the root; the root of no leaves is the hash of nothing."""
    levels = [leaves or [hashlib.sha256(b"").digest()]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256(b"".join(below[i : i + FANOUT])).digest() for i in range(0, len(below), FANOUT)])
    return levels


def digests(offsets: list[int], body: bytes) -> list[bytes]:
    """SHA-256 of every record."""
    view = memoryview(body)
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets, offsets[1:])]


def leaves(offsets: list[int], records: list[bytes]) -> list[bytes]:
    """A leaf per record: its range of offsets and its digest."""
    return [hashlib.sha256(a.to_bytes(8, "little") + b.to_bytes(8, "little") + d).digest() for a, b, d in zip(offsets, offsets[1:], records)]


def differing(a: list[list[bytes]], b: list[list[bytes]]) -> list[int]:
    """Leaves that differ between two trees of one shape, by descent into mismatching branches only."""
    at = [i for i in range(len(a[-1])) if a[-1][i] != b[-1][i]]
    for level in range(len(a) - 2, -1, -1):
        below = [c for i in at for c in range(i * FANOUT, min((i + 1) * FANOUT, len(a[level])))]
        at = [c for c in below if a[level][c] != b[level][c]]
    return at


def write(df: DataFrame, path: str, parts: int | None = None, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes (page_id, url, html) as WARC segments to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, raw = TaskContext.get().partitionId(), 0, [], []

        def pack() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(x) for x in raw]).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, seq, ids, offsets, b"".join(raw)), _ARROW)], schema=_ARROW)

        size = 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(page)
                raw.append(record(page, url, html))
                size += len(raw[-1])
                if size >= segment_bytes:
                    yield pack()
                    seq, ids, raw, size = seq + 1, [], [], 0
        if ids:
            yield pack()

    read = df.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    dealt = read.repartitionByRange(parts or shuffle_width(df.sparkSession), "page_id", F.xxhash64("url", "html")).sortWithinPartitions("page_id", "url", "html")
    dealt.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def replica(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(COLUMNS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(c[row].as_py() for c in batch.columns)


TREE_SCHEMA = "part int, seq int, root binary, page_ids array<bigint>, offsets array<bigint>, records array<binary>, levels array<array<binary>>"


def trees(segments: DataFrame) -> DataFrame:
    """Per segment of a replica its root, what its tree is made of (ranges and record digests), and the tree's levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.binary()))]
        for part, seq, ids, offsets, body in _rows(batches):
            records = digests(offsets, body)
            levels = tree(leaves(offsets, records))
            row = (part, seq, levels[-1][0], ids, offsets, records, levels)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "seq", "root", "page_ids", "offsets", "records", "levels"])

    return segments.mapInArrow(run, TREE_SCHEMA)


def part_roots(roots: DataFrame) -> DataFrame:
    """(part, root): the root over a part's segments, from their roots alone; a group holds a part's segments, not its records."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.hex("root").alias("r"))))
    placed = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["seq"].cast("string"), x["r"])), ",")
    return roots.groupBy("part").agg(F.sha2(placed, 256).alias("root"))


def set_root(parts: DataFrame) -> str:
    """Hex root of a whole set from its :func:`part_roots` (a row per part comes to the driver)."""
    found = parts.orderBy("part").collect()
    return tree([hashlib.sha256(f"{r.part}:{r.root}".encode()).digest() for r in found])[-1][0].hex()


def unmatched(a_ids: list[int | None], a_records: list[bytes], b_ids: list[int | None], b_records: list[bytes]) -> list[tuple[int | None, int, str]]:
    """(page_id, record, state) of records without an equal one in the other segment, as multisets: each record of a
    page is matched with one of its digest. Of what is left of a page, as many as both sides have are changed; the
    others are missing (by their place in the first) or added (by their place in the second)."""
    theirs: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(b_ids, b_records)):
        theirs.setdefault(key, []).append(i)
    for same in theirs.values():
        same.reverse()
    lost = [i for i, key in enumerate(zip(a_ids, a_records)) if not (theirs.get(key) and theirs[key].pop() is not None)]
    new = sorted(i for same in theirs.values() for i in same)
    left: dict[int | None, int] = {}
    for i in new:
        left[b_ids[i]] = left.get(b_ids[i], 0) + 1
    found, taken = [], {}
    for i in lost:
        page = a_ids[i]
        changed = taken.get(page, 0) < left.get(page, 0)
        taken[page] = taken.get(page, 0) + changed
        found.append((page, i, "changed" if changed else "missing"))
    for i in new:
        page = b_ids[i]
        if taken.get(page, 0):
            taken[page] -= 1
        else:
            found.append((page, i, "added"))
    return found


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records in which replica two differs from replica one, from their :func:`trees` (written tables, as each is read
    more than once): (page_id, part, seq, record, state).

    A segment that holds other numbers of records in the two is compared record by record, repeated ones by their number.
    """
    spark, schema = one.sparkSession, "page_id long, part int, seq int, record long, state string"
    parts = [Stage(part_roots(t.select("part", "seq", "root")), "part-roots").read() for t in (one, two)]
    if set_root(parts[0]) == set_root(parts[1]):
        return spark.createDataFrame([], schema)
    key = ["part", "seq"]
    unlike = ~F.col("root_one").eqNullSafe(F.col("root_two"))

    def differs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        a, b = left.select(*on, F.col("root").alias("root_one")), right.select(*on, F.col("root").alias("root_two"))
        return a.join(b, on, "full").filter(unlike).select(*on)

    odd_parts = Stage(differs(*parts, ["part"]), "odd-parts").read()
    odd = Stage(differs(one.join(odd_parts, "part", "left_semi"), two.join(odd_parts, "part", "left_semi"), key), "odd-segments").read()
    of = lambda df, p: df.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in ("page_ids", "offsets", "records", "levels")))
    met = odd.join(of(one, "a"), key, "left").join(of(two, "b"), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, a_ids, a_offsets, a_records, a_levels, b_ids, b_offsets, b_records, b_levels in _rows(batches):
            found: list[tuple[int | None, int, str]] = []
            if a_ids is None or b_ids is None:
                found = [(p, i, "missing" if b_ids is None else "added") for i, p in enumerate(a_ids or b_ids or [])]
            elif len(a_ids) == len(b_ids):
                # Behind a record of another length all ranges have moved, and with them the leaves: the records' digests decide.
                moved = a_offsets != b_offsets
                at = [i for i, (x, y) in enumerate(zip(a_records, b_records)) if x != y] if moved else differing(a_levels, b_levels)
                found = [(a_ids[i], i, "changed") for i in at]
            else:
                found = unmatched(a_ids, a_records, b_ids, b_records)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([part] * len(found), pa.int32()), pa.array([seq] * len(found), pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())],
                names=["page_id", "part", "seq", "record", "state"],
            )

    return met.mapInArrow(run, schema)


def damage(segments: DataFrame, page_every: int) -> DataFrame:
    """A fire drill's replica: in records of pages whose id ``page_every`` divides, the last byte of the HTTP
    body (or of the header, if the page is empty) is inverted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, ids, offsets, body in _rows(batches):
            raw = bytearray(body)
            for page, end in zip(ids, offsets[1:]):
                if page is not None and page % page_every == 0:
                    raw[end - 5] ^= 0xFF
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, seq, ids, offsets, bytes(raw)), _ARROW)], schema=_ARROW)

    return segments.mapInArrow(run, SEGMENT_SCHEMA)


def inventory(segments: DataFrame) -> DataFrame:
    """Every record of a replica: (page_id, part, seq, record, n_bytes, record_sha256, intact), intact being
    whether the frame parses and the payload digest holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, ids, offsets, body in _rows(batches):
            raws = [body[a:b] for a, b in zip(offsets, offsets[1:])]
            intact = []
            for raw in raws:
                try:
                    fields, payload = parse(raw)
                    intact.append(fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest())
                except (ValueError, KeyError):
                    intact.append(False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()), pa.array(range(len(ids)), pa.int64()),
                    pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()), pa.array(intact, pa.bool_()),
                ],
                names=["page_id", "part", "seq", "record", "n_bytes", "record_sha256", "intact"],
            )

    return segments.mapInArrow(run, "page_id long, part int, seq int, record long, n_bytes long, record_sha256 string, intact boolean")
