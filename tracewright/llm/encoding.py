"""Operator 2: BPE encoding and decoding of a text column (see ``bpe`` for the method).

Null text is read as empty and gives no ids. Repeated rows, ties and extra
columns pass through; an empty table gives an empty table. Texts of any length
are encoded whole: memory is bounded by one batch of texts and a fixed cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec, encode_all, sha256_hex, vocabulary
from .common import whole_text

#: Rows of an Arrow batch that are turned into Python objects together.
ROWS_AT_ONCE = 1024


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: binary, the token ids as little-endian uint32. A column of that name is replaced."""
    out = df.drop(ids)
    schema = T.StructType([*out.schema.fields, T.StructField(ids, T.BinaryType())])
    names = out.columns

    def run(batches):
        c = codec(path)
        for part in _parts(batches):
            made = list(encode_all(c, part.column(names.index(text)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*names, ids])

    return out.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text of an ``ids`` column made by :func:`encode`. Null ids give empty text."""
    out = df.drop(text)
    schema = T.StructType([*out.schema.fields, T.StructField(text, T.StringType())])
    names = out.columns

    def run(batches):
        c = vocabulary(path)
        for part in _parts(batches):
            made = [c.decode(x or b"").decode() for x in part.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*names, text])

    return out.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Encodes each text, decodes the ids, and gives counts and digests of both: one row per row of ``df``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c = codec(path)
        for part in _parts(batches):
            ids = list(encode_all(c, part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha256_hex(x) for x in ids], pa.string()),
                    pa.array([sha256_hex(c.decode(x)) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, schema)


def token_lengths(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per Arrow batch and distinct encoded length: (n_tokens, n_docs), a map-side histogram."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            counts: dict[int, int] = {}
            for part in _parts(iter([batch])):
                for x in encode_all(c, part.column(0).to_pylist()):
                    counts[len(x) // 4] = counts.get(len(x) // 4, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(counts, np.int64, len(counts))), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))],
                names=["n_tokens", "n_docs"],
            )

    return df.select(whole_text(text).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
