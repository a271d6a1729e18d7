"""Corpus pipeline: quality rules, near-duplicate removal, redaction, mixing, BPE encoding.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame;
its result is written as Parquet and read again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import encoding, mixing, near_copies, pii, quality
from tracewright.llm.common import Stage, read_table, ship, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that fail the rules or the divergence verdict go."""
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4's method for the stage: one document of each group of near copies (5-word Jaccard of 0.8 or more) stays."""
    ship(spark)
    return near_copies.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: personal data is replaced by labels."""
    return pii.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token ids of every document, and their number, beside its columns but the text; the ids
    are decoded again, and the digest of the result and whether it is the text stand beside them."""
    ship(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    # Written between the two, so that a core never holds an encoding and a decoding worker at once.
    decoded = encoding.decode(Stage(encoding.encode(docs, path), "encoded").read(), path)
    return decoded.selectExpr(
        "doc_id", "lang", "source", "n_chars", "octet_length(ids) div 4 AS n_tokens", "ids", "sha2(decoded, 256) AS decoded_sha256", "coalesce(text, '') = decoded AS round_trip"
    )


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: Components of fingerprints and BPE have no SQL form here; tests/llm holds the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = Stage(function(spark, docs, sf_dir), name.replace(" ", "-")).read()
    return docs
