"""What the operators share: text access, the shared folder, written stages."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import Stage, forget_at_exit, scratch_path  # noqa: F401

#: Columns of ``documents``; a filtering stage returns exactly these.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A word is a maximal run of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when it was not installed for them."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH")]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every operator also takes the path itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))
