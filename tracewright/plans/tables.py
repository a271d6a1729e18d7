"""The driver's tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, lines_of, lookup

EVENT_SEVERITY = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt by ``doc_id`` to all cores where whole splits would leave most of them idle, as a file of one row group
    does at any size (all its other splits are empty): what is done to the rows then outweighs moving them. An input of
    many filled splits stays where it is."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        # Rows by split come from the files' footers alone.
        filled = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if not filled.most or filled.most * cores <= 2 * filled.all:
            return df
    return df.repartition(max(cores, splits), "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files (doc_id, source, path, ext, content)."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "source", path.alias("path"), F.col("lang").alias("ext"), F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return lines_of(files(spark, sf_dir), "doc_id", *more, text="content")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as findings."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("src/user"), F.col("user_id").cast("string"))
    title = F.concat(F.lit("Key "), F.get_json_object("props", "$.k"))
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ord"), lookup(F.col("event_type"), EVENT_SEVERITY, "info").alias("severity"), F.col("event_type").alias("agent_type"),
        F.col("event_type").alias("category"), title.alias("title"), path.alias("path"), F.dayofmonth("ts").alias("line_num"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ev."), F.col("event_type"))).otherwise("").alias("check_id"),
        (F.col("event_id") % 100 / 100).alias("confidence"), F.col("ts"), F.lit("").alias("description"), F.when(F.col("event_id") % 3 == 0, "").otherwise("rules").alias("provenance"),
        fingerprint(title, path, F.col("event_type"), F.lit("rules")).alias("fingerprint"),
    )


#: The same findings for the oracle.
FINDINGS_SQL = """findings AS (SELECT cast(event_id AS VARCHAR) AS id, event_id AS ord,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
  event_type AS agent_type, event_type AS category, 'Key ' || json_extract_string(props, '$.k') AS title, 'src/user' || user_id AS path, day(ts) AS line_num,
  CASE WHEN event_id % 2 = 0 THEN 'ev.' || event_type ELSE '' END AS check_id, (event_id % 100) / 100.0::DOUBLE AS confidence, ts, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'rules' END AS provenance,
  substr(sha256(lower(trim('Key ' || json_extract_string(props, '$.k'))) || '|src/user' || user_id || '|' || event_type || '|rules'), 1, 32) AS fingerprint FROM events)"""

LINES_SQL = r"""lines AS (SELECT doc_id, source, lang, source || '/' || doc_id || '.' || lang AS path, line_num, l[line_num] AS line FROM (SELECT doc_id, source, lang, l, unnest(range(1, len(l) + 1)) AS line_num FROM
  (SELECT doc_id, source, lang, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (SELECT *, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text IS NOT NULL))))"""
