"""Streaming twins as queries: each runs over what there is and ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as streaming

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a single file and a folder of files both stand under its name."""
    return spark.readStream.schema(streaming.EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def _place(spark: SparkSession) -> str:
    """A folder for a stream's rows and progress, in the shared folder of the session where one is set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{place.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    return streaming.run_to_files(stream, _place(spark), mode, keys)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_progress(spark, sf_dir):
    """ST14."""
    return _run(spark, streaming.progress(_stream(spark, sf_dir)), "complete")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'finding_delta' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'state_snapshot' WHEN 'signup' THEN 'run_started' ELSE 'run_error' END AS operation, json_extract_string(props, '$.k')::INT AS k FROM events")
def stream_translate(spark, sf_dir):
    """ST2."""
    return _run(spark, streaming.translate(_stream(spark, sf_dir)).select("event_id", "operation", "k"), "append")


@query("SELECT event_id, value FROM events")
def stream_idempotent(spark, sf_dir):
    """ST1 and ST12: a stream joined with itself counts every event once."""
    both = streaming.fan_in(_stream(spark, sf_dir), _stream(spark, sf_dir))
    return _run(spark, streaming.idempotent(both, "60 days").select("event_id", "value"), "append")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windowed(spark, sf_dir):
    """An addition to the inventory: counts by event-time window."""
    return _run(spark, streaming.windowed(_stream(spark, sf_dir)), "complete").withColumn("total", F.round("total", 6))


@query("""WITH w AS (SELECT user_id, event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS r, lag(event_type, 1) OVER s AS a, lag(event_type, 2) OVER s AS b, lag(event_type, 3) OVER s AS c, row_number() OVER s AS total
    FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT user_id, event_id, total, len(list_filter(r, lambda v: v = event_type))::INT AS repeats, coalesce(b = event_type AND a = c AND a <> event_type, false) AS pong FROM w)
  SELECT user_id, event_id, repeats, CASE WHEN total >= 100 OR repeats >= 20 OR pong THEN 'kill' WHEN repeats >= 10 THEN 'warn' ELSE 'continue' END AS verdict FROM x""")
def stream_loop_detector(spark, sf_dir):
    """ST8: the last forty events of a user are state."""
    return _run(spark, streaming.loop_detector(_stream(spark, sf_dir)), "append")


@query("SELECT user_id, count(*) AS n, min(event_id) FILTER (event_type = 'error' AND ts = t) AS first_error, arg_max(value, event_id) AS last_value FROM (SELECT *, min(ts) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS t FROM events) GROUP BY user_id")
def stream_drain(spark, sf_dir):
    """ST3: first error and last value of a user."""
    return _run(spark, streaming.drain(_stream(spark, sf_dir)), "update", ["user_id"])
