"""Structured Streaming twins of the stateful event operators. Batch operators stay the reference of what they give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.history import LOOP_KILL, LOOP_LIMIT, LOOP_WARN, LOOP_WINDOW

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Event kinds that have a meaning; others are dropped.
KNOWN = {"click": "finding_delta", "view": "progress", "purchase": "state_snapshot", "signup": "run_started", "error": "run_error"}


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files of events."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_sse(lines: DataFrame) -> DataFrame:
    """SRC17: (kind, data) of text blocks with event: and data: fields."""
    return lines.select(F.regexp_extract("value", r"(?m)^event:\s*(\S+)", 1).alias("kind"), F.regexp_extract("value", r"(?m)^data:\s*(.*)$", 1).alias("data")).filter("kind <> ''")


def translate(events: DataFrame) -> DataFrame:
    """ST2: known kinds as operations with their payload; unknown kinds are dropped."""
    table = F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv))
    return events.withColumn("operation", F.try_element_at(table, F.col("event_type"))).filter("operation IS NOT NULL").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def emit(events: DataFrame) -> DataFrame:
    """SNK7: one JSON text per event."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def progress(events: DataFrame) -> DataFrame:
    """ST14: running counts by run and kind."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def fan_in(*streams: DataFrame) -> DataFrame:
    """ST1: streams of one schema as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def idempotent(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST12: the first row of an event_id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An addition to the inventory: counts and sums by event-time window, late rows dropped."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def loop_detector(events: DataFrame, window: int = LOOP_WINDOW, warn: int = LOOP_WARN, kill: int = LOOP_KILL, limit: int = LOOP_LIMIT) -> DataFrame:
    """ST8: per user the last ``window`` event types and the number of events are kept as state; a row per event with its
    repeats and verdict."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, total = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            recent = [*recent, r.event_type][-window:]
            n = recent.count(r.event_type)
            total += 1
            pong = len(recent) >= 4 and recent[-1] == recent[-3] != recent[-2] == recent[-4]
            out.append((key[0], r.event_id, n, "kill" if total >= limit or n >= kill or pong else "warn" if n >= warn else "continue"))
        state.update((recent, total))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "repeats", "verdict"])

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, repeats int, verdict string", "recent array<string>, total long", "append", GroupStateTimeout.NoTimeout)


def drain(events: DataFrame) -> DataFrame:
    """ST3: per user the first error, the last value and the number of events so far."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, error, last, last_at = state.get if state.exists else (0, None, None, None)
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            n += 1
            if r.event_type == "error" and error is None:
                error = r.event_id
            if last_at is None or r.event_id > last_at:
                last, last_at = r.value, r.event_id
        state.update((n, error, last, last_at))
        yield pd.DataFrame([(key[0], n, error, last)], columns=["user_id", "n", "first_error", "last_value"]).astype({"first_error": "Int64"})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, first_error long, last_value double", "n long, error long, last double, last_at long", "update", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, place: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is, into Parquet under ``place``, and reads the result: nothing passes through the
    driver. In complete mode the last batch's rows count, in update mode the last row of each of ``keys``."""
    spark, path = stream.sparkSession, f"{place}/rows"
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch", LongType())])
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        # A batch that is run again overwrites what it wrote before.
        out = out.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
    out.start().awaitTermination()
    made = spark.read.schema(schema).parquet(path)
    if mode == "append":
        return made
    if mode == "complete":
        last = made.agg(F.max("batch").alias("last"))
        return made.join(F.broadcast(last), F.col("batch") == F.col("last"), "left_semi").drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return made.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*stream.columns)
