"""Comparison of runs, lineage of findings, and the surfaces that list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reference_number, text


def compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(fingerprint, change, old_severity, new_severity): new, fixed, changed or persistent."""
    old = previous.groupBy("fingerprint").agg(F.min("severity").alias("old_severity"))
    new = current.groupBy("fingerprint").agg(F.min("severity").alias("new_severity"))
    change = F.when(F.col("old_severity").isNull(), "new").when(F.col("new_severity").isNull(), "fixed").when(F.col("old_severity") != F.col("new_severity"), "changed").otherwise("persistent")
    return old.join(new, "fingerprint", "full").select("fingerprint", change.alias("change"), "old_severity", "new_severity")


def comparison_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def lineage_split(open_rows: DataFrame, current: DataFrame) -> DataFrame:
    """(fingerprint, agent_type, state): known, first_seen or unseen."""
    a = open_rows.select("fingerprint", "agent_type").distinct().withColumn("was", F.lit(True))
    b = current.select("fingerprint", "agent_type").distinct().withColumn("now", F.lit(True))
    state = F.when(F.col("was").isNull(), "first_seen").when(F.col("now").isNull(), "unseen").otherwise("known")
    return a.join(b, ["fingerprint", "agent_type"], "full").select("fingerprint", "agent_type", state.alias("state"))


def fixed_now(lineage: DataFrame, current: DataFrame) -> DataFrame:
    """Open or in-progress rows of agents that reported anything now, and whose fingerprint is not among it."""
    candidates = lineage.filter(F.col("current_status").isin("open", "in_progress")).join(current.select("agent_type").distinct(), "agent_type", "left_semi")
    return candidates.join(current.select("fingerprint", "agent_type").distinct(), ["fingerprint", "agent_type"], "left_anti")


def lineage_of(seen: DataFrame, runs: DataFrame) -> DataFrame:
    """ST13 in batch: per (agent_type, fingerprint) and run of its agent: open, fixed, regression or persistent.

    ``runs`` is (agent_type, run) with the runs in which the agent reported anything, ``seen`` is (agent_type,
    fingerprint, run). A run without the fingerprint after one with it fixes it; coming back is a regression. Status
    rows exist from the first sight on.
    """
    first = seen.groupBy("agent_type", "fingerprint").agg(F.min("run").alias("first_run"))
    grid = first.join(runs.distinct(), "agent_type").filter(F.col("run") >= F.col("first_run"))
    marked = grid.join(seen.distinct().withColumn("now", F.lit(True)), ["agent_type", "fingerprint", "run"], "left").withColumn("now", F.coalesce("now", F.lit(False)))
    before = F.lag("now").over(Window.partitionBy("agent_type", "fingerprint").orderBy("run"))
    event = F.when(before.isNull(), "detected").when(F.col("now") & ~before, "regression").when(~F.col("now") & before, "fixed")
    return marked.withColumn("event", event).filter(F.col("event").isNotNull()).select("agent_type", "fingerprint", "run", "event")


def lineage_state(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Current row per key: first and latest time, last event, number of events."""
    return events.groupBy(*keys).agg(
        F.min(order).alias("first_found_at"), F.max(order).alias("latest_found_at"), F.max_by("event", order).alias("current_status"), F.count(F.lit(1)).alias("n_events")
    )


def upsert_lineage(known: DataFrame, seen: DataFrame) -> DataFrame:
    """SNK3: known rows keep their first_* and take the latest_* of what was seen; unknown ones are added."""
    key = ["fingerprint", "source_path", "agent_type"]
    new = seen.groupBy(*key).agg(F.min("at").alias("n_first"), F.max("at").alias("n_latest"))
    both = known.join(new, key, "full")
    return both.select(*key, F.coalesce("first_found_at", "n_first").alias("first_found_at"), F.coalesce("n_latest", "latest_found_at").alias("latest_found_at"))


def insert_absent(existing: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """SNK1, SNK2: rows whose key is not there yet, once each; to be appended."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def store_edges(events: DataFrame) -> DataFrame:
    """SNK4: the latest strength of (source_id, target_id, relation_type); no self links, strength in [0, 1]."""
    ok = events.filter((F.col("source_id") != F.col("target_id")) & F.col("strength").between(0, 1))
    return ok.groupBy("source_id", "target_id", "relation_type").agg(F.max_by("strength", "created_at").alias("strength"))


def remediation_confidence(start: Column, statuses: Column) -> Column:
    """SNK5: +0.1 for resolved or fixed, -0.2 for a false positive, in order, within [0, 1]."""

    def step(c: Column, s: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c + F.when(s.isin("resolved", "fixed"), 0.1).when(s == "false_positive", -0.2).otherwise(0.0), 9)))

    return F.aggregate(statuses, start, step)


def numbered(df: DataFrame, order: list[str], prefix: str = "REF", parts: int | None = None) -> DataFrame:
    """Dense numbers in a total order, and their human form. Ranges of the order are numbered side by side; only a
    count per range meets in one task."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id())
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("part_"), F.coalesce(before, F.lit(0)).alias("before_"))
    out = dealt.withColumn("rn_", F.row_number().over(Window.partitionBy("part_").orderBy(*order))).join(sizes, "part_")
    out = out.withColumn("ref_number", F.col("before_") + F.col("rn_")).drop("part_", "rn_", "before_")
    return out.withColumn("ref", reference_number(F.col("ref_number"), prefix))


def previous_completed(runs: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """With every run the one completed before it for the same keys."""
    w = Window.partitionBy(*keys).orderBy(at, value)
    return runs.withColumn("previous", F.lag(value).over(w))


def matching_previous(runs: DataFrame, run_id: str, recent: int = 10) -> DataFrame:
    """The latest earlier run with the same set of types among the last ``recent`` ones."""
    one = runs.filter(F.col("id") == run_id).select(F.col("created_at").alias("at"), F.sort_array("types").alias("t"))
    last = runs.filter(F.col("id") != run_id).join(one, F.col("created_at") < F.col("at")).orderBy(F.desc("created_at")).limit(recent)
    return last.filter(F.sort_array("types") == F.col("t")).orderBy(F.desc("created_at")).limit(1).drop("at", "t")


def page_counts(parents: DataFrame, children: DataFrame, key: str, order: list, offset: int, size: int) -> DataFrame:
    """The page is cut first, then its rows are counted against."""
    cut = parents.orderBy(*order).offset(offset).limit(size)
    counts = children.join(cut.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return cut.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rescue_deltas(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """S2, ST4: snapshot rows, and delta rows of agents that sent no snapshot."""
    return snapshot.unionByName(deltas.join(snapshot.select("run_id", "agent_type").distinct(), ["run_id", "agent_type"], "left_anti"))


def patch_fold(ops: DataFrame) -> DataFrame:
    """ST5: JSON-Patch rows (run_id, item, field, op, value, seq) folded: an item exists from its first add on; the last
    value of a field counts, but a replace before the add is ignored."""
    added = ops.filter("op = 'add'").groupBy("run_id", "item").agg(F.min("seq").alias("added_at"))
    live = ops.join(added, ["run_id", "item"]).filter((F.col("op") == "add") | (F.col("seq") > F.col("added_at")))
    return live.groupBy("run_id", "item", "field").agg(F.max_by("value", "seq").alias("value"))


#: Calls looked back on, repeats that warn and that kill, and calls of a run in all.
LOOP_WINDOW, LOOP_WARN, LOOP_KILL, LOOP_LIMIT = 40, 10, 20, 100


def call_signature(tool: Column, args: Column, result: Column) -> Column:
    """Calls alike in tool, arguments and result; equal calls with other results are no loop."""
    return F.sha2(F.concat_ws("\0", text(tool), text(args), text(result)), 256)


def loop_calls(calls: DataFrame, window: int = LOOP_WINDOW, warn: int = LOOP_WARN, kill: int = LOOP_KILL, limit: int = LOOP_LIMIT) -> DataFrame:
    """W7, ST8: per call how often its signature came in the last ``window`` calls, whether A-B-A-B, and the verdict:
    ``kill`` beyond a run's limit of calls, for too many repeats, or for A-B-A-B; else ``warn`` or ``continue``."""
    w = Window.partitionBy("run_id").orderBy("seq")
    recent = F.collect_list("signature").over(w.rowsBetween(1 - window, 0))
    seen = F.size(F.filter(recent, lambda s: s == F.col("signature")))
    lag = lambda n: F.lag("signature", n).over(w)
    pong = (lag(2) == F.col("signature")) & (lag(1) == lag(3)) & (lag(1) != F.col("signature"))
    out = calls.withColumn("repeats", seen).withColumn("ping_pong", F.coalesce(pong, F.lit(False)))
    killed = (F.row_number().over(w) >= limit) | (F.col("repeats") >= kill) | F.col("ping_pong")
    return out.withColumn("verdict", F.when(killed, "kill").when(F.col("repeats") >= warn, "warn").otherwise("continue"))


def expand_stages(wanted: DataFrame, has_source: bool) -> DataFrame:
    """Stages with their prerequisites, each once, in the fixed order scan, discover, prove."""
    needs = {"prove": ["scan", "discover"], "discover": ["scan"] if has_source else [], "scan": []}
    pairs = F.create_map(*(F.lit(x) for k, v in needs.items() for x in (k, ",".join(v))))
    more = F.array_remove(F.split(F.coalesce(F.try_element_at(pairs, F.col("stage")), F.lit("")), ","), "")
    again = F.flatten(F.transform(more, lambda s: F.array_remove(F.split(F.coalesce(F.try_element_at(pairs, s), F.lit("")), ","), "")))
    every = wanted.select(F.explode(F.concat(F.array("stage"), more, again)).alias("stage")).distinct()
    return every.withColumn("place", F.array_position(F.array(*map(F.lit, ["scan", "discover", "prove"])), F.col("stage"))).filter("place > 0")
