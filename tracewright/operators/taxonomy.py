"""Weakness families, category bridges, coverage, normalisation cascades, corpus gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_weakness(raw: Column) -> Column:
    """The number of CWE-n, or null."""
    return F.when(raw.rlike(r"(?i)^CWE-[0-9]+"), F.regexp_extract(raw, r"(?i)^CWE-([0-9]+)", 1).cast("int"))


def fan_out(findings: DataFrame, bridge: DataFrame) -> DataFrame:
    """A row per category that holds a finding's weakness. The bridge is a dimension; Spark broadcasts it by size."""
    return findings.join(bridge, "weakness")


def relabel(findings: DataFrame, prefix: str) -> DataFrame:
    """FLT15: findings under a category: new check id, prefixed title, no snippet."""
    return findings.withColumn("check_id", F.concat_ws(".", F.lit(prefix), "category_id", F.col("weakness").cast("string"))).withColumn("title", F.concat(F.lit("["), F.col("category_id"), F.lit("] "), F.col("title"))).drop("snippet")


def coverage(bridge: DataFrame, detected: DataFrame) -> DataFrame:
    """A10: per category the number of its weaknesses, those found (sorted), and whether any was."""
    found = detected.select("weakness").distinct().withColumn("hit", F.lit(True))
    per = bridge.join(found, "weakness", "left").groupBy("category_id").agg(F.countDistinct("weakness").alias("mapped_count"), F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("weakness")))).alias("found"))
    return per.withColumn("status", F.when(F.size("found") > 0, "findings").otherwise("clean"))


def unmapped(bridge: DataFrame, detected: DataFrame) -> DataFrame:
    """S3: detected weaknesses that no category holds."""
    return detected.select("weakness").distinct().join(bridge, "weakness", "left_anti")


def longest_prefix(values: DataFrame, prefixes: DataFrame, value: str, prefix: str, result: str) -> DataFrame:
    """The result of the longest prefix of each value. Every prefix length that occurs is tried by an equi-join."""
    sizes = prefixes.select(F.length(prefix).alias("size")).distinct()
    tried = values.select(value).distinct().join(sizes, F.length(value) >= F.col("size")).withColumn(prefix, F.expr(f"left({value}, size)"))
    best = tried.join(prefixes, prefix).groupBy(value).agg(F.max_by(result, F.length(prefix)).alias(result))
    return values.join(best, value, "left")


def cascade(findings: DataFrame, tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """The first table (key -> weakness) that knows a finding names its weakness."""
    out = findings
    for i, (table, key) in enumerate(tables):
        out = out.join(table.select(F.col("key").alias(key), F.col("weakness").alias(f"w{i}")), key, "left")
    return out.withColumn("weakness", F.coalesce(*(f"w{i}" for i in range(len(tables))))).drop(*(f"w{i}" for i in range(len(tables))))


def parents(catalogue: DataFrame) -> DataFrame:
    """(child, parent) from exploded ChildOf relations that stay in the catalogue."""
    up = catalogue.select(F.col("id").alias("child"), F.explode("related").alias("r")).filter("r.nature = 'ChildOf'").select("child", F.col("r.weakness").alias("parent"))
    return up.join(catalogue.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent")


def parent_rollup(hits: DataFrame, up: DataFrame, least: int = 2) -> DataFrame:
    """Parents of which ``least`` distinct children were hit in a file."""
    met = hits.join(up, hits.weakness == up.child).groupBy("path", "parent").agg(F.sort_array(F.collect_set("child")).alias("children"))
    return met.filter(F.size("children") >= least)


def detectable(catalogue: DataFrame, least: float = 0.5) -> DataFrame:
    """What static analysis can see, best first."""
    return catalogue.filter(F.col("static_detectability") >= least).orderBy(F.desc("static_detectability"), "id")


def corpus_gate(manifest: DataFrame, hits: DataFrame, least_recall: float = 1.0, most_fp: float = 0.0, least_fixtures: int = 3) -> DataFrame:
    """Recall and false-positive rate per weakness over labelled files, and the band."""
    found = hits.select("file", "weakness").distinct().withColumn("hit", F.lit(1))
    met = manifest.join(found, ["file", "weakness"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    pos, neg = F.col("expectation") == "positive", F.col("expectation") == "negative"
    per = met.groupBy("weakness").agg(
        F.count_if(pos).alias("positives"), F.count_if(neg).alias("negatives"), F.coalesce(F.avg(F.when(pos, F.col("hit"))), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(F.when(neg, F.col("hit"))), F.lit(0.0)).alias("fp_rate")
    )
    gate = (F.col("recall") >= least_recall) & (F.col("fp_rate") <= most_fp) & (F.col("positives") >= least_fixtures) & (F.col("negatives") >= least_fixtures)
    return per.withColumn("band", F.when(gate, "VERIFIED").when(F.col("recall") > 0, "DETECTED").otherwise("NOT_DETECTED"))


def coverage_share(universe: DataFrame, reached: DataFrame) -> DataFrame:
    """Size of the universe, what is reached of it, and the share in percent."""
    n = universe.select("weakness").distinct()
    both = n.intersect(reached.select("weakness").distinct())
    return n.agg(F.count(F.lit(1)).alias("universe")).crossJoin(both.agg(F.count(F.lit(1)).alias("reached"))).withColumn("share", F.floor(F.col("reached") * 1000 / F.col("universe") + 0.5) / 10)


def capability_match(findings: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Findings that a capability takes by weakness or by the head of the check id."""
    by_weakness = findings.join(capabilities.select("weakness").filter("weakness IS NOT NULL").distinct(), "weakness", "left_semi")
    head = F.substring_index("check_id", ".", 1)
    by_head = findings.withColumn("head", head).join(capabilities.select(F.col("check_head").alias("head")).filter("head IS NOT NULL").distinct(), "head", "left_semi").drop("head")
    return by_weakness.unionByName(by_head).dropDuplicates(["id"])


def overlap_or_any(capability: Column, wanted: Column) -> Column:
    """An empty list takes anything."""
    return (F.size(capability) == 0) | F.arrays_overlap(capability, wanted)


def dominant(hits: DataFrame, key: str) -> DataFrame:
    """The framework of the least priority number per key."""
    return hits.groupBy(key).agg(F.min_by("framework", "priority").alias("framework"))


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def running_keep(df: DataFrame, keys: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Token budgeting: rows in order while their sum stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)
