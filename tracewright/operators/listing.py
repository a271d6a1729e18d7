"""Lists, filters, orders and caches: what users and later steps see of findings and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lookup, text


def hide_triaged(findings: DataFrame, triaged: DataFrame) -> DataFrame:
    """FLT10: without likely false positives and without fingerprints that a user triaged."""
    return findings.filter(text(F.col("validation_status")) != "likely_fp").join(triaged.select("fingerprint").distinct(), "fingerprint", "left_anti")


def dashboard_filter(audits: DataFrame, status: str | None = None, kind: str | None = None, search: str | None = None) -> DataFrame:
    """FLT11: by status, by a type among an audit's types, and by a substring of id, types or source, case left aside."""
    if status:
        audits = audits.filter(F.col("status") == status)
    if kind:
        audits = audits.filter(F.array_contains("types", kind))
    if search:
        s = search.lower()
        has = lambda c: F.lower(text(c)).contains(s)
        audits = audits.filter(has(F.col("id")) | has(F.col("source")) | F.exists("types", has))
    return audits


def normal_path(path: Column) -> Column:
    """A relative path without empty and ``.`` segments, each ``..`` taking the segment before it; one too many stays."""
    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when((s == "") | (s == "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def within_root(path: Column) -> Column:
    """FLT14: relative, and never above where it starts."""
    return ~path.startswith("/") & ~normal_path(path).rlike(r"^\.\.(/|$)") & ~path.contains("\0")


def fresh(cached: DataFrame, at: str, as_of: Column, most_age_s: int) -> DataFrame:
    """SNK9 and the verdict cache: rows of at most this age."""
    return cached.filter(F.unix_seconds(F.col(at).cast("timestamp")) >= F.unix_seconds(as_of.cast("timestamp")) - most_age_s)


def split_by_cache(findings: DataFrame, cached: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Findings with a cached verdict, joined to it, and findings that need one."""
    return findings.join(cached, key), findings.join(cached.select(key).distinct(), key, "left_anti")


def write_labels(memories: DataFrame, labels: DataFrame) -> DataFrame:
    """SNK10: a fingerprint's latest label on all of its memories; a null label clears it."""
    last = labels.groupBy("fingerprint").agg(F.max_by("user_label", "labelled_at").alias("new_label"), F.max("labelled_at").alias("new_at"))
    met = memories.join(last, "fingerprint", "left")
    seen = F.col("new_at").isNotNull()
    out = met.withColumn("user_label", F.when(seen, F.col("new_label")).otherwise(F.col("user_label"))).withColumn("labelled_at", F.coalesce("new_at", "labelled_at"))
    return out.drop("new_label", "new_at")


def file_tiers(files: DataFrame, flagged: DataFrame, entry: Column) -> DataFrame:
    """Flagged files, then entry and configuration files, both in path order, then the rest from small to large."""
    met = files.join(flagged.select("path").distinct().withColumn("flagged", F.lit(True)), "path", "left")
    tier = F.when(F.col("flagged"), 1).when(entry, 2).otherwise(3)
    return met.withColumn("tier", tier).drop("flagged").orderBy("tier", F.when(F.col("tier") == 3, F.col("size")), "path")


def requirement_order(df: DataFrame, column: str = "req_id") -> DataFrame:
    """V1.2.10 after V1.2.9."""
    numbers = F.transform(F.regexp_extract_all(column, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("long"))
    return df.orderBy(numbers, column)


def memory_page(memories: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """Severity by letters, as stored, then newest first."""
    return memories.orderBy("severity", F.desc("created_at"), "id").offset(offset).limit(size)


def average_score(scores: Column) -> Column:
    """Rounded mean of a map's values; null for an empty one."""
    v = F.map_values(scores)
    return F.when(F.size(v) > 0, F.floor(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v) + 0.5))


def tier_counts(findings: DataFrame) -> DataFrame:
    """Provenance tiers that occur, untagged among them."""
    tier = F.when(text(F.col("provenance")) == "", "untagged").otherwise(F.col("provenance"))
    return findings.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n")).orderBy("tier")


def skip_pack(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order that still fit what is left of the budget; those that do not are passed over."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("size_"))))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size_"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["size_"]).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(fits)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))
    packed = df.groupBy(*keys).agg(rows.alias("rows_")).withColumn("fits_", F.aggregate("rows_", start, step, lambda a: a["out"]))
    return packed.select(*keys, F.explode(F.arrays_zip("rows_", "fits_")).alias("z")).filter("z.fits_").select(*keys, "z.rows_.*").withColumnRenamed("size_", size)


def statements(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines joined while their round brackets are open: (keys, line_num of the first, statement)."""
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    w = Window.partitionBy(*keys).orderBy("line_num")
    open_before = F.coalesce(F.sum(count("(") - count(")")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumn("first_", F.when(open_before <= 0, F.col("line_num")))
    grouped = marked.withColumn("start_", F.last("first_", ignorenulls=True).over(w))
    made = grouped.groupBy(*keys, "start_").agg(F.sort_array(F.collect_list(F.struct("line_num", "line"))).alias("l"))
    return made.select(*keys, F.col("start_").alias("line_num"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("statement"))


def excerpts(lines: DataFrame, findings: DataFrame, keys: list[str], reach: int = 10, head: int = 30) -> DataFrame:
    """The lines around each finding of a file, each once; the first lines where all findings are at the top."""
    at = findings.select(*keys, F.col("line_num").alias("at"))
    top = at.groupBy(*keys).agg((F.max(F.coalesce("at", F.lit(0))) <= 1).alias("top"))
    wanted = at.join(top, keys).select(*keys, F.explode(F.when(F.col("top"), F.sequence(F.lit(1), F.lit(head))).otherwise(F.sequence(F.greatest(F.lit(1), F.col("at") - reach), F.greatest(F.lit(1), F.col("at")) + reach))).alias("line_num"))
    return lines.join(wanted.distinct(), [*keys, "line_num"])


def retry_budget(attempts: DataFrame, keys: list[str], credit: float = 0.1, most: float = 10.0) -> DataFrame:
    """Attempts (keys, seq, is_retry) in order: each adds a credit up to a cap, a retry spends one and is denied without it."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = most, []
        for r in pdf.sort_values("seq").to_dict("records"):
            granted = not r["is_retry"] or held >= 1
            held = min(most, held + credit) - (1 if r["is_retry"] and granted else 0)
            out.append((*(r[k] for k in keys), r["seq"], granted))
        return pd.DataFrame(out, columns=[*keys, "seq", "granted"])

    kinds = dict(attempts.dtypes)
    return attempts.groupBy(*keys).applyInPandas(fold, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"seq {kinds['seq']}", "granted boolean"]))


def provenance(source: Column, status: Column, verified: Column) -> Column:
    """Tier of a finding by where it came from; a model's finding that kept a verdict is a verified one."""
    tiers = {"signature:trusted": "signature_trusted", "signature:candidate": "signature_candidate", "catalog:": "catalog_rollup", "llm:": "llm"}
    base = lookup(F.concat_ws(":", source, text(status)), tiers, "skill")
    return F.when((base == "llm") & verified, "llm_l5_verified").otherwise(base)
