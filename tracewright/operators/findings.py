"""The relational pipeline over findings: suppression, deduplication, roll-up, merging, voting, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DETAIL_RANK, ROLLUP_RANK, SCORE_WEIGHT, clamp, lookup, memory_title, rollup_id, rollup_title, round1, text

#: Findings that one suppression rule may silence.
SUPPRESSION_QUOTA = 50
#: What each further agent that reports a finding adds to its confidence, and the most they add.
AGENT_BOOST, MOST_BOOST = 0.10, 0.30

CHECKS = "array<struct<id:string,result:string,weight:double,reason:string>>"


def suppress(findings: DataFrame, rules: DataFrame, order: list[str]) -> DataFrame:
    """FLT8: findings that no rule (rule_ord, title_pattern, path_pattern) silences. Each finding falls to its first
    matching rule; a rule silences its first SUPPRESSION_QUOTA findings in ``order``. Rules are a small table."""
    hit = F.rlike("title", F.col("title_pattern")) & F.rlike("path", F.col("path_pattern"))
    matched = findings.join(rules, hit).groupBy("id").agg(F.min("rule_ord").alias("rule_ord"))
    placed = findings.join(matched, "id", "left")
    rank = F.row_number().over(Window.partitionBy("rule_ord").orderBy(*order))
    silenced = placed.filter(F.col("rule_ord").isNotNull()).withColumn("rn", rank).filter(F.col("rn") <= SUPPRESSION_QUOTA).select("id")
    return findings.join(silenced, "id", "left_anti")


def downgrade_in_tests(findings: DataFrame) -> DataFrame:
    """FLT6: one severity lower for findings in test paths."""
    lower = {"critical": "high", "high": "medium", "medium": "low", "low": "info", "info": "info"}
    test = F.col("path").rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_|[._](test|spec)\.")
    return findings.withColumn("severity", F.when(test, lookup(F.col("severity"), lower, "info")).otherwise(F.col("severity")))


def dedup_key(check_id: Column, title: Column, path: Column) -> Column:
    """Findings with a check id and findings without one have disjoint keys."""
    with_id = F.concat_ws("|", F.lit("id"), check_id, text(path))
    return F.when(text(check_id) != "", with_id).otherwise(F.concat_ws("|", F.lit("title"), memory_title(title), text(path)))


def new_findings(candidates: DataFrame, known: DataFrame, order: list) -> DataFrame:
    """Candidates whose key no known finding has, first of each key in ``order``."""
    keyed = candidates.withColumn("key", dedup_key(F.col("check_id"), F.col("title"), F.col("path")))
    taken = known.select(dedup_key(F.col("check_id"), F.col("title"), F.col("path")).alias("key")).distinct()
    fresh = keyed.join(taken, "key", "left_anti")
    return keep_first(fresh, ["key"], order).drop("key")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def distinct_latest(df: DataFrame, keys: list[str], latest: str, most: int | None = None) -> DataFrame:
    """DISTINCT ON: the latest row of each key, limited in the order of the keys and not of time."""
    out = keep_first(df, keys, [F.col(latest).desc_nulls_last()])
    return out.orderBy(*keys).limit(most) if most is not None else out


def rollup(findings: DataFrame, audit: str = "audit") -> DataFrame:
    """A1: a parent per (category, normal title, path) with two members or more: line range, highest severity, first
    title in ``ord``, member ids in order, count."""
    rank = lookup(F.col("severity"), ROLLUP_RANK, 0)
    norm = rollup_title(F.col("title"))
    groups = findings.withColumn("norm_title", norm).groupBy("category", "norm_title", "path").agg(
        F.min("line_num").alias("line_start"), F.max("line_num").alias("line_end"), F.max_by("severity", F.struct(rank, "severity")).alias("severity"),
        F.count(F.lit(1)).alias("instance_count"), F.min_by("title", "ord").alias("title"), F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("members"),
    )
    made = groups.filter("instance_count >= 2").withColumn("id", rollup_id(F.lit(audit), F.col("category"), F.col("norm_title"), F.col("path")))
    return made.withColumn("members", F.transform("members", lambda m: m["id"]))


def mark_rolled_up(findings: DataFrame, parents: DataFrame) -> DataFrame:
    """Members get their parent's id in ``rolled_up_into``."""
    links = parents.select(F.explode("members").alias("id"), F.col("id").alias("rolled_up_into"))
    return findings.join(links, "id", "left")


#: What a finding's parts count beside ten times its severity's rank.
SNIPPET_SCORE, HINTS_SCORE, CHECK_SCORE, ROLLUP_SCORE = 3, 2, 1, 1_000_000


def detail_score(is_rollup: Column, severity: Column, n_references: Column, snippet: Column, n_hints: Column, check_id: Column) -> Column:
    """How much a finding tells: parents first, then severity, references, a snippet, hints and a check id."""
    filled = lambda c: text(c) != ""
    extra = F.when(filled(snippet), SNIPPET_SCORE).otherwise(0) + F.when(n_hints > 0, HINTS_SCORE).otherwise(0) + F.when(filled(check_id), CHECK_SCORE).otherwise(0)
    return F.when(is_rollup, ROLLUP_SCORE).otherwise(lookup(severity, DETAIL_RANK, 0) * 10 + F.coalesce(n_references, F.lit(0)) + extra)


def merge_agents(findings: DataFrame, score: Column, family: str = "family") -> DataFrame:
    """A2: one finding per (family, else lower title; path; line): the highest score, first in ``ord`` on ties, with the
    other agents that reported it and the confidence they add. A provenance that is empty is taken from the last that is not."""
    key = F.when(text(F.col(family)) != "", F.col(family)).otherwise(F.lower("title"))
    keyed = findings.withColumn("key", F.concat_ws("|", key, "path", F.greatest(F.coalesce("line_num", F.lit(0)), F.lit(1)).cast("string"))).withColumn("score", score)
    by_key = keyed.groupBy("key").agg(
        F.min_by(F.struct(*findings.columns), F.struct(-F.col("score"), F.col("ord"))).alias("best"), F.sort_array(F.collect_set("agent_type")).alias("agents"),
        F.max_by("provenance", F.when(text(F.col("provenance")) != "", F.col("ord"))).alias("last_provenance"),
    )
    others = F.array_remove("agents", F.col("best.agent_type"))
    out = by_key.select("best.*", others.alias("cross_agent_origins"), F.round(F.least(F.lit(MOST_BOOST), AGENT_BOOST * F.size(others)), 2).alias("boost"), "last_provenance")
    return out.withColumn("provenance", F.when(text(F.col("provenance")) == "", F.col("last_provenance")).otherwise(F.col("provenance"))).drop("last_provenance")


def vote(checks: Column) -> Column:
    """A3: struct(status, confidence) of an array of checks, in their order."""
    total = F.aggregate(checks, F.lit(0.5), lambda a, c: a + c["weight"])
    conf = clamp(F.round(total, 9), 0.0, 1.0)
    authoritative = F.exists(checks, lambda c: (c["id"] == "suppression") & (c["weight"] < 0))
    demotions = F.size(F.filter(checks, lambda c: c["weight"] < 0))
    low = F.least(conf, F.lit(0.05))
    status = F.when(authoritative, "likely_fp").when((conf < 0.30) & (demotions >= 2), "likely_fp").when(conf < 0.55, "suspicious").otherwise("high_confidence")
    return F.struct(status.alias("status"), F.when(authoritative, low).otherwise(conf).alias("confidence"))


def vote_rows(checks: DataFrame, key: str = "finding_id") -> DataFrame:
    """A3 over exploded checks (key, pos, id, weight): (key, status, confidence). Sums meet before the shuffle."""
    per = checks.groupBy(key).agg(
        F.sum("weight").alias("w"), F.count_if(F.col("weight") < 0).alias("demotions"), F.max((F.col("id") == "suppression") & (F.col("weight") < 0)).alias("authoritative")
    )
    conf = clamp(F.round(F.col("w") + 0.5, 9), 0.0, 1.0)
    auth = F.coalesce("authoritative", F.lit(False))
    status = F.when(auth, "likely_fp").when((conf < 0.30) & (F.col("demotions") >= 2), "likely_fp").when(conf < 0.55, "suspicious").otherwise("high_confidence")
    return per.select(key, status.alias("status"), F.when(auth, F.least(conf, F.lit(0.05))).otherwise(conf).alias("confidence"))


def path_check(path: Column) -> Column:
    """L1: weight of where a finding stands."""
    demoted = path.rlike(r"(^|/)(tests?|examples?|docs?|fixtures?|vendor|node_modules)/")
    return F.when(demoted, -0.20).when(path.rlike(r"(^|/)(src|app|lib|server|api)/"), 0.10).otherwise(0.0)


def context_checks(lines: DataFrame, keys: list[str], marker: str, sanitizer: str) -> DataFrame:
    """L1: per line whether a suppression marker stands in the two lines before or on it, and a sanitizer in the last 20."""
    w = Window.partitionBy(*keys).orderBy("line_num")
    line = F.col("line")
    return lines.withColumns({"suppressed": F.max(line.rlike(marker)).over(w.rowsBetween(-2, 0)), "sanitized": F.max(line.rlike(sanitizer)).over(w.rowsBetween(-20, 0))})


def apply_labels(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """The latest label (fingerprint, user_label, labelled_at, id) of a fingerprint: +0.40 for tp, -0.40 for fp."""
    last = labels.groupBy("fingerprint").agg(F.max_by("user_label", F.struct("labelled_at", "id")).alias("user_label"))
    weight = F.when(F.col("user_label") == "tp", 0.40).when(F.col("user_label") == "fp", -0.40).otherwise(0.0)
    return findings.join(last, "fingerprint", "left").withColumn("label_weight", weight)


def compliance_score(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A4: (keys, n, penalty, score) with score = round1(max(5, 100 / (1 + penalty / max(30, 10 n))))."""
    per = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(lookup(F.col("severity"), SCORE_WEIGHT, 0.0)).alias("penalty"))
    raw = F.greatest(F.lit(5.0), 100.0 / (1 + F.col("penalty") / F.greatest(F.lit(30), F.col("n") * 10)))
    return per.withColumn("score", round1(raw))


def judge_selection(findings: DataFrame, most: int = 1000, per_batch: int = 10) -> DataFrame:
    """Findings for a further verdict by rank * (1 - confidence), ties by rank then id, in batches."""
    rank = lookup(F.col("severity"), DETAIL_RANK, 1)
    open_ = findings.filter((F.col("validation_status") != "likely_fp") & (text(F.col("snippet")) != ""))
    scored = open_.withColumn("priority", F.round(rank * (1 - F.col("confidence")) + 1e-6 * rank, 9))
    top = scored.orderBy(F.desc("priority"), "id").limit(most)
    return top.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(F.desc("priority"), "id")) - 1) / per_batch))


#: Weaknesses whose demotions a single verdict may not make.
GUARDED = [326, 327, 328, 330, 798, 319]


def demotion_safeguard(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Demotions are frozen where three or more were judged and over half demoted, unless all agree and none is
    deterministic; else those on guarded weaknesses and deterministic findings are neutral. Adds ``kept_demotion``."""
    per = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("judged"), F.count_if("demoted").alias("n_demoted"), F.max("deterministic").alias("any_deterministic"))
    frozen = (F.col("judged") >= 3) & (F.col("n_demoted") * 2 > F.col("judged")) & ~((F.col("n_demoted") == F.col("judged")) & ~F.col("any_deterministic"))
    joined = judged.join(per.select(*keys, frozen.alias("frozen")), keys)
    guarded = F.col("weakness").isin(GUARDED) | F.col("deterministic")
    return joined.withColumn("kept_demotion", F.col("demoted") & ~F.col("frozen") & ~guarded)


def compliance_mode(findings: DataFrame) -> DataFrame:
    """Nothing is dropped: likely false positives become suspicious with at least 0.40."""
    fp = F.col("validation_status") == "likely_fp"
    return findings.withColumn("confidence", F.when(fp, F.greatest("confidence", F.lit(0.40))).otherwise(F.col("confidence"))).withColumn("validation_status", F.when(fp, "suspicious").otherwise(F.col("validation_status")))


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page with total, has_more and next_offset. The page is a top-k; the total is one counted row."""
    top = df.orderBy(*order).limit(offset + size).withColumn("rn", F.row_number().over(Window.orderBy(*order))).filter(F.col("rn") > offset)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    more = F.col("total") > offset + size
    return top.crossJoin(F.broadcast(total)).withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + size))})


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """FLT9: conjunction of the filters that are given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching (start, end) ranges merged: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    high = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = ranges.withColumn("high", high).withColumn("island", F.sum(F.when(F.col("high").isNull() | (F.col("start") > F.col("high")), 1).otherwise(0)).over(w))
    return cut.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def greedy_batches(df: DataFrame, keys: list[str], order: list, size: str, most_size: int, most_rows: int = 40) -> DataFrame:
    """Rows of a key packed in order; a batch ends when the next row would pass ``most_size`` or ``most_rows``."""
    fields = F.sort_array(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("size_"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("b"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & ((acc["s"] + x["size_"] > most_size) | (acc["n"] >= most_rows))
        b = acc["b"] + new.cast("long")
        return F.struct(
            F.when(new, 1).otherwise(acc["n"] + 1).cast("long").alias("n"), F.when(new, x["size_"]).otherwise(acc["s"] + x["size_"]).alias("s"), b.alias("b"), F.concat(acc["out"], F.array(b)).alias("out")
        )

    packed = df.groupBy(*keys).agg(fields.alias("rows_")).withColumn("batches_", F.aggregate("rows_", start, step, lambda a: a["out"]))
    pairs = packed.select(*keys, F.explode(F.arrays_zip("rows_", "batches_")).alias("z"))
    return pairs.select(*keys, "z.rows_.*", F.col("z.batches_").alias("batch")).withColumnRenamed("size_", size)
