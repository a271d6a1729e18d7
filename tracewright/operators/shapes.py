"""The shapes of detection: every detector is data for one of these operators.

All take a table of lines (keys, line_num, line), scan it once, and share one
exchange on the document key where they need a window.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import is_set, masks

#: Longest part of a line that signature patterns see.
LINE_CAP = 600


@dataclass(frozen=True)
class Rule:
    """A line pattern. ``hint`` is a lower-case literal without which the pattern cannot match."""

    check_id: str
    pattern: str
    severity: str = "medium"
    category: str = ""
    title: str = ""
    weakness: int = 0
    languages: tuple[str, ...] = ()
    hint: str = ""
    safe: str = ""
    group: str = ""
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def fires(self, line: Column, ext: Column | None = None, lowered: Column | None = None) -> Column:
        cheap = F.lit(True)
        if self.languages and ext is not None:
            cheap = cheap & ext.isin(*self.languages)
        if self.hint:
            cheap = cheap & (F.lower(line) if lowered is None else lowered).contains(self.hint)
        hit = cheap & line.rlike(self.pattern)
        return hit & ~line.rlike(self.safe) if self.safe else hit

    def row(self) -> Column:
        cells = {"check_id": self.check_id, "severity": self.severity, "category": self.category or self.check_id, "title": self.title or self.check_id, "weakness": self.weakness}
        return F.struct(*(F.lit(v).alias(k) for k, v in cells.items()))


#: Lines that no rule looks at: comments and imports.
COMMENT = r"^\s*(#|//|\*|/\*|--|<!--)"
IMPORT = r"^\s*(import |from [A-Za-z0-9_.]+ import |#include|require\(|use [a-z_]+::)"


def code_lines(lines: DataFrame) -> DataFrame:
    """FLT1: once, before any rule."""
    return lines.filter(~F.col("line").rlike(COMMENT) & ~F.col("line").rlike(IMPORT))


def _fired(lines: DataFrame, rules: list[Rule], ext: str | None) -> tuple[DataFrame, Column, list[str]]:
    """Lines, an array of a struct per rule (null where it does not fire; a null array where none does), and the columns to
    drop. A pattern is tried only on lines that hold its literals."""
    e = F.col(ext) if ext else None
    found = masks(F.col("line"), F.col("lowered_"), [(r.pattern, r.fires(F.col("line"), e, F.col("lowered_"))) for r in rules])
    names = [f"fired_{k}" for k in range(len(found))]
    flagged = lines.withColumn("lowered_", F.lower("line")).withColumns(dict(zip(names, found)))
    # No filter: it would be pushed down to the lines, with a copy of all tests, each with its own lower().
    hits = F.array(*(F.when(is_set(i, "fired_"), r.row()) for i, r in enumerate(rules)))
    return flagged, F.when(reduce(Column.__or__, (F.col(n) != 0 for n in names)), hits), ["lowered_", *names]


def line_rules(lines: DataFrame, rules: list[Rule], ext: str | None = None) -> DataFrame:
    """A row per line and rule that fires. Rules are literals of one projection, so lines are read once."""
    seen, hits, more = _fired(lines, rules, ext)
    return seen.withColumn("hit", F.explode(F.array_compact(hits))).drop(*more).select("*", "hit.*").drop("hit")


def first_match(lines: DataFrame, rules: list[Rule], ext: str | None = None) -> DataFrame:
    """FLT2: per line the first rule of the list that fires."""
    seen, hits, more = _fired(lines, rules, ext)
    return seen.withColumn("hit", F.explode(F.slice(F.array_compact(hits), 1, 1))).drop(*more).select("*", "hit.*").drop("hit")


def grep(lines: DataFrame, keys: list[str], pattern: str, most: int = 500, cap: int = 2000) -> DataFrame:
    """SRC10: first match per line of a pattern of at most 1000 characters, in total order, ``most`` lines."""
    if len(pattern) > 1000:
        raise ValueError("pattern is longer than 1000 characters")
    seen = F.substring("line", 1, cap)
    found = lines.filter(seen.rlike(pattern)).withColumn("match", F.regexp_extract(seen, pattern, 0))
    return found.orderBy(*keys, "line_num").limit(most)


def _frame(keys: list[str], low: int, high: int):
    return Window.partitionBy(*keys).orderBy("line_num").rowsBetween(low, high)


def near(flag: Column, keys: list[str], low: int, high: int) -> Column:
    """Whether the flag holds on any line of the frame; false for an empty frame."""
    return F.coalesce(F.max(flag).over(_frame(keys, low, high)), F.lit(False))


def window_suppressed(lines: DataFrame, keys: list[str], pattern: str, safe: str, reach: int) -> DataFrame:
    """Lines that match with no safe line within ``reach`` lines around."""
    line = F.col("line")
    return lines.withColumn("covered", near(line.rlike(safe), keys, -reach, reach)).filter(line.rlike(pattern) & ~F.col("covered")).drop("covered")


def directional(lines: DataFrame, keys: list[str], pattern: str, other: str, low: int, high: int, required: bool = True) -> DataFrame:
    """Lines that match with (or without) another match between ``low`` and ``high`` lines away."""
    line = F.col("line")
    found = lines.withColumn("near", near(line.rlike(other), keys, low, high)).filter(line.rlike(pattern))
    return found.filter(F.col("near") if required else ~F.col("near")).drop("near")


def same_name_pairs(first: DataFrame, second: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """P3 on one variable: pairs (first, second) of one ``name`` at most ``reach`` lines apart, second later."""
    b = second.select(*keys, "name", F.col("line_num").alias("second_line"))
    met = first.join(b, [*keys, "name"])
    return met.filter(F.col("second_line").between(F.col("line_num") + 1, F.col("line_num") + reach))


def signature(lines: DataFrame, keys: list[str], sink: str, source: str | None, sanitizer: str | None, reach: int = 8, require_source: bool = True) -> DataFrame:
    """The first sink per document with a source and without a sanitizer within ``reach`` lines."""
    line = F.substring("line", 1, LINE_CAP)
    has_source = near(line.rlike(source), keys, -reach, reach) if source and require_source else F.lit(True)
    clean = ~near(line.rlike(sanitizer), keys, -reach, reach) if sanitizer else F.lit(True)
    found = lines.withColumn("ok", has_source & clean).filter(F.col("ok") & line.rlike(sink)).drop("ok")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("line_num"))
    return found.withColumn("rn", first).filter("rn = 1").drop("rn")


def taint(assigned: DataFrame, sinks: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """P5: sinks (keys, name, pos) of a name assigned from a source at most ``reach`` positions before."""
    a = assigned.select(*keys, "name", F.col("pos").alias("a_pos"))
    met = [sinks[k] == a[k] for k in [*keys, "name"]]
    within = a.a_pos.between(sinks.pos - reach, sinks.pos - 1)
    cond = within
    for c in met:
        cond = cond & c
    return sinks.join(a, cond, "left_semi")


def presence_absence(lines: DataFrame, keys: list[str], present: str, absent: str) -> DataFrame:
    """Groups (files, or a whole tree) with one pattern and without another: (keys, line_num of the first)."""
    line = F.col("line")
    per = lines.groupBy(*keys).agg(F.min(F.when(line.rlike(present), F.col("line_num"))).alias("line_num"), F.max(line.rlike(absent)).alias("covered"))
    return per.filter(F.col("line_num").isNotNull() & ~F.col("covered")).drop("covered")


def required_absent(required: DataFrame, inventory: DataFrame, key: str = "name") -> DataFrame:
    """Required artefacts that the inventory lacks."""
    return required.join(inventory.select(key).distinct(), key, "left_anti")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def covers(mount: Column, route: Column) -> Column:
    """Whether a mount's segments are a prefix of a route's; ``*`` and ``:name`` match any segment."""
    same = F.zip_with(mount, F.slice(route, F.lit(1), F.size(mount)), lambda m, r: (m == "*") | m.startswith(":") | (m == r))
    return (F.size(mount) <= F.size(route)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def uncovered(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Routes (route) that no mount (mount) covers. Every mount is tried at its own depth by an equi-join
    where it has no wildcard; the few with wildcards are tried on what is left."""
    r = routes.withColumn("parts", segments(F.col("route")))
    m = mounts.withColumn("mount_parts", segments(F.col("mount")))
    wild = F.exists("mount_parts", lambda s: (s == "*") | s.startswith(":"))
    plain = m.filter(~wild).select(F.array_join("mount_parts", "/").alias("prefix")).distinct()
    prefixes = r.select("route", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("prefix"))
    met = prefixes.join(plain, "prefix", "left_semi").select("route").distinct()
    left = r.join(met, "route", "left_anti")
    return left.join(m.filter(wild), covers(F.col("mount_parts"), F.col("parts")), "left_anti").drop("parts")


def keyword_overlap(words: DataFrame, keywords: DataFrame, keys: list[str], least: int = 3, share: float = 0.6) -> DataFrame:
    """(keys, entry, matched, score) where distinct ``word``s meet ``least`` of an entry's keywords and ``share``
    of them all. ``keywords`` is (entry, word), an inverted index."""
    sizes = keywords.groupBy("entry").agg(F.countDistinct("word").alias("size"))
    # Joined first: words that no entry holds are never shuffled, and a group holds an entry's own words at most.
    met = words.select(*keys, "word").join(keywords.distinct(), "word").groupBy(*keys, "entry").agg(F.size(F.collect_set("word")).cast("long").alias("matched"))
    scored = met.filter(F.col("matched") >= least).join(sizes, "entry").withColumn("score", F.col("matched") / F.col("size"))
    return scored.filter(F.col("score") >= share).drop("size")


def ranked_quota(df: DataFrame, partition: list[str], order: list, most: int) -> DataFrame:
    """P9, FLT8: the first ``most`` rows of each partition in a total order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("rn") <= most).drop("rn")


def spans(df: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """P10: matches over whole contents, line ends included: (keys, span, offset, line_num of its start)."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = df.filter(t.rlike(pattern)).select(*keys, F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), t.alias("t"))
    cut = some.select(*keys, "t", "gaps", "found", F.posexplode("found").alias("k", "span"))
    before = lambda a, n: F.aggregate(F.slice(F.col(a), F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    placed = cut.withColumn("offset", before("gaps", F.col("k") + 1) + before("found", F.col("k")))
    upto = F.substring(F.col("t"), F.lit(1), F.col("offset"))
    return placed.select(*keys, "span", "offset", (F.length(upto) - F.length(F.replace(upto, F.lit("\n"), F.lit(""))) + 1).alias("line_num"))


def direct_recursion(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that call the function in whose indented body they stand. The scope of a line is the last definition
    of less indent before it; a definition of the same or less indent ends it."""
    define = r"^\s*(?:def|func|function)\s+([A-Za-z_][A-Za-z0-9_]*)"
    line = F.col("line")
    indent = F.length(F.regexp_extract(line, r"^(\s*)", 1))
    name = F.regexp_extract(line, define, 1)
    seen = lines.withColumns({"indent": indent, "name": F.when(name != "", name)})
    w = Window.partitionBy(*keys).orderBy("line_num").rowsBetween(Window.unboundedPreceding, -1)
    scope = F.last(F.when(F.col("name").isNotNull(), F.struct("name", "indent")), ignorenulls=True).over(w)
    inside = seen.withColumn("scope", scope).filter(F.col("scope").isNotNull() & (F.col("indent") > F.col("scope.indent")))
    called = F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    return inside.filter(F.array_contains(called, F.col("scope.name")) & F.col("name").isNull()).select(*keys, "line_num", "line", F.col("scope.name").alias("function"))


def corroborated(hits: DataFrame, lines: DataFrame, keys: list[str], context: str, lowered: str) -> DataFrame:
    """Hits keep their severity in files whose text has the context, else they get ``lowered``."""
    known = lines.groupBy(*keys).agg(F.max(F.col("line").rlike(context)).alias("in_context"))
    return hits.join(known, keys, "left").withColumn("severity", F.when(F.col("in_context"), F.col("severity")).otherwise(lowered)).drop("in_context")


def snippets(lines: DataFrame, keys: list[str], reach: int = 2, most: int = 200) -> DataFrame:
    """Every line with its numbered surroundings, cut to ``most`` characters."""
    numbered = F.concat(F.col("line_num").cast("string"), F.lit(": "), F.col("line"))
    return lines.withColumn("snippet", F.substring(F.array_join(F.collect_list(numbered).over(_frame(keys, -reach, reach)), "\n"), 1, most))
