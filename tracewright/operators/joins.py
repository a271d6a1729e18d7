"""Joins, set operations and projections between audits, sources, findings, lineage and model output."""

from __future__ import annotations

import json
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text


def audits_with_sources(audits: DataFrame, sources: DataFrame) -> DataFrame:
    """Every audit with the name and path of its source, if it has one."""
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("path").alias("source_path"))
    return audits.join(named, "source_id", "left")


def audits_of_path(audits: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Audits whose source stands at a path."""
    return audits.join(sources.filter(F.col("path") == path).select(F.col("id").alias("source_id")), "source_id", "left_semi")


def lineage_of_audit(lineage: DataFrame, findings: DataFrame, audit: str) -> DataFrame:
    """Lineage rows that an audit's findings touch, each once."""
    return lineage.join(findings.filter(F.col("audit_id") == audit).select("fingerprint", "agent_type").distinct(), ["fingerprint", "agent_type"], "left_semi")


def fill_fingerprints(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Results without a fingerprint take that of their finding."""
    known = findings.groupBy(F.col("id").alias("finding_id")).agg(F.min("fingerprint").alias("known"))
    filled = F.when(text(F.col("fingerprint")) == "", F.col("known")).otherwise(F.col("fingerprint"))
    return results.join(known, "finding_id", "left").withColumn("fingerprint", filled).drop("known")


def suffix_join(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the longest file path that ends theirs at a segment border. Every number of segments that a
    file has is tried by an equi-join on the tail of that length, so no pair of paths is compared."""
    parts = F.split("path", "/")
    tails = findings.select("id", F.size(parts).alias("n"), parts.alias("p")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    tails = tails.select("id", "k", F.array_join(F.slice("p", F.col("n") - F.col("k") + 1, F.col("k")), "/").alias("file"))
    met = tails.join(files.select(F.col("path").alias("file")).distinct(), "file")
    return findings.join(met.groupBy("id").agg(F.max_by("file", "k").alias("file")), "id", "left")


def enrich_with_lineage(findings: DataFrame, lineage: DataFrame) -> DataFrame:
    """Findings with what is known of their fingerprint: status, first sight and how often it was seen; ``new`` where it is unknown."""
    known = lineage.groupBy("fingerprint").agg(F.max_by("current_status", "latest_found_at").alias("status"), F.min("first_found_at").alias("first_found_at"), F.sum("n_seen").alias("n_seen"))
    met = findings.join(known, "fingerprint", "left")
    return met.withColumn("status", F.coalesce("status", F.lit("new"))).withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))


def all_findings(*parts: DataFrame) -> DataFrame:
    """Findings of rules, models and roll-ups in one table; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ordered_distinct(values: Column) -> Column:
    """Strings in the order of their first sight, without empty ones."""
    return F.array_distinct(F.filter(values, lambda v: text(v) != ""))


def with_required(types: Column, needed: str, by: str) -> Column:
    """A list of types with ``needed`` put first where ``by`` asks for it and it is missing."""
    return F.when(F.array_contains(types, by) & ~F.array_contains(types, needed), F.concat(F.array(F.lit(needed)), types)).otherwise(types)


def split_deferred(types: Column, deferred: str) -> Column:
    """struct(now, later) of a list of types: those to run at once, and whether the deferred one follows."""
    return F.struct(F.array_remove(types, deferred).alias("now"), F.array_contains(types, deferred).alias("later"))


def new_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses that were not known, each once."""
    return found.select("url").distinct().join(known.select("url").distinct(), "url", "left_anti")


def embedding_text(title: Column, content: Column, category: Column, severity: Column, reference: Column, paths: Column) -> Column:
    """The text that stands for a memory when it is embedded."""
    more = F.when(text(reference) != "", F.concat(F.lit("Compliance: "), reference))
    files = F.when(F.size(F.coalesce(paths, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Files: "), F.array_join(paths, ", ")))
    return F.concat_ws("\n", text(title), text(content), F.concat(F.lit("Category: "), text(category)), F.concat(F.lit("Severity: "), text(severity)), more, files)


def listed_audits(audits: DataFrame) -> DataFrame:
    """FLT16: audits as lists show them, without their findings but with their number."""
    return audits.withColumn("findings_count", F.size(F.coalesce("findings", F.array().cast("array<string>")))).drop("findings")


def prior_findings(findings: DataFrame) -> DataFrame:
    """FLT16: what a later run is told of earlier findings."""
    return findings.select("fingerprint", "title", "severity", "path", "check_id")


def context_savings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lines, distinct_lines, saved_tokens): what leaving out repeated lines saves, at a quarter token a character."""
    per = lines.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"))
    saved = F.sum(F.length("line") * (F.col("n") - 1))
    return per.groupBy(*keys).agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("distinct_lines"), F.floor(saved / 4).alias("saved_tokens"))


def missing_artefacts(files: DataFrame, required: dict[str, list[str]], tree: str = "source") -> DataFrame:
    """(tree, practice) of practices of which a tree holds no artefact, under any of their names: a distinct of names
    per tree and an anti join against a table of practices."""
    spark = files.sparkSession
    names = spark.createDataFrame([(p, n.lower()) for p, ns in required.items() for n in ns], "practice string, name string")
    held = files.select(tree, F.lower(F.element_at(F.split("path", "/"), -1)).alias("name")).distinct()
    wanted = held.select(tree).distinct().withColumn("practice", F.explode(F.array(*map(F.lit, required))))
    return wanted.join(held.join(names, "name").select(tree, "practice").distinct(), [tree, "practice"], "left_anti")


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against its page by RFC 3986; null where it leaves the page's host or is no web address."""

    def one(b: str | None, v: str | None) -> str | None:
        if not b or not v:
            return None
        try:
            made = urljoin(b, v.strip())
            same = urlparse(made).hostname == urlparse(b).hostname and urlparse(made).scheme in ("http", "https")
        except ValueError:
            return None
        return made.partition("#")[0] if same else None

    return pd.Series([one(b, v) for b, v in zip(base, link)], dtype=object)


#: Levels of nesting that a walk of JSON goes down.
JSON_DEPTH = 20


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_paths(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Distinct sorted addresses among the values of a JSON text, down to JSON_DEPTH levels: paths, and addresses of the base's host."""

    def walk(v, host: str | None, depth: int, out: set) -> None:
        if depth > JSON_DEPTH:
            return
        if isinstance(v, dict | list):
            for x in v.values() if isinstance(v, dict) else v:
                walk(x, host, depth + 1, out)
        elif isinstance(v, str) and v.startswith("/") and not v.startswith("//"):
            out.add(v)
        elif isinstance(v, str) and v.startswith(("http://", "https://")):
            parts = urlparse(v)
            if parts.hostname == host:
                out.add(parts.path or "/")

    def one(r: str | None, b: str | None) -> list[str]:
        out: set[str] = set()
        try:
            walk(json.loads(r or ""), urlparse(b or "").hostname, 0, out)
        except (ValueError, RecursionError):
            return []
        return sorted(out)

    return pd.Series([one(r, b) for r, b in zip(raw, base)], dtype=object)


def _balanced(raw: str) -> str | None:
    """The first object or array of a text whose brackets balance outside of strings, if it is JSON."""
    for start, c in enumerate(raw):
        if c not in "{[":
            continue
        depth, quoted, escaped = 0, False, False
        for end in range(start, len(raw)):
            x = raw[end]
            if quoted:
                escaped, quoted = (x == "\\" and not escaped), not (x == '"' and not escaped)
            elif x == '"':
                quoted = True
            elif x in "{[":
                depth += 1
            elif x in "}]":
                depth -= 1
                if not depth:
                    try:
                        json.loads(raw[start : end + 1])
                    except ValueError:
                        break
                    return raw[start : end + 1]
    return None


@F.pandas_udf(T.StringType())
def extracted_json(raw: pd.Series) -> pd.Series:
    """The JSON within a model's answer: fences and talk around it are left out; null if there is none."""
    return pd.Series([_balanced(r) if r else None for r in raw], dtype=object)


def verdict_updates(batches: DataFrame) -> DataFrame:
    """ST6: a batch of verdicts as single replacements: (run_id, seq, item, field, value). Works on a stream as on a table."""
    each = batches.select("run_id", "seq", F.explode("verdicts").alias("v"))
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"v.{f}").cast("string").alias("value")) for f in ("status", "confidence")))
    return each.select("run_id", "seq", F.col("v.id").alias("item"), F.explode(fields).alias("f")).select("run_id", "seq", "item", "f.*").filter("value IS NOT NULL")


def weakness_tap(findings: DataFrame, bridge: DataFrame, deferred: str = "owasp") -> DataFrame:
    """ST7: findings with a weakness, once more under each category of the deferred agent that holds it, after the others."""
    tapped = findings.filter(F.col("weakness").isNotNull()).join(bridge, "weakness")
    tapped = tapped.select("id", F.lit(deferred).alias("agent_type"), "weakness", F.col("category_id").alias("category"), F.lit(2).alias("phase"))
    return findings.select("id", "agent_type", "weakness", F.lit(None).cast("string").alias("category"), F.lit(1).alias("phase")).unionByName(tapped)
