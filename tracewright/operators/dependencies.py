"""Dependencies: manifest readers, versions, and the version-range join with known vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of


def version(v: Column) -> Column:
    """Leading numbers of the parts of a version; parts without one are 0. Arrays compare as versions do."""
    return F.transform(F.split(F.trim(v), r"[.+-]"), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"^([0-9]{1,9})", 1), F.lit("999999999")).cast("int"), F.lit(0)))


def meets(installed: Column, spec: Column) -> Column:
    """Whether a version meets every comma-joined part of a spec (<, <=, ==, !=, >, >=, ~=)."""

    def part(p: Column) -> Column:
        op, v = F.regexp_extract(F.trim(p), r"^(<=|>=|==|!=|~=|<|>)", 1), version(F.regexp_replace(F.trim(p), r"^(<=|>=|==|!=|~=|<|>)\s*", ""))
        have = version(installed)
        head = F.greatest(F.size(v) - 1, F.lit(1))
        compatible = (have >= v) & (F.slice(have, F.lit(1), head) == F.slice(v, F.lit(1), head))
        return F.when(op == "<", have < v).when(op == "<=", have <= v).when(op == ">", have > v).when(op == ">=", have >= v).when(op == "!=", have != v).when(op == "~=", compatible).otherwise(have == v)

    return F.forall(F.split(spec, ","), part)


def vulnerable(dependencies: DataFrame, known: DataFrame) -> DataFrame:
    """Dependencies with a known vulnerability of their version: an equi-join on the package, then the range."""
    return dependencies.join(known, ["ecosystem", "name"]).filter(meets(F.col("version"), F.col("version_spec")))


def unpinned_rollup(dependencies: DataFrame) -> DataFrame:
    """One row per manifest with unpinned dependencies: count, line range, names in order."""
    loose = dependencies.filter(F.coalesce("version", F.lit("")).rlike(r"^$|^[\^~>*]|^latest$"))
    return loose.groupBy("file").agg(F.count(F.lit(1)).alias("instance_count"), F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def read_requirements(files: DataFrame) -> DataFrame:
    lines = lines_of(files.filter(F.col("name").rlike(r"^requirements.*\.txt$")), "path", text="content")
    p = r"^\s*([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([A-Za-z0-9_.*+!-]+))?"
    name = F.regexp_extract("line", p, 1)
    out = lines.select(F.col("path").alias("file"), F.lit("python").alias("ecosystem"), name.alias("name"), F.regexp_extract("line", p, 3).alias("version"), F.col("line_num").alias("line"))
    return out.filter((F.col("name") != "") & ~F.col("name").startswith("-"))


def read_package_json(files: DataFrame) -> DataFrame:
    some = files.filter("name = 'package.json'").select(F.col("path").alias("file"), F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = F.map_zip_with(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("j.devDependencies", F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(a, b))
    return some.select("file", F.lit("node").alias("ecosystem"), F.explode(both).alias("name", "version"), F.lit(None).cast("int").alias("line"))


def read_go_mod(files: DataFrame) -> DataFrame:
    """Single requirements and require ( ... ) blocks; a block is a running flag over the file's lines."""
    lines = lines_of(files.filter("name = 'go.mod'"), "path", text="content")
    edge = F.when(F.col("line").rlike(r"^\s*require\s*\("), True).when(F.col("line").rlike(r"^\s*\)"), False)
    inside = F.coalesce(F.last(edge, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_num")), F.lit(False))
    p = r"^\s*(?:require\s+)?([^\s()]+)\s+(v[0-9][^\s]*)"
    some = lines.withColumn("inside", inside).filter(F.col("inside") | F.col("line").rlike(r"^\s*require\s+[^\s(]"))
    out = some.select(F.col("path").alias("file"), F.lit("go").alias("ecosystem"), F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("version"), F.col("line_num").alias("line"))
    return out.filter("name <> ''")


#: Line patterns of the other manifests: file name, ecosystem, pattern of (name, version).
LINE_MANIFESTS = [
    ("Cargo.toml", "rust", r"^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{.*version\s*=\s*)?\"([^\"]+)\""),
    ("Gemfile", "ruby", r"^\s*gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?"),
    ("composer.json", "php", r"^\s*\"([a-z0-9_.-]+/[a-z0-9_.-]+)\"\s*:\s*\"([^\"]+)\""),
    ("pom.xml", "java", r"<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?"),
    ("pubspec.yaml", "dart", r"^\s{2}([a-z0-9_]+):\s*(\^?[0-9][^\s]*)"),
]


def read_manifests(files: DataFrame) -> DataFrame:
    """SRC11, SRC12: (file, ecosystem, name, version, line) of every known manifest."""
    out = read_requirements(files).unionByName(read_package_json(files)).unionByName(read_go_mod(files))
    for name, ecosystem, p in LINE_MANIFESTS:
        lines = lines_of(files.filter(F.col("name") == name), "path", text="content")
        found = lines.select(F.col("path").alias("file"), F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("version"), F.col("line_num").alias("line"))
        out = out.unionByName(found.filter("name <> ''"))
    return out


def by_ecosystem(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("ecosystem").agg(F.sort_array(F.collect_set("name")).alias("names"))
