"""Sources: files, path classifiers, ignore rules, external findings, taxonomies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lookup

#: Folders and files that no scan enters, and sizes it does not read past.
SKIPPED_FOLDERS = [".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "venv", "target", ".next", "coverage"]
SKIPPED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", "Cargo.lock"]
WELL_KNOWN = ["Dockerfile", "Makefile", "Jenkinsfile", ".env", ".gitlab-ci.yml"]
MOST_FILES, SOURCE_BYTES, MANIFEST_BYTES = 50_000, 512 << 10, 16 << 20

LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "sql": "sql", "sh": "shell", "yaml": "yaml", "yml": "yaml", "html": "html",
}
BASENAMES = {"dockerfile": "dockerfile", "makefile": "make", "jenkinsfile": "groovy", "gemfile": "ruby", "rakefile": "ruby"}
BACKUP = r"(?i)(~|\.(bak|old|orig|save|backup|swp)(\.[0-9]+)?)+$"


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """SRC1: (path, name, ext, size, content) of a tree of files; text is decoded with replacement, sizes are capped."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (read.option("pathGlobFilter", glob) if glob else read).load(root)
    return with_names(raw.filter(F.col("length") <= MANIFEST_BYTES).select("path", F.col("length").alias("size"), F.decode("content", F.lit("UTF-8")).alias("content")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def effective_name(name: Column) -> Column:
    """SRC4: a shadow copy's name without its markers."""
    return F.regexp_replace(name, BACKUP, "")


def is_backup(name: Column) -> Column:
    return name.rlike(BACKUP)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(effective_name(name), r"\.([A-Za-z0-9]+)$", 1))


def with_names(df: DataFrame) -> DataFrame:
    return df.withColumn("name", base_name(F.col("path"))).withColumn("ext", extension(F.col("name")))


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|spec|fixtures)/|(^|/)test_[^/]*$|[._](test|spec)\.[a-z]+$")


def is_minified(name: Column) -> Column:
    return name.rlike(r"(?i)\.min\.(js|css)$|[.-]bundle\.js$")


def is_generated(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(generated|gen)/|_pb2\.py$|\.pb\.go$|\.g\.dart$")


def is_entry_or_config(name: Column) -> Column:
    return name.rlike(r"(?i)^(main|app|index|server|settings|config|manage|wsgi)\.[a-z]+$|\.(ya?ml|toml|ini|env)$")


def language(path: Column) -> Column:
    """SRC8: by base name, then by extension, else unknown."""
    name = F.lower(base_name(path))
    return F.coalesce(lookup(name, BASENAMES), lookup(extension(name), LANGUAGES), F.lit("unknown"))


def scan(files: DataFrame, extensions: list[str], extra: list[str] | None = None, most: int = MOST_FILES) -> DataFrame:
    """SRC1, SRC2: files of the extensions or well-known names outside skipped folders; the first ``most`` in path
    order, with ``truncated`` telling whether there were more."""
    folders = F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1)), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    name = effective_name(F.col("name"))
    wanted = (F.col("ext").isin(extensions) & ~name.isin(SKIPPED_FILES)) | name.isin([*WELL_KNOWN, *(extra or [])])
    kept = files.filter(~folders & wanted & ~is_minified(F.col("name")) & ~is_backup(F.col("name")))
    top = kept.orderBy("path").limit(most + 1)
    return top.withColumns({"truncated": F.count(F.lit(1)).over(Window.partitionBy()) > most, "place": F.row_number().over(Window.orderBy("path"))}).filter(F.col("place") <= most).drop("place")


def backups(files: DataFrame) -> DataFrame:
    """SRC5: shadow copies only."""
    return files.filter(is_backup(F.col("name")))


def glob_regex(pattern: str) -> str:
    """A gitignore-style pattern as a regular expression over relative paths."""
    body, anchored = pattern.lstrip("!").rstrip("/"), "/" in pattern.strip("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", body.lstrip("/")):
        out += {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^" if anchored else "(^|.*/)") + out + "(/.*|$)"


def not_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """SRC3: the last pattern that matches a path decides; ``!`` takes it back in."""
    if not patterns:
        return files
    last = F.greatest(*(F.when(F.col("path").rlike(glob_regex(p)), i + 1).otherwise(0) for i, p in enumerate(patterns)), F.lit(0))
    ignores = F.array(F.lit(False), *(F.lit(not p.startswith("!")) for p in patterns))
    return files.filter(~F.element_at(ignores, last + 1))


def external_findings(reports: DataFrame) -> DataFrame:
    """SRC15: a scanner's JSON report (content) as findings: severity mapped, first CWE-n, relative path."""
    schema = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,metadata:struct<cwe:array<string>>>>>"
    r = reports.select(F.explode(F.from_json("content", schema)["results"]).alias("r"))
    number = F.filter(F.transform(F.coalesce("r.extra.metadata.cwe", F.array().cast("array<string>")), lambda c: F.regexp_extract(c, r"CWE-([0-9]+)", 1)), lambda x: x != "")
    sev = F.when(F.col("r.extra.severity") == "ERROR", "high").when(F.col("r.extra.severity") == "WARNING", "medium").otherwise("info")
    return r.select(F.col("r.check_id").alias("check_id"), F.regexp_replace("r.path", r"^(\./|/+src/)", "").alias("path"), F.col("r.start.line").alias("line_num"), sev.alias("severity"), F.col("r.extra.message").alias("title"), F.try_element_at(number, F.lit(1)).cast("int").alias("weakness"))


def weakness_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (id, name, related, keywords, static_detectability) from a JSON list; an empty table if there is none."""
    schema = "id string, name string, abstraction string, static_detectability double, keywords array<string>, related array<struct<nature:string,weakness:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def weaknesses_from_xml(xml: DataFrame) -> DataFrame:
    """SRC14: (id, name, abstraction, description) of Weakness elements in a column ``content``."""
    at = lambda a: F.xpath("content", F.lit(f"//*[local-name()='Weakness']/@{a}"))
    text = F.xpath("content", F.lit("//*[local-name()='Weakness']/*[local-name()='Description']/text()"))
    return xml.select(F.explode(F.arrays_zip(at("ID").alias("id"), at("Name").alias("name"), at("Abstraction").alias("abstraction"), text.alias("description"))).alias("w")).select("w.*")


def category_bridge(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (edition, category_id, weakness) from an edition's JSON."""
    schema = "edition string, categories array<struct<id:string,slug:string,name:string,cwes:array<int>>>"
    c = spark.read.schema(schema).option("multiLine", "true").json(path).select("edition", F.explode("categories").alias("c"))
    return c.select("edition", F.col("c.id").alias("category_id"), F.explode("c.cwes").alias("weakness"))


def read_lines(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """SRC9: a range of one file's lines."""
    from ..functions.text import lines_of

    return lines_of(files.filter(F.col("path") == path), "path", text="content").filter(F.col("line_num").between(start, end))
