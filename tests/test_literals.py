"""Literals that patterns need, and rows dealt to all cores."""

import pytest
from test_detectors import TWINS

from tracewright.functions.literals import needed, run_in
from tracewright.functions.text import lines_of
from tracewright.operators import detectors, secrets, shapes
from tracewright.plans.tables import spread

RULES = [r for rules in detectors.LINE_RULES.values() for r in rules]


def sets(pattern):
    return [sorted(c) for c in needed(pattern)]


def test_needed_literals():
    assert sets(r"(?i)(execute|raw)\s*\(") == [["("], ["execute", "raw"]]
    assert sets(r"[Ll]icen[cs]e") == [["licen"]]
    assert sets(r"x?(ab|c)") == [] and sets(r"(?!ab)cd*") == [] and sets(r"(ab)*cd") == [["cd"]]
    assert run_in(r"(^|[^0-9])[0-9a]{16}") == "[0123456789a]{16}" and run_in(r"[0-9]{2}") is None


@pytest.mark.parametrize("pattern", [r"a[b[cd]]ee", r"[a-z&&[^b]]xx", r"\Qa.b\E", r"ab\vcd", r"(?iu)ss", r"(?<n>abc)", r"\p{L}abc", r"(?x)a b c"])
def test_nothing_is_said_of_what_java_may_read_otherwise(pattern):
    assert needed(pattern) == () and run_in(pattern) is None


def odd_lines():
    bad = [t[3] for t in TWINS]
    digits = ["9" * 16, "x" + "9" * 16 + "y", "9" * 17, "0a" * 20, "0A" * 20, "0a" * 20 + "b", "1.2.3.4", "1.2.3.4.5", "AKIA" + "A1" * 8, "akia" + "A1" * 8]
    marks = ["", " ", "(", "=", "Key = 1", "PAſſWORD = 'hunter22'", "DEBUGİ = True", "Éval(x) é(", "debug = TRUE", "MD5 (", "for(;;)", "while true", "a and b or c", "\\x41" * 6]
    return [*bad, *(b.upper() for b in bad), *(b.lower() for b in bad), *(b[: len(b) // 2] for b in bad), *digits, *marks]


@pytest.mark.parametrize("rules", [RULES, secrets.PROVIDERS], ids=["detectors", "providers"])
def test_rules_fire_as_their_patterns_do(spark, rules):
    rows = [(i, ext, line) for i, line in enumerate([*odd_lines(), None]) for ext in ("py", "c", "js", "txt")]
    lines = spark.createDataFrame(rows, "line_num int, ext string, line string")
    plain = [(r.check_id, lines.filter(r.fires(lines.line, lines.ext)).select("line_num", "ext").collect()) for r in rules]
    expected = {(x.line_num, x.ext, check) for check, found in plain for x in found}
    assert {(r.line_num, r.ext, r.check_id) for r in shapes.line_rules(lines, rules, "ext").collect()} == expected
    order = {r.check_id: i for i, r in enumerate(rules)}
    first = {}
    for n, ext, check in sorted(expected, key=lambda x: order[x[2]]):
        first.setdefault((n, ext), check)
    assert {(r.line_num, r.ext): r.check_id for r in shapes.first_match(lines, rules, "ext").collect()} == first


def test_tests_of_lines_are_made_once(spark):
    files = spark.createDataFrame([("a", "py", "eval(x)")], "path string, ext string, content string")
    plan = detectors.detect(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(line") == 1


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    n = 4000
    text = "concat_ws(' ', " + ", ".join(f"md5(concat(id, '{k}'))" for k in range(8)) + ") AS text"
    spark.range(n).selectExpr("id AS doc_id", text).coalesce(1).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spark.read.parquet(str(tmp_path / "d"))
        assert df.rdd.getNumPartitions() >= 4
        sizes = spread(df).rdd.glom().map(len).collect()
        assert sum(sizes) == n and max(sizes) <= n / 2
        assert spread(df.filter("doc_id < 0")).count() == 0
        even = spark.range(0, n, 1, 8).withColumnRenamed("id", "doc_id")
        assert "REPARTITION" not in spread(even)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_end_at_separators_beyond_latin(spark):
    df = spark.createDataFrame([(1, "a\u2028b\nc"), (2, "a\u2029b"), (3, "a\x1cb\x1dc\x1ed\x85e\x0cf\rg")], "k int, text string")
    got = {k: [r.line for r in lines_of(df, "k").filter(f"k = {k}").orderBy("line_num").collect()] for k in (1, 2, 3)}
    assert got == {1: ["a", "b", "c"], 2: ["a", "b"], 3: list("abcdefg")}


def window_files(spark):
    parts = [
        "x = requests.get(u)", "if ALLOWLIST: pass", "os.system(c)", "shlex.quote(c)", "Thread (f)", "GO  func", "with LOCK:", "os.path.exists(p)", "f = open (p)", "except", "raise", "a && b", "a and b or c", "MC/DC 1",
        "def f (x)", "REQ-1", "HLR-x", "return 1", "break", "rows.FIND (q)", "req.body", "schema", "ldap_x.search(input)", "escape_filter", "a.xpath (input)", "variables", "logger.warn (1)", "request.x", "strip", "ParseExpression(request)",
        "autoindex on", "(a+)+", "axios", "circuit", "urlopen", "timeout", "cached", "singleton", "pool", "login", "audit", "ssn", "hash", "catch", "customer", "ttl", "server", "alert", "# comment", "", "x" * 600 + "(a+)+",
    ]
    rows = [(f"f{k}", "\n".join(parts[(i * k + i * i) % len(parts)] for i in range(3 * k))) for k in range(1, 24)] + [(f"one{i}", p) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, "path string, content string")


def test_windows_find_what_their_shapes_find(spark):
    files = window_files(spark)
    lines, key = shapes.code_lines(lines_of(files, "path", text="content")).cache(), ["path"]
    single = {k: shapes.window_suppressed(lines, key, *r) for k, r in detectors.SUPPRESSED_RULES.items()}
    single |= {k: shapes.directional(lines, key, *r) for k, r in detectors.DIRECTIONAL_RULES.items()}
    single |= {k: shapes.signature(lines, key, *r) for k, r in detectors.SIGNATURES.items()}
    single |= {k: shapes.presence_absence(lines, key, *r[:2]) for k, r in detectors.PRESENCE_RULES.items()}
    expected = {(r.path, r.line_num, k) for k, df in single.items() for r in df.select("path", "line_num").collect()}
    found = [tuple(r) for r in detectors.detect_windows(files).select("path", "line_num", "check_id").collect()]
    assert sorted(found) == sorted(expected) and len({f[2] for f in found}) >= 20


def test_windows_try_patterns_only_where_their_literals_are(spark):
    plan = detectors.detect_windows(window_files(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(line") == 1 and "Contains(lowered_" in plan
