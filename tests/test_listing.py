"""Lists, filters, orders and caches."""

from pyspark.sql import functions as F

from tracewright.operators import listing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths(spark):
    for raw, want, inside in [("a/./b//c", "a/b/c", True), ("a/../b", "b", True), ("../x", "../x", False), ("a/../../b", "../b", False), ("/etc", "etc", False), ("", "", True)]:
        assert one(spark, listing.normal_path(F.lit(raw))) == want
        assert one(spark, listing.within_root(F.lit(raw))) is inside


def test_statements_and_excerpts(spark):
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(["app.get('/x',", "  auth,", "  h)", "y = 1"])], "path string, line_num int, line string")
    got = {r.line_num: r.statement for r in listing.statements(lines, ["path"]).collect()}
    assert got == {1: "app.get('/x',\n  auth,\n  h)", 4: "y = 1"}
    hits = spark.createDataFrame([("f", 4)], "path string, line_num int")
    assert sorted(r.line_num for r in listing.excerpts(lines, hits, ["path"], reach=1).collect()) == [3, 4]


def test_packing_and_budget(spark):
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate([5, 9, 3, 2])], "k string, i int, n int")
    assert sorted(r.i for r in listing.skip_pack(df, ["k"], ["i"], "n", 10).collect()) == [0, 2, 3]
    tries = spark.createDataFrame([("k", i, True) for i in range(3)], "k string, seq int, is_retry boolean")
    assert [r.granted for r in listing.retry_budget(tries, ["k"], 0.0, 2.0).orderBy("seq").collect()] == [True, True, False]


def test_lists(spark):
    f = spark.createDataFrame([("a", "suspicious", "llm"), ("b", "likely_fp", ""), ("c", None, "")], "fingerprint string, validation_status string, provenance string")
    assert [r.fingerprint for r in listing.hide_triaged(f, spark.createDataFrame([("a",)], "fingerprint string")).collect()] == ["c"]
    assert [(r.tier, r.n) for r in listing.tier_counts(f).collect()] == [("llm", 1), ("untagged", 2)]
    a = spark.createDataFrame([("1", "done", ["cwe"], "Git"), ("2", "done", ["xss"], "zip")], "id string, status string, types array<string>, source string")
    assert [r.id for r in listing.dashboard_filter(a, status="done", kind="cwe", search="gi").collect()] == ["1"]
    r = spark.createDataFrame([("V1.10",), ("V1.9",)], "req_id string")
    assert [x.req_id for x in listing.requirement_order(r).collect()] == ["V1.9", "V1.10"]
    assert one(spark, listing.average_score(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(4)))) == 4
    m = spark.createDataFrame([("f", "tp", 1), ("g", None, None)], "fingerprint string, user_label string, labelled_at int")
    new = spark.createDataFrame([("f", "fp", 5)], "fingerprint string, user_label string, labelled_at int")
    assert {(x.fingerprint, x.user_label) for x in listing.write_labels(m, new).collect()} == {("f", "fp"), ("g", None)}
    files = spark.createDataFrame([("z", 1), ("b", 9), ("main.py", 5), ("bad", 7)], "path string, size int")
    got = listing.file_tiers(files, spark.createDataFrame([("bad",)], "path string"), F.col("path").startswith("main"))
    assert [x.path for x in got.collect()] == ["bad", "main.py", "z", "b"]
    assert one(spark, listing.provenance(F.lit("llm"), F.lit(""), F.lit(True))) == "llm_l5_verified"


def test_cache(spark):
    c = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("o", "2023-01-01 00:00:00")], "cache_key string, judged_at string")
    live = listing.fresh(c, "judged_at", F.lit("2024-01-01 01:00:00"), 7200)
    have, need = listing.split_by_cache(spark.createDataFrame([("k",), ("o",)], "cache_key string"), live)
    assert [r.cache_key for r in have.collect()] == ["k"] and [r.cache_key for r in need.collect()] == ["o"]
