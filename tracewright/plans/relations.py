"""Queries over findings, runs, memories, dependencies and ledgers, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import temporal_decay
from ..operators import budget, dependencies, findings, history, memory, taxonomy
from .tables import FINDINGS_SQL, table
from .tables import findings as events_as_findings

QUERIES, ORACLE_SQL = {}, {}
AS_OF = "2024-03-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_F = f"WITH {FINDINGS_SQL}"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_RANK5 = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


@query(f"""{_F}, r(rule_ord, tp, pp) AS (VALUES (0, '^Key 1', 'user1'), (1, '^Key', 'user[23]')), m AS (SELECT id, ord, min(rule_ord) AS rule_ord FROM findings JOIN r ON regexp_matches(title, tp) AND regexp_matches(path, pp) GROUP BY ALL)
  SELECT id FROM findings WHERE id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY rule_ord ORDER BY ord) AS rn FROM m) WHERE rn <= 50)""")
def suppress_with_quota(spark, sf_dir):
    """FLT8: two rules silence fifty findings each (the quota is the feature)."""
    rules = spark.createDataFrame([(0, "^Key 1", "user1"), (1, "^Key", "user[23]")], "rule_ord int, title_pattern string, path_pattern string")
    return findings.suppress(events_as_findings(spark, sf_dir), rules, ["ord"]).select("id")


@query(f"""{_F}, g AS (SELECT category, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS norm_title, path, min(line_num)::INT AS line_start, max(line_num)::INT AS line_end, arg_max(severity, {_RANK}) AS severity, count(*) AS instance_count,
  arg_min(title, ord) AS title, list(id ORDER BY ord) AS members FROM findings GROUP BY ALL)
  SELECT category, norm_title, path, line_start, line_end, severity, instance_count, title, members, 'rollup-' || substr(sha256('audit' || chr(0) || category || chr(0) || norm_title || chr(0) || path || chr(0)), 1, 24) AS id FROM g WHERE instance_count >= 2""")
def rollup_l2(spark, sf_dir):
    """A1: parents of findings alike in category, title and path."""
    return findings.rollup(events_as_findings(spark, sf_dir))


@query(f"""{_F}, k AS (SELECT *, CASE WHEN check_id <> '' THEN 'id|' || check_id || '|' || path ELSE 'title|' || lower(title) || '|' || path END AS key FROM findings)
  SELECT id FROM (SELECT id, ord, row_number() OVER (PARTITION BY key ORDER BY ord) AS rn FROM k WHERE ord % 5 <> 0 AND key NOT IN (SELECT key FROM k WHERE ord % 5 = 0)) WHERE rn = 1""")
def dedup_left_anti(spark, sf_dir):
    """Findings new against a fifth of them, first of each key."""
    f = events_as_findings(spark, sf_dir)
    return findings.new_findings(f.filter("ord % 5 <> 0"), f.filter("ord % 5 = 0"), ["ord"]).select("id")


@query(f"""{_F}, k AS (SELECT *, lower(title) || '|' || path || '|' || greatest(line_num, 1) AS key, {_RANK5} * 10 + CASE WHEN check_id <> '' THEN 1 ELSE 0 END AS score FROM findings),
  b AS (SELECT key, agent_type, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rn, id, severity FROM k), a AS (SELECT key, list(DISTINCT agent_type) AS agents FROM k GROUP BY key)
  SELECT id, severity, list_sort(list_filter(agents, lambda x: x <> agent_type)) AS cross_agent_origins, round(least(0.3, 0.1 * (len(agents) - 1)), 2) AS boost FROM b JOIN a USING (key) WHERE rn = 1""")
def cross_agent_merge(spark, sf_dir):
    """A2: one finding per title, path and line, with the other agents that saw it."""
    f = events_as_findings(spark, sf_dir).withColumn("family", F.lit(""))
    score = findings.detail_score(F.lit(False), F.col("severity"), F.lit(0), F.lit(""), F.lit(0), F.col("check_id"))
    return findings.merge_agents(f, score).select("id", "severity", "cross_agent_origins", "boost")


@query("""WITH c AS (SELECT user_id AS finding_id, round(0.5 + sum(w), 9) AS raw, count(*) FILTER (w < 0) AS neg, bool_or(event_type = 'error' AND event_id % 7 = 0) AS auth FROM (SELECT *, CASE event_type WHEN 'error' THEN -0.25 WHEN 'signup' THEN 0.25 WHEN 'purchase' THEN 0.125 WHEN 'click' THEN -0.125 ELSE 0 END::DOUBLE AS w FROM events) GROUP BY ALL)
  SELECT finding_id, CASE WHEN auth THEN 'likely_fp' WHEN least(1, greatest(0, raw)) < 0.3 AND neg >= 2 THEN 'likely_fp' WHEN least(1, greatest(0, raw)) < 0.55 THEN 'suspicious' ELSE 'high_confidence' END AS status,
    CASE WHEN auth THEN least(0.05, least(1, greatest(0, raw))) ELSE least(1, greatest(0, raw)) END::DOUBLE AS confidence FROM c""")
def validation_vote(spark, sf_dir):
    """A3: votes of weighted checks, events standing for checks of a user."""
    t = F.col("event_type")
    w = F.when(t == "error", -0.25).when(t == "signup", 0.25).when(t == "purchase", 0.125).when(t == "click", -0.125).otherwise(0.0)
    name = F.when((t == "error") & (F.col("event_id") % 7 == 0), "suppression").otherwise(t)
    checks = table(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id"), F.col("event_id").alias("pos"), name.alias("id"), w.alias("weight"))
    return findings.vote_rows(checks)


@query(f"""{_F}, s AS (SELECT id, round({_RANK5} * (1 - confidence) + 1e-6 * {_RANK5}, 9) AS priority FROM findings), t AS (SELECT *, row_number() OVER (ORDER BY priority DESC, id) AS rn FROM s) SELECT id, priority, ((rn - 1) // 10)::BIGINT AS batch FROM t WHERE rn <= 1000""")
def l5_selection(spark, sf_dir):
    """The thousand findings most worth a verdict, in batches of ten (a top-k)."""
    f = events_as_findings(spark, sf_dir).withColumns({"validation_status": F.lit("suspicious"), "snippet": F.col("title")})
    return findings.judge_selection(f).select("id", "priority", "batch")


@query(f"""{_F}, j AS (SELECT id, path, ord % 3 <> 0 AS demoted, ord % 11 = 0 AS deterministic, CASE WHEN ord % 13 = 0 THEN 327 ELSE 79 END AS weakness FROM findings),
  p AS (SELECT path, count(*) >= 3 AND count(*) FILTER (demoted) * 2 > count(*) AND NOT (count(*) FILTER (demoted) = count(*) AND NOT bool_or(deterministic)) AS frozen FROM j GROUP BY path)
  SELECT id, demoted AND NOT frozen AND NOT (deterministic OR weakness IN (326, 327, 328, 330, 798, 319)) AS kept_demotion FROM j JOIN p USING (path)""")
def l5_blast_radius(spark, sf_dir):
    """Which demotions the safeguards let through."""
    o = F.col("ord")
    f = events_as_findings(spark, sf_dir).select("id", "path", (o % 3 != 0).alias("demoted"), (o % 11 == 0).alias("deterministic"), F.when(o % 13 == 0, 327).otherwise(79).alias("weakness"))
    return findings.demotion_safeguard(f, ["path"]).select("id", "kept_demotion")


@query(f"""{_F}, v AS (SELECT id, confidence, CASE WHEN confidence < 0.3 THEN 'likely_fp' ELSE 'suspicious' END AS s FROM findings) SELECT id, 'suspicious' AS validation_status, CASE WHEN s = 'likely_fp' THEN greatest(confidence, 0.4) ELSE confidence END AS confidence FROM v""")
def compliance_mode(spark, sf_dir):
    """Nothing is dropped in compliance mode."""
    f = events_as_findings(spark, sf_dir).withColumn("validation_status", F.when(F.col("confidence") < 0.3, "likely_fp").otherwise("suspicious"))
    return findings.compliance_mode(f).select("id", "validation_status", "confidence")


@query(f"""{_F}, p AS (SELECT path, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 4 WHEN 'medium' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 0 END)::DOUBLE AS penalty FROM findings GROUP BY path)
  SELECT path, n, penalty, floor(greatest(5, 100 / (1 + penalty / greatest(30, n * 10))) * 10 + 0.5) / 10 AS score FROM p""")
def compliance_score(spark, sf_dir):
    """A4: score per path."""
    return findings.compliance_score(events_as_findings(spark, sf_dir), ["path"])


_SNAP = "SELECT substr(sha256(o_custkey || '|' || o_orderpriority), 1, 32) AS fingerprint, min(o_orderstatus) AS severity FROM orders WHERE {} GROUP BY 1"


@query(f"""WITH a AS ({_SNAP.format("year(o_orderdate) % 2 = 0")}), b AS ({_SNAP.format("year(o_orderdate) % 2 = 1")})
  SELECT fingerprint, CASE WHEN a.severity IS NULL THEN 'new' WHEN b.severity IS NULL THEN 'fixed' WHEN a.severity <> b.severity THEN 'changed' ELSE 'persistent' END AS change, a.severity AS old_severity, b.severity AS new_severity FROM a FULL JOIN b USING (fingerprint)""")
def audit_compare_full_outer(spark, sf_dir):
    """Two snapshots of orders compared."""
    o = table(spark, sf_dir, "orders").select(F.substring(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256), 1, 32).alias("fingerprint"), F.col("o_orderstatus").alias("severity"), F.year("o_orderdate").alias("y"))
    return history.compare(o.filter("y % 2 = 0"), o.filter("y % 2 = 1"))


_SEEN = "seen AS (SELECT DISTINCT event_type AS agent_type, user_id::VARCHAR AS fingerprint, (day(ts) - 1) // 5 AS run FROM events)"


@query(f"""WITH {_SEEN}, f AS (SELECT agent_type, fingerprint, min(run) AS first_run FROM seen GROUP BY ALL), g AS (SELECT f.agent_type, f.fingerprint, r.run FROM f JOIN (SELECT DISTINCT agent_type, run FROM seen) r ON r.agent_type = f.agent_type AND r.run >= first_run),
  m AS (SELECT g.*, s.run IS NOT NULL AS now FROM g LEFT JOIN seen s ON s.agent_type = g.agent_type AND s.fingerprint = g.fingerprint AND s.run = g.run), l AS (SELECT *, lag(now) OVER (PARTITION BY agent_type, fingerprint ORDER BY run) AS was FROM m)
  SELECT agent_type, fingerprint, run::INT AS run, CASE WHEN was IS NULL THEN 'detected' WHEN now AND NOT was THEN 'regression' ELSE 'fixed' END AS event FROM l WHERE was IS NULL OR now <> was""")
def lineage_regressions(spark, sf_dir):
    """ST13: detected, fixed and regression events over six runs of five days."""
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("agent_type"), F.col("user_id").cast("string").alias("fingerprint"), F.expr("cast((day(ts) - 1) div 5 AS int)").alias("run")).distinct()
    return history.lineage_of(seen, seen.select("agent_type", "run"))


@query("""SELECT user_id, event_type, min(ts) AS first_found_at, max(ts) AS latest_found_at, count(*) AS n_events FROM events GROUP BY ALL""")
def lineage_state(spark, sf_dir):
    """Current row per user and kind."""
    e = table(spark, sf_dir, "events").withColumn("event", F.col("event_type"))
    return history.lineage_state(e, ["user_id", "event_type"], "ts").drop("current_status")


@query("""WITH l AS (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) <= 20), c AS (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) > 20)
  SELECT user_id, event_type FROM l WHERE event_type IN (SELECT event_type FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = l.user_id AND c.event_type = l.event_type)""")
def lineage_fixed(spark, sf_dir):
    """What was open on day twenty and did not come again."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fingerprint"), F.col("event_type").alias("agent_type"), F.dayofmonth("ts").alias("d"))
    old = e.filter("d <= 20").select("fingerprint", "agent_type").distinct().withColumn("current_status", F.lit("open"))
    return history.fixed_now(old, e.filter("d > 20")).select(F.col("fingerprint").cast("long").alias("user_id"), F.col("agent_type").alias("event_type"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ref_number, 'REF-' || lpad(row_number() OVER (ORDER BY o_orderdate, o_orderkey)::VARCHAR, greatest(4, length(row_number() OVER (ORDER BY o_orderdate, o_orderkey)::VARCHAR))::INT, '0') AS ref FROM orders")
def ref_numbers(spark, sf_dir):
    """Dense reference numbers of orders."""
    o = table(spark, sf_dir, "orders")
    return history.numbered(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ref_number", "ref")


@query("SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL ORDER BY o_custkey, o_orderpriority LIMIT 100")
def distinct_on_latest(spark, sf_dir):
    """DISTINCT ON with the limit in key order (the limit is the feature)."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return findings.distinct_latest(o, ["o_custkey", "o_orderpriority"], "at", 100).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS previous FROM orders WHERE o_orderstatus = 'F'")
def previous_completed(spark, sf_dir):
    """The completed order before, same customer and priority."""
    return history.previous_completed(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_orderkey", "previous")


@query("WITH p AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20) SELECT c_custkey, count(o_orderkey) AS n FROM p LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def list_page_counts(spark, sf_dir):
    """A page of customers, counted after the cut (the page is the feature)."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return history.page_counts(c, o, "c_custkey", [F.desc("c_acctbal"), "c_custkey"], 20, 20).select("c_custkey", "n")


@query("WITH t AS (SELECT event_id, count(*) OVER () AS total, row_number() OVER (ORDER BY ts DESC, event_id)::INT AS rn FROM events) SELECT event_id, total, rn, total > 75 AS has_more, 75 AS next_offset FROM t WHERE rn BETWEEN 51 AND 75")
def keyset_page(spark, sf_dir):
    """A page with totals."""
    return findings.page(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), "event_id"], 50, 25).select("event_id", "total", "rn", "has_more", "next_offset")


@query("SELECT count(*) AS audits, count(*) FILTER (o_orderstatus = 'F') AS completed, count(DISTINCT o_custkey) AS sources, floor(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) * 10 + 0.5) / 10 AS avg_score FROM orders")
def dashboard_stats(spark, sf_dir):
    """A5: counts and the average over the completed."""
    done = F.col("o_orderstatus") == "F"
    avg = F.avg(F.when(done, F.col("o_totalprice")))
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("audits"), F.count_if(done).alias("completed"), F.countDistinct("o_custkey").alias("sources"), (F.floor(avg * 10 + 0.5) / 10).alias("avg_score"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'error') AS not_reproduced, count(*) FILTER (event_type = 'click') AS inconclusive, count(*) FILTER (event_type = 'view') AS skipped FROM events GROUP BY user_id")
def prove_summary(spark, sf_dir):
    """Conditional counts."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n("purchase").alias("verified"), n("error").alias("not_reproduced"), n("click").alias("inconclusive"), n("view").alias("skipped"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    """A8."""
    return taxonomy.status_counts(table(spark, sf_dir, "events"), "event_type")


_BRIDGE = "bridge AS (SELECT r_name AS category_id, n_nationkey AS weakness FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'EUROPE')"


def _bridge(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_name <> 'EUROPE'")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("category_id"), F.col("n_nationkey").alias("weakness"))


@query(f"WITH {_BRIDGE} SELECT p_partkey, category_id, p_size % 25 AS weakness FROM part JOIN bridge ON weakness = p_size % 25")
def owasp_map_fanout(spark, sf_dir):
    """Parts by the categories of their weakness."""
    return taxonomy.fan_out(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("weakness")), _bridge(spark, sf_dir)).select("p_partkey", "category_id", "weakness")


@query(f"""WITH {_BRIDGE}, d AS (SELECT DISTINCT p_size % 25 AS weakness FROM part WHERE p_size > 40)
  SELECT category_id, count(DISTINCT weakness) AS mapped_count, coalesce(list(DISTINCT weakness ORDER BY weakness) FILTER (weakness IN (SELECT weakness FROM d)), []) AS found, CASE WHEN bool_or(weakness IN (SELECT weakness FROM d)) THEN 'findings' ELSE 'clean' END AS status FROM bridge GROUP BY category_id""")
def coverage_manifest(spark, sf_dir):
    """A10: what each category holds and what of it was found."""
    return taxonomy.coverage(_bridge(spark, sf_dir), table(spark, sf_dir, "part").filter("p_size > 40").select((F.col("p_size") % 25).alias("weakness")))


@query(f"WITH {_BRIDGE} SELECT DISTINCT p_size % 25 AS weakness FROM part WHERE p_size % 25 NOT IN (SELECT weakness FROM bridge)")
def unmapped_residue(spark, sf_dir):
    """S3: weaknesses outside of every category."""
    return taxonomy.unmapped(_bridge(spark, sf_dir), table(spark, sf_dir, "part").select((F.col("p_size") % 25).alias("weakness")))


@query("""WITH p(prefix, weakness) AS (VALUES ('ECONOMY', 1), ('ECONOMY AN', 2), ('S', 3), ('STANDARD', 4), ('STANDARD P', 5), ('LARGE', 6)), m AS (SELECT p_partkey, arg_max(weakness, length(prefix)) AS weakness FROM part JOIN p ON starts_with(p_type, prefix) GROUP BY p_partkey)
  SELECT part.p_partkey, weakness FROM part LEFT JOIN m USING (p_partkey)""")
def longest_prefix_normalize(spark, sf_dir):
    """Part types by their longest known prefix."""
    p = spark.createDataFrame([("ECONOMY", 1), ("ECONOMY AN", 2), ("S", 3), ("STANDARD", 4), ("STANDARD P", 5), ("LARGE", 6)], "prefix string, weakness int")
    return taxonomy.longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_type"), p, "p_type", "prefix", "weakness").select("p_partkey", "weakness")


def _memories(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_QUERY_VECTOR = [((i * 7) % 11 - 5) / 10 for i in range(64)]
_COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@query(f"SELECT a.vec_id AS id, round({_COS}, 9) AS similarity FROM embeddings a, (SELECT {_QUERY_VECTOR}::DOUBLE[] AS embedding) b ORDER BY {_COS} DESC, id LIMIT 20")
def vector_topk(spark, sf_dir):
    """V2: the twenty nearest of a fixed vector (a top-k)."""
    return memory.vector_topk(_memories(spark, sf_dir), _QUERY_VECTOR, 20).select("id", F.round("similarity", 9).alias("similarity"))


@query(f"SELECT a.vec_id AS source_id, b.vec_id AS target_id, round({_COS}, 9) AS strength FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) <= 3")
def similar_edges(spark, sf_dir):
    """Three nearest of a memory within its label, at 0.3 or more."""
    return memory.similar_edges(_memories(spark, sf_dir), 0.3).withColumn("strength", F.round("strength", 9))


@query(f"""WITH v AS (SELECT a.vec_id AS id, {_COS} AS score FROM embeddings a, (SELECT {_QUERY_VECTOR}::DOUBLE[] AS embedding) b ORDER BY score DESC, id LIMIT 60), t AS (SELECT doc_id AS id, (length(text) - length(replace(text, 'the', ''))) / 3.0::DOUBLE AS score FROM documents ORDER BY score DESC, id LIMIT 60),
  vn AS (SELECT id, score / (SELECT max(score) FROM v) AS v FROM v), tn AS (SELECT id, score / (SELECT max(score) FROM t) AS t FROM t)
  SELECT id, round(0.7 * coalesce(v, 0) + 0.3 * coalesce(t, 0), 9) AS score FROM vn FULL JOIN tn USING (id)""")
def hybrid_fusion(spark, sf_dir):
    """V6: the best sixty by vector and by text, fused (lists are cut before fusion, as asked)."""
    v = memory.vector_topk(_memories(spark, sf_dir), _QUERY_VECTOR, 60).withColumnRenamed("similarity", "score")
    n = (F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))) / F.lit(3.0)
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), n.alias("score")).orderBy(F.desc("score"), "id").limit(60)
    return memory.hybrid_fusion(v, t).select("id", F.round("score", 9).alias("score"))


@query(f"SELECT event_id, round(CASE WHEN date_diff('day', ts::DATE, DATE '{AS_OF}') <= 0 THEN 1 ELSE exp(-0.693 * date_diff('day', ts::DATE, DATE '{AS_OF}') / 90) END * (0.7 + 0.3 * (event_id % 100) / 100), 9) AS score FROM events")
def temporal_decay_rank(spark, sf_dir):
    """V7, V8: decay and confidence of events as memories."""
    from ..functions.similarity import confidence_boost

    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(confidence_boost(temporal_decay(F.col("ts"), F.lit(AS_OF).cast("date")), F.col("event_id") % 100 / 100), 9).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7 AND b.label > a.label), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(id, cluster) AS (SELECT u, u FROM b UNION SELECT b.v, r.cluster FROM r JOIN b ON b.u = r.id)
  SELECT id, min(cluster) AS cluster FROM r GROUP BY id""")
def edge_components(spark, sf_dir):
    """Clusters of chained memories, linked where the label rises."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 7).alias("vec_id"), F.col("vec_id").alias("target_id"), F.col("label").alias("other"))
    met = e.join(b, "vec_id")
    return memory.clusters(met.select(F.col("vec_id").alias("source_id"), "target_id", F.when(F.col("other") > F.col("label"), 0.9).otherwise(0.5).alias("strength")))


@query()
def mmr_select(spark, sf_dir):
    """Five diverse memories of the twenty nearest per label (greedy: no oracle)."""
    m = _memories(spark, sf_dir)
    q = F.array(*map(F.lit, _QUERY_VECTOR))
    from ..functions.similarity import cosine

    scored = m.withColumn("score", cosine(F.col("embedding"), q))
    top = findings.keep_first(scored.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).filter("rank <= 20"), ["id"], ["rank"])
    return memory.mmr(top.select("label", "id", "score", "embedding"), ["label"], 5)


_DEPS = "SELECT p_partkey, 'pkg' || (p_partkey % 5) AS name, (p_size % 4) || '.' || (p_size % 10) || '.' || (p_partkey % 3) AS version FROM part"


@query(f"""WITH d AS ({_DEPS}), n AS (SELECT *, split_part(version, '.', 1)::INT * 10000 + split_part(version, '.', 2)::INT * 100 + split_part(version, '.', 3)::INT AS v FROM d)
  SELECT p_partkey, 'CVE-1' AS cve FROM n WHERE name = 'pkg1' AND v < 20500 UNION ALL SELECT p_partkey, 'CVE-2' FROM n WHERE name = 'pkg1' AND v >= 10000 AND v < 10700 UNION ALL SELECT p_partkey, 'CVE-3' FROM n WHERE name = 'pkg2' AND v = 20200 UNION ALL SELECT p_partkey, 'CVE-4' FROM n WHERE name = 'pkg3' AND v >= 10300 AND v < 20000""")
def version_range_join(spark, sf_dir):
    """Packages with known vulnerabilities by version range."""
    p = table(spark, sf_dir, "part")
    s = lambda c: c.cast("string")
    d = p.select("p_partkey", F.lit("x").alias("ecosystem"), F.concat(F.lit("pkg"), s(F.col("p_partkey") % 5)).alias("name"), F.concat_ws(".", s(F.col("p_size") % 4), s(F.col("p_size") % 10), s(F.col("p_partkey") % 3)).alias("version"))
    known = spark.createDataFrame([("x", "pkg1", "<2.5", "CVE-1"), ("x", "pkg1", ">=1.0,<1.7", "CVE-2"), ("x", "pkg2", "==2.2.0", "CVE-3"), ("x", "pkg3", "~=1.3", "CVE-4")], "ecosystem string, name string, version_spec string, cve string")
    return dependencies.vulnerable(d, known).select("p_partkey", "cve")


@query("SELECT p_brand AS file, count(*) AS instance_count, min(p_partkey) AS line_start, max(p_partkey) AS line_end, array_to_string(list(DISTINCT p_name ORDER BY p_name), ', ') AS names FROM part WHERE p_size % 2 = 0 GROUP BY p_brand")
def manifest_rollup(spark, sf_dir):
    """Unpinned dependencies rolled up by manifest, brands standing for manifests."""
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), F.when(F.col("p_size") % 2 == 0, "^1.0").otherwise("1.0").alias("version"))
    return dependencies.unpinned_rollup(d)


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props_extract(spark, sf_dir):
    """A number out of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""WITH o AS (SELECT user_id, CASE WHEN event_id % 4 = 1 THEN 'add' ELSE 'replace' END AS op, event_type AS field, value, event_id AS seq FROM events), a AS (SELECT user_id, min(seq) AS first FROM o WHERE op = 'add' GROUP BY user_id)
  SELECT user_id::VARCHAR AS run_id, 'f' AS item, field, arg_max(value, seq) AS value FROM o JOIN a USING (user_id) WHERE op = 'add' OR seq > a.first GROUP BY ALL""")
def json_patch_fold(spark, sf_dir):
    """ST5: patches of a user folded; a replace before the add is ignored."""
    e = table(spark, sf_dir, "events")
    ops = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit("f").alias("item"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 4 == 1, "add").otherwise("replace").alias("op"), "value", F.col("event_id").alias("seq"))
    return history.patch_fold(ops)


@query("""WITH s AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT event_id, user_id AS run_id FROM s UNION ALL SELECT event_id, user_id FROM events WHERE event_type <> 'purchase' AND user_id NOT IN (SELECT user_id FROM s)""")
def snapshot_rescue(spark, sf_dir):
    """Snapshots, and deltas of those without one."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.lit("a").alias("agent_type"), "event_type")
    return history.rescue_deltas(e.filter("event_type = 'purchase'"), e.filter("event_type <> 'purchase'")).select("event_id", "run_id")


@query("""WITH r AS (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 AS s, floor(epoch(ts))::BIGINT // 3600 + event_id % 24 AS e FROM events), h AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM r),
  i AS (SELECT *, sum(CASE WHEN high IS NULL OR s > high THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM h) SELECT user_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY user_id, island""")
def range_merge_islands(spark, sf_dir):
    """Overlapping ranges of a user merged."""
    hour = F.expr("unix_seconds(cast(ts AS timestamp)) div 3600")
    return findings.merge_ranges(table(spark, sf_dir, "events").select("user_id", hour.alias("start"), (hour + F.col("event_id") % 24).alias("end")), ["user_id"])


@query()
def greedy_batches(spark, sf_dir):
    """Documents of a source packed in order into batches of 100,000 characters and 40 rows (a fold: no oracle)."""
    return findings.greedy_batches(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 100_000)


@query("""WITH w AS (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS r, lag(event_type, 1) OVER s AS a, lag(event_type, 2) OVER s AS b, lag(event_type, 3) OVER s AS c, row_number() OVER s AS total FROM events WINDOW s AS (PARTITION BY user_id ORDER BY event_id)),
  x AS (SELECT event_id, len(list_filter(r, lambda v: v = event_type))::INT AS repeats, coalesce(b = event_type AND a = c AND a <> event_type, false) AS ping_pong, total FROM w)
  SELECT event_id, repeats, ping_pong, CASE WHEN total >= 100 OR repeats >= 20 OR ping_pong THEN 'kill' WHEN repeats >= 10 THEN 'warn' ELSE 'continue' END AS verdict FROM x""")
def loop_detector(spark, sf_dir):
    """Repeated events of a user within forty."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature"))
    return history.loop_calls(e).select(F.col("seq").alias("event_id"), "repeats", "ping_pong", "verdict")


@query("SELECT user_id % 7 AS tenant_id, round(sum(1000 - value - value / 2), 6) AS remaining FROM events GROUP BY 1")
def budget_remaining(spark, sf_dir):
    """A14."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("tenant_id"), F.lit(1000.0).alias("cap"), F.col("value").alias("spent"), (F.col("value") / 2).alias("reserved"))
    return budget.remaining(e).select("tenant_id", F.round("remaining", 6).alias("remaining"))


@query("SELECT user_id AS run_id, event_type AS request_id, arg_min(value, event_id) AS cost_usd FROM events GROUP BY ALL")
def ledger_idempotent(spark, sf_dir):
    """ST12: the first charge of a request counts."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("request_id"), F.col("event_id").alias("created_at"), F.col("value").alias("cost_usd"))
    return budget.idempotent_ledger(e).select("run_id", "request_id", "cost_usd")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def lease_sweep(spark, sf_dir):
    """Old orders without a large line, as leases that nothing settled."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("r").alias("request_id"), F.col("o_orderdate").alias("expires_at"))
    settled = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("run_id"), F.lit("r").alias("request_id"))
    return budget.expired_leases(o, settled, F.lit("1996-01-01").cast("timestamp")).select(F.col("run_id").alias("o_orderkey"))


@query()
def circuit_breaker(spark, sf_dir):
    """ST9: events of a user through a breaker (a state machine: no oracle)."""
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.when(t == "error", "fail").when(t == "view", "neutral").otherwise("ok").alias("outcome"))
    return budget.circuit_states(e, ["user_id"], threshold=2, timeout_s=86_400.0)


@query("SELECT event_id, CASE WHEN event_id % 600 IN (401, 403) THEN 'auth' WHEN event_id % 600 = 429 THEN 'rate_limit' WHEN event_id % 600 = 404 THEN 'not_found' WHEN event_id % 600 = 400 THEN 'format' WHEN event_id % 600 IN (408, 504) THEN 'timeout' WHEN event_id % 600 >= 500 THEN 'server' WHEN event_type = 'error' THEN 'timeout' ELSE 'unknown' END AS kind FROM events")
def error_kinds(spark, sf_dir):
    """Failures by status, else by message."""
    message = F.when(F.col("event_type") == "error", "Request timed out").otherwise("odd")
    return table(spark, sf_dir, "events").select("event_id", budget.error_kind(F.col("event_id") % 600, message).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 9 >= 3 THEN least(60 * power(2, event_id % 9 - 3), CASE event_type WHEN 'error' THEN 600 WHEN 'signup' THEN 3600 ELSE 300 END) ELSE 0 END::DOUBLE AS seconds FROM events")
def cooldown_seconds(spark, sf_dir):
    """Cooldown in closed form."""
    kind = F.when(F.col("event_type") == "error", "rate_limited").when(F.col("event_type") == "signup", "auth_error").otherwise("server_error")
    return table(spark, sf_dir, "events").select("event_id", budget.cooldown(F.col("event_id") % 9, kind).alias("seconds"))


@query("""WITH m AS (SELECT doc_id AS file, CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS expectation, 1 AS weakness FROM labels), h AS (SELECT doc_id AS file FROM documents WHERE regexp_matches(text, 'stupid|pathetic|clown')),
  p AS (SELECT weakness, count(*) FILTER (expectation = 'positive') AS positives, count(*) FILTER (expectation = 'negative') AS negatives, coalesce(avg(CASE WHEN expectation = 'positive' THEN (file IN (SELECT file FROM h))::INT END), 0) AS recall, coalesce(avg(CASE WHEN expectation = 'negative' THEN (file IN (SELECT file FROM h))::INT END), 0) AS fp_rate FROM m GROUP BY weakness)
  SELECT weakness, positives, negatives, round(recall, 9) AS recall, round(fp_rate, 9) AS fp_rate, CASE WHEN recall >= 1 AND fp_rate <= 0 AND positives >= 3 AND negatives >= 3 THEN 'VERIFIED' WHEN recall > 0 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS band FROM p""")
def corpus_gate(spark, sf_dir):
    """Recall and false positives of a word rule over labelled documents."""
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.when(F.col("toxic") == 1, "positive").otherwise("negative").alias("expectation"), F.lit(1).alias("weakness"))
    h = table(spark, sf_dir, "documents").filter(F.col("text").rlike("stupid|pathetic|clown")).select(F.col("doc_id").alias("file"), F.lit(1).alias("weakness"))
    return taxonomy.corpus_gate(m, h).withColumns({"recall": F.round("recall", 9), "fp_rate": F.round("fp_rate", 9)})


@query("SELECT * FROM (VALUES ('scan', 1::BIGINT), ('discover', 2), ('prove', 3)) t(stage, place)")
def stage_expansion(spark, sf_dir):
    """Stages with their prerequisites."""
    return history.expand_stages(spark.createDataFrame([("prove",), ("discover",)], "stage string"), True).withColumn("place", F.col("place").cast("long"))


@query("WITH e AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) SELECT doc_id, used::BIGINT AS used FROM e WHERE used <= 20000")
def token_budget(spark, sf_dir):
    """Documents of a source in order while they fit a budget."""
    return taxonomy.running_keep(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 20_000).select("doc_id", "used")


@query("""SELECT n_name AS segment, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), ())""")
def star_rollup(spark, sf_dir):
    """An addition to the inventory: a star join with a roll-up."""
    c, n, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    met = c.join(n, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey)
    return met.rollup(F.col("n_name").alias("segment"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    """An addition to the inventory: a plain aggregation."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
