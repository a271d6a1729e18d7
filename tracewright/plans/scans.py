"""Queries over lines, spans, files and pages, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import tokens
from ..functions.text import keywords, memory_title, redact_secrets, rollup_title, severity
from ..operators import detectors, memory, secrets, shapes, surface
from ..operators.findings import downgrade_in_tests
from ..sources import files as sources
from .tables import LINES_SQL, files, lines, spread, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SCAN_RULES = [*detectors.LINE_RULES["personal_data"], *detectors.LINE_RULES["secrets"], *detectors.LINE_RULES["license"]]
_RULES_SQL = "rules(check_id, pattern, severity, title, ord) AS (VALUES " + ", ".join(f"('{r.check_id}', '{r.pattern}', '{r.severity}', '{r.title}', {i})" for i, r in enumerate(SCAN_RULES)) + ")"
_WITH = f"WITH {LINES_SQL}, {_RULES_SQL}, hits AS (SELECT lines.*, check_id, pattern, severity, title, ord FROM lines JOIN rules ON regexp_matches(line, pattern))"


@query(f"{_WITH} SELECT check_id, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY ALL")
def scan_line_rules(spark, sf_dir):
    """Hits and documents by check and severity."""
    found = shapes.line_rules(lines(spark, sf_dir), SCAN_RULES)
    return found.groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""{_WITH} SELECT substr(sha256(path || ':' || check_id || ':' || line_num), 1, 32) AS id, path, line_num, check_id,
  substr(sha256(lower(title) || '|' || path || '|' || split_part(check_id, '.', 1) || '|rules'), 1, 32) AS fingerprint FROM hits""")
def finding_fingerprint(spark, sf_dir):
    """Identity of every finding of the scan rules."""
    from ..functions.text import fingerprint, short_hash

    found = shapes.line_rules(lines(spark, sf_dir, "path"), SCAN_RULES)
    category = F.substring_index("check_id", ".", 1)
    return found.select(short_hash(F.col("path"), F.col("check_id"), F.col("line_num")).alias("id"), "path", "line_num", "check_id", fingerprint(F.col("title"), F.col("path"), category, F.lit("rules")).alias("fingerprint"))


@query(f"{_WITH} SELECT check_id, count(*) AS n FROM (SELECT check_id, row_number() OVER (PARTITION BY doc_id, line_num ORDER BY ord) AS rn FROM hits) WHERE rn = 1 GROUP BY ALL")
def scan_first_match(spark, sf_dir):
    """FLT2: lines by the first rule that fires."""
    return shapes.first_match(lines(spark, sf_dir), SCAN_RULES).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_num, regexp_extract(substr(line, 1, 2000), '[0-9]+[.][0-9]+') AS match FROM lines WHERE regexp_matches(substr(line, 1, 2000), '[0-9]+[.][0-9]+') ORDER BY doc_id, line_num LIMIT 500")
def grep_search_pattern(spark, sf_dir):
    """SRC10: the first 500 lines with a decimal, in order; the limit is the feature."""
    return shapes.grep(lines(spark, sf_dir), ["doc_id"], "[0-9]+[.][0-9]+").select("doc_id", "line_num", "match")


@query(f"""WITH {LINES_SQL}, w AS (SELECT *, coalesce(max(regexp_matches(line, 'the')::INT) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) AS safe FROM lines)
  SELECT doc_id, line_num FROM w WHERE regexp_matches(line, '[0-9]{{4}}') AND safe = 0""")
def window_suppressed_rules(spark, sf_dir):
    """Digit runs with no English article on the line or beside it."""
    return shapes.window_suppressed(lines(spark, sf_dir), ["doc_id"], "[0-9]{4}", "the", 1).select("doc_id", "line_num")


@query(f"""WITH {LINES_SQL}, w AS (SELECT *, coalesce(max(regexp_matches(line, '[0-9]')::INT) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS near FROM lines)
  SELECT doc_id, line_num FROM w WHERE regexp_matches(line, '@') AND near = 1""")
def directional_window_pairs(spark, sf_dir):
    """Lines with an at sign that a line with a digit follows within five."""
    return shapes.directional(lines(spark, sf_dir), ["doc_id"], "@", "[0-9]", 1, 5).select("doc_id", "line_num")


@query(f"""WITH {LINES_SQL}, w AS (SELECT *, coalesce(max(regexp_matches(substr(line, 1, 600), '[A-Z]')::INT) OVER f, 0) AS src, coalesce(max(regexp_matches(substr(line, 1, 600), 'license')::INT) OVER f, 0) AS clean
  FROM lines WINDOW f AS (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING))
  SELECT doc_id, min(line_num) AS line_num FROM w WHERE regexp_matches(substr(line, 1, 600), '[0-9]{{16}}') AND src = 1 AND clean = 0 GROUP BY doc_id""")
def signature_match(spark, sf_dir):
    """The first long number with a capital and no licence word within eight lines."""
    return shapes.signature(lines(spark, sf_dir), ["doc_id"], "[0-9]{16}", "[A-Z]", "license", 8).select("doc_id", "line_num")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
  SELECT event_id, user_id FROM e s WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e a WHERE a.user_id = s.user_id AND a.event_type = 'signup' AND a.pos BETWEEN s.pos - 5 AND s.pos - 1)""")
def taint_range_join(spark, sf_dir):
    """P5: purchases with a signup of the user among the five events before."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("pos", pos).withColumn("name", F.col("user_id").cast("string"))
    return shapes.taint(e.filter("event_type = 'signup'").select("user_id", "name", "pos"), e.filter("event_type = 'purchase'"), ["user_id"], 5).select("event_id", "user_id")


@query(f"WITH {LINES_SQL} SELECT doc_id, min(line_num) FILTER (regexp_matches(line, '@')) AS line_num FROM lines GROUP BY doc_id HAVING bool_or(regexp_matches(line, '@')) AND NOT bool_or(regexp_matches(line, '[+]1'))")
def file_presence_absence(spark, sf_dir):
    """Documents with an at sign and without a country code, at the first."""
    return shapes.presence_absence(lines(spark, sf_dir), ["doc_id"], "@", "[+]1")


@query(f"WITH {LINES_SQL} SELECT source, bool_or(regexp_matches(line, '@')) AS present, bool_or(regexp_matches(line, 'AKIA')) AS absent FROM lines GROUP BY source HAVING bool_or(regexp_matches(line, '@')) AND NOT bool_or(regexp_matches(line, 'AKIA'))")
def repo_presence_absence(spark, sf_dir):
    """Sources, as trees, with one word and without another."""
    found = shapes.presence_absence(lines(spark, sf_dir, "source"), ["source"], "@", "AKIA")
    return found.select("source", F.lit(True).alias("present"), F.lit(False).alias("absent"))


@query("""WITH p AS (SELECT DISTINCT coalesce(nullif(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), ''), '/') AS route FROM pages)
  SELECT route FROM p WHERE NOT (route = '/en' OR starts_with(route, '/en/')) AND NOT regexp_matches(route, '^/fr/[^/]+/[^/]')""")
def prefix_cover_antijoin(spark, sf_dir):
    """Page paths that no mounted prefix covers."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    routes = table(spark, sf_dir, "pages").select(path.alias("route")).distinct()
    mounts = spark.createDataFrame([("/en",), ("/fr/:page/*",)], "mount string")
    return shapes.uncovered(routes, mounts)


@query("""WITH kw AS (SELECT item_id AS entry, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 4)))  AS word FROM benchmark),
  w AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 4))) AS word FROM documents),
  s AS (SELECT entry, count(DISTINCT word) AS size FROM kw GROUP BY entry)
  SELECT doc_id, entry, matched, round(matched / size, 9) AS score FROM (SELECT doc_id, entry, count(*) AS matched FROM w JOIN kw USING (word) GROUP BY ALL) JOIN s USING (entry) WHERE matched >= 3 AND matched / size >= 0.6""")
def keyword_overlap_index(spark, sf_dir):
    """Documents that hold most of a benchmark item's longer words, through an inverted index."""
    words = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 4))).alias("word"))
    entries = words(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "entry"), "entry")
    found = shapes.keyword_overlap(words(spread(table(spark, sf_dir, "documents")), "doc_id"), entries, ["doc_id"])
    return found.select("doc_id", "entry", "matched", F.round("score", 9).alias("score"))


@query("""WITH m AS (SELECT doc_id, text, unnest(range(1, len(r) + 1)) AS k, r, string_split_regex(text, '[0-9]{16}') AS g FROM (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{16}') AS r FROM documents) WHERE len(r) > 0),
  o AS (SELECT doc_id, r[k] AS span, (list_sum(list_transform(g[:k], lambda x: length(x))) + 16 * (k - 1))::INT AS "offset", text FROM m)
  SELECT doc_id, span, "offset", (length(substr(text, 1, "offset")) - length(replace(substr(text, 1, "offset"), chr(10), '')) + 1)::INT AS line_num FROM o""")
def span_secrets(spark, sf_dir):
    """P10: sixteen-digit spans over whole texts with offset and line."""
    return shapes.spans(spread(table(spark, sf_dir, "documents")), ["doc_id"], "[0-9]{16}")


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_num, unnest(regexp_extract_all(line, '[A-Za-z0-9+/=_-]{{16,}}')) AS token FROM lines),
  e AS (SELECT doc_id, line_num, token, round(-list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: ((length(token) - length(replace(token, c, ''))) / length(token)) * log2((length(token) - length(replace(token, c, ''))) / length(token)))), 6) AS entropy
    FROM t WHERE NOT regexp_matches(token, '^([0-9a-fA-F]{{40}}|[0-9a-fA-F]{{56}}|[0-9a-fA-F]{{64}}|[0-9a-fA-F]{{96}}|[0-9a-fA-F]{{128}})$'))
  SELECT doc_id, line_num, substr(token, 1, 16) AS head, min(token) AS token, arg_min(entropy, token) AS entropy FROM e WHERE entropy >= 3.0 GROUP BY ALL""")
def entropy_tokens(spark, sf_dir):
    """Long tokens of three bits a character or more that are no hashes."""
    return secrets.high_entropy(lines(spark, sf_dir), ["doc_id"], "[A-Za-z0-9+/=_-]{16,}", 3.0)


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS digits FROM documents)
  SELECT doc_id, digits, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN digits[i]::INT WHEN digits[i]::INT * 2 > 9 THEN digits[i]::INT * 2 - 9 ELSE digits[i]::INT * 2 END)) % 10 = 0 AS valid FROM t""")
def luhn_checksum(spark, sf_dir):
    """Sixteen-digit numbers and their check digit."""
    from ..operators.checksums import luhn

    some = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("digits"))
    return some.withColumn("valid", luhn(F.col("digits")))


@query("SELECT event_id, CASE lower(trim(event_type)) WHEN 'error' THEN 'critical' WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'high' ELSE 'info' END AS severity FROM events")
def severity_normalize(spark, sf_dir):
    """FLT12: severities by alias, else info."""
    alias = F.when(F.col("event_type") == "error", " CRIT ").when(F.col("event_type") == "click", "L").when(F.col("event_type") == "purchase", "High").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", severity(alias).alias("severity"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'high' END AS severity FROM documents""")
def test_path_downgrade(spark, sf_dir):
    """FLT6: findings in test paths lose one severity."""
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("source"), F.lit("/tests/a.py"))).otherwise(F.concat(F.col("source"), F.lit("/a.py")))
    return downgrade_in_tests(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.lit("high").alias("severity"))).select("doc_id", "severity")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_num, regexp_replace(line, '(token|password)( ?= ?\"?)[0-9a-f]+', '\\1\\2***', 'g') AS line FROM lines WHERE regexp_matches(line, '(token|password) ?=')")
def redact_lines(spark, sf_dir):
    """Redaction of assigned passwords, twice as once."""
    mask = lambda c: F.regexp_replace(c, r'(token|password)( ?= ?"?)[0-9a-f]+', "$1$2***")
    some = lines(spark, sf_dir).filter(F.col("line").rlike("(token|password) ?="))
    return some.select("doc_id", "line_num", mask(mask(F.col("line"))).alias("line"))


@query()
def redact_secret_literals(spark, sf_dir):
    """Quoted literals and assignment values masked on lines with a secret's name (look-around: no oracle)."""
    some = lines(spark, sf_dir).filter(F.col("line").rlike(r"(key|token|secret|passwd|password|pwd)\s*[:=]"))
    return some.select("doc_id", "line_num", redact_secrets(F.col("line")).alias("line"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_num, substr(array_to_string(list(line_num || ': ' || line ORDER BY line_num) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)), 1, 200) AS snippet FROM lines""".replace(" ORDER BY line_num) OVER", ") OVER"))
def code_snippet(spark, sf_dir):
    """Two lines either side with numbers, 200 characters."""
    return shapes.snippets(lines(spark, sf_dir), ["doc_id"]).select("doc_id", "line_num", "snippet")


@query("""SELECT item_id, list_distinct_ordered AS keywords FROM (SELECT item_id, (list_filter(w, lambda x, i: list_position(w, x) = i))[:15] AS list_distinct_ordered FROM (SELECT item_id,
  list_filter(list_transform(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda w: regexp_replace(w, '^[.,;:!?()\\[\\]{}"'']+|[.,;:!?()\\[\\]{}"'']+$', '', 'g')), lambda w: length(w) >= 3 AND w NOT IN ('the', 'are', 'was', 'were', 'been', 'being', 'have', 'has', 'had', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'must', 'shall', 'can', 'for', 'with', 'from', 'about', 'into', 'through', 'and', 'but', 'not', 'then', 'that', 'this', 'its', 'than')) AS w FROM benchmark))""".replace("\\\\", "\\"))
def keyword_extract(spark, sf_dir):
    """The first fifteen keywords of benchmark texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", keywords(F.col("text")).alias("keywords"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '  at LINE 12 '), '\s+', ' ', 'g')) AS rollup_title,
  trim(regexp_replace(regexp_replace(regexp_replace(lower('  ' || p_name || '  at LINE 12 '), '(at )?line [0-9]+', '', 'g'), ' in [a-z0-9_./-]+( [a-z0-9_./-]+)?', '', 'g'), '\s+', ' ', 'g')) AS memory_title FROM part""")
def title_normalize(spark, sf_dir):
    """Both title normalisers on part names."""
    t = F.concat(F.lit("  "), F.col("p_name"), F.lit("  at LINE 12 "))
    return table(spark, sf_dir, "part").select("p_partkey", rollup_title(t).alias("rollup_title"), memory_title(t).alias("memory_title"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[ \t\r\n]+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: length(w) >= 2)) AS w FROM benchmark)
  SELECT a, b, round(j, 9) AS jaccard FROM (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM t a JOIN t b ON a.item_id < b.item_id) WHERE j >= 0.15""")
def jaccard_pairs(spark, sf_dir):
    """Benchmark items whose tokens overlap by 0.15 or more."""
    t = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("w"))
    return memory.similar_sets(t, "item_id", "w", 0.15).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, unnest(list_concat(list_transform(regexp_extract_all(html, 'href=["'']([^"''#]+)', 1), lambda v: ['href', v]), list_transform(regexp_extract_all(html, 'src=["'']([^"''#]+)', 1), lambda v: ['src', v]))) AS a FROM pages),
  p AS (SELECT page_id, a[1] AS attr, CASE WHEN regexp_matches(a[2], '^https?://') THEN regexp_extract(a[2], '^https?://[^/]+(/[^?#]*)?', 1) ELSE regexp_extract(a[2], '^([^?#]*)', 1) END AS path, host, a[2] AS value FROM l
    WHERE NOT regexp_matches(a[2], '^(mailto|javascript|tel|data):') AND (NOT regexp_matches(a[2], '^https?://') OR regexp_extract(a[2], '^https?://([^/:?#]+)', 1) = host))
  SELECT DISTINCT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS value, CASE WHEN regexp_matches(path, '(?i)(/api/|/v[12]/|/graphql)') THEN 'api' ELSE 'url' END AS kind FROM p
  WHERE attr = 'src' OR NOT regexp_matches(path, '(?i)\.(css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|map|pdf|zip)$')""")
def html_links(spark, sf_dir):
    """Links of pages on their own host."""
    return surface.links(table(spark, sf_dir, "pages"))


@query(r"""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<form[^>]*>')) AS form FROM pages) SELECT page_id, coalesce(nullif(regexp_extract(form, '(?i)action=["'']([^"'']*)', 1), ''), '/') AS action, upper(coalesce(nullif(regexp_extract(form, '(?i)method=["'']([^"'']*)', 1), ''), 'GET')) AS method FROM f""")
def html_forms(spark, sf_dir):
    """Forms of pages."""
    return surface.forms(table(spark, sf_dir, "pages")).select("page_id", "action", "method")


@query("WITH t(technology, mark) AS (VALUES ('react', 'react'), ('next.js', 'next'), ('vue', 'vue'), ('angular', 'angular'), ('django', 'django'), ('flask', 'flask'), ('laravel', 'laravel'), ('express', 'express'), ('wordpress', 'wp-content'), ('rails', 'rails'), ('spring', 'spring')) SELECT page_id, technology FROM pages JOIN t ON contains(lower(substr(html, 1, 3000)), mark)")
def page_technologies(spark, sf_dir):
    """Technologies by the head of a page."""
    return surface.technologies(table(spark, sf_dir, "pages"))


@query(r"SELECT page_id, regexp_matches(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '(?i)\.(css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|map|pdf|zip)$') AS is_static FROM pages")
def static_path_filter(spark, sf_dir):
    """Whether a page's path is a static file."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1).rlike(surface.STATIC).alias("is_static"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages)
  , r(n, pattern, type, priority, vectors) AS (VALUES (1, '/auth/|/login|/logout|/signin|/signout|/register|/signup|/token|/oauth|/callback|/session|/password|/verify|/confirm', 'auth', 3, ['auth_bypass', 'brute_force', 'credential_stuffing']),
    (2, '/admin|/manage|/dashboard', 'admin', 3, ['auth_bypass', 'privilege_escalation', 'info_disclosure']), (3, '/payment|/checkout|/order|/cart|/stripe|/billing|/subscription', 'rest', 3, ['auth_bypass', 'idor', 'injection']),
    (4, '/upload|/download|/file|/image|/media|/attachment|/export|/import', 'rest', 2, ['path_traversal', 'upload_bypass', 'ssrf']), (5, '/users?|/profile|/account|/me$|/preferences', 'rest', 2, ['idor', 'auth_bypass', 'info_disclosure']),
    (6, '/config|/settings|/env|/debug|/status|/health|/info|/metrics|/version', 'config', 2, ['info_disclosure', 'auth_bypass', 'secrets_leak'])),
  q AS (SELECT page_id, path || extra AS path FROM (SELECT page_id, lower(path) AS path, CASE page_id % 11 WHEN 0 THEN '/login/users' WHEN 1 THEN '/gql' WHEN 2 THEN '/rpc' WHEN 3 THEN '/cart' WHEN 4 THEN '/settings/upload' WHEN 5 THEN '/websocket' ELSE '' END AS extra FROM p)),
  m AS (SELECT page_id, path, arg_max(type, n) AS type, max(priority) AS priority FROM q LEFT JOIN r ON regexp_matches(path, pattern) GROUP BY ALL)
  SELECT page_id, CASE WHEN contains(path, 'graphql') OR contains(path, 'gql') THEN 'graphql' WHEN starts_with(path, '/ws') OR contains(path, 'websocket') THEN 'websocket' WHEN contains(path, '/rpc') OR contains(path, '/jsonrpc') THEN 'rpc' ELSE coalesce(type, 'rest') END AS type,
    CASE WHEN contains(path, 'graphql') OR contains(path, 'gql') THEN 2 WHEN starts_with(path, '/ws') OR contains(path, 'websocket') THEN 1 WHEN contains(path, '/rpc') OR contains(path, '/jsonrpc') THEN 2 ELSE coalesce(priority, 1) END AS priority FROM m""")
def endpoint_classify(spark, sf_dir):
    """Endpoint kinds and priorities of page paths, some with an ending of a kind."""
    n = F.col("page_id") % 11
    ending = F.when(n == 0, "/login/users").when(n == 1, "/gql").when(n == 2, "/rpc").when(n == 3, "/cart").when(n == 4, "/settings/upload").when(n == 5, "/websocket").otherwise("")
    c = surface.classify_endpoint(F.concat(F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1), ending))
    return table(spark, sf_dir, "pages").select("page_id", c["type"].alias("type"), c["priority"].alias("priority"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'unknown' ELSE 'unknown' END AS language, lower(lang) AS ext FROM documents")
def language_detect(spark, sf_dir):
    """SRC8 over document paths: natural-language suffixes are no programming language."""
    return files(spark, sf_dir).select("doc_id", sources.language(F.col("path")).alias("language"), sources.extension(sources.base_name(F.col("path"))).alias("ext"))


@query("SELECT doc_id, source || '/' || doc_id || '.' || lang AS path FROM documents WHERE lang IN ('en', 'de') AND source NOT IN ('src1', 'src2') ORDER BY path LIMIT 50000")
def scan_code_files(spark, sf_dir):
    """SRC1 to SRC3: files of two suffixes outside of ignored trees, at most 50,000 in path order (the feature)."""
    named = sources.with_names(files(spark, sf_dir).drop("ext"))
    return sources.scan(sources.not_ignored(named, ["/src1/", "/src2/", "/src3/", "!/src3/"]), ["en", "de"]).select("doc_id", "path")


@query()
def detector_catalogue(spark, sf_dir):
    """All line detectors over documents, counted (look-around patterns: no oracle)."""
    return detectors.detect(files(spark, sf_dir)).groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query()
def detector_windows(spark, sf_dir):
    """All window, signature and presence detectors over documents, counted."""
    return detectors.detect_windows(files(spark, sf_dir)).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def provider_secrets(spark, sf_dir):
    """Provider token formats over lines."""
    return secrets.provider_secrets(lines(spark, sf_dir), ["doc_id"])
