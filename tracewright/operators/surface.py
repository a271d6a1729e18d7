"""Surfaces: links, forms, technologies, routes, exposure checks, probe responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of

STATIC = r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|map|pdf|zip)$"
API = r"(?i)(/api/|/v[12]/|/graphql)"
#: Characters of a form that are looked at.
FORM_CHARS = 2000
HEAD_CHARS = 3000

#: What pages of a technology show in their first characters.
TECHNOLOGIES = {
    "react": "react", "next.js": "next", "vue": "vue", "angular": "angular", "django": "django", "flask": "flask", "laravel": "laravel", "express": "express",
    "wordpress": "wp-content", "rails": "rails", "spring": "spring",
}


def links(pages: DataFrame) -> DataFrame:
    """(page_id, value, kind): targets of href and src on the page's own host; static files only from src."""
    host = F.parse_url("url", F.lit("HOST"))
    found = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(r"href=[\"']([^\"'#]+)"), F.lit(1)), lambda v: F.struct(F.lit("href").alias("attr"), v.alias("value"))),
        F.transform(F.regexp_extract_all("html", F.lit(r"src=[\"']([^\"'#]+)"), F.lit(1)), lambda v: F.struct(F.lit("src").alias("attr"), v.alias("value"))),
    )
    out = pages.select("page_id", host.alias("host"), F.explode(found).alias("l")).select("page_id", "host", "l.*")
    absolute = F.col("value").rlike(r"^https?://")
    same = ~absolute | (F.regexp_extract("value", r"^https?://([^/:?#]+)", 1) == F.col("host"))
    path = F.when(absolute, F.regexp_extract("value", r"^https?://[^/]+(/[^?#]*)?", 1)).otherwise(F.regexp_extract("value", r"^([^?#]*)", 1))
    out = out.filter(same & ~F.col("value").rlike(r"^(mailto|javascript|tel|data):")).withColumn("path", F.when(path == "", "/").otherwise(path))
    out = out.filter((F.col("attr") == "src") | ~F.col("path").rlike(STATIC))
    return out.select("page_id", F.col("path").alias("value"), F.when(F.col("path").rlike(API), "api").otherwise("url").alias("kind")).distinct()


def forms(pages: DataFrame) -> DataFrame:
    """(page_id, action, method, inputs) of every form."""
    chunks = F.regexp_extract_all("html", F.lit(rf"(?i)(<form[\s\S]{{0,{FORM_CHARS}}})"), F.lit(1))
    one = pages.select("page_id", F.explode(chunks).alias("form")).withColumn("form", F.regexp_extract("form", r"(?i)^([\s\S]*?)(</form>|$)", 1))
    action, method = F.regexp_extract("form", r"(?i)^<form[^>]*action=[\"']([^\"']*)", 1), F.regexp_extract("form", r"(?i)^<form[^>]*method=[\"']([^\"']*)", 1)
    inputs = F.regexp_extract_all("form", F.lit(r"(?i)<(?:input|select|textarea)[^>]*name=[\"']([^\"']*)"), F.lit(1))
    return one.select("page_id", F.when(action == "", "/").otherwise(action).alias("action"), F.upper(F.when(method == "", "GET").otherwise(method)).alias("method"), inputs.alias("inputs"))


def technologies(pages: DataFrame) -> DataFrame:
    """(page_id, technology) by what the head of a page shows."""
    head = F.lower(F.substring("html", 1, HEAD_CHARS))
    names = F.array_compact(F.array(*(F.when(head.contains(mark), name) for name, mark in TECHNOLOGIES.items())))
    return pages.select("page_id", F.explode(names).alias("technology"))


def merge_sites(parts: DataFrame) -> DataFrame:
    """Sites (site, kind, value, seq) merged: distinct sorted values per kind; a header's last value counts."""
    header = F.col("kind") == "header"
    plain = parts.filter(~header).groupBy("site", "kind").agg(F.sort_array(F.collect_set("value")).alias("items"))
    name = F.substring_index("value", ":", 1)
    last = parts.filter(header).groupBy("site", "kind", name.alias("name")).agg(F.max_by("value", "seq").alias("value"))
    return plain.unionByName(last.groupBy("site", "kind").agg(F.sort_array(F.collect_list("value")).alias("items")))


def robots(files: DataFrame) -> DataFrame:
    """(path, kind, value) of a robots file's lines."""
    line = F.trim("line")
    rule = lambda name: F.trim(F.regexp_extract(line, rf"(?i)^{name}:\s*(.*)$", 1))
    seen = lines_of(files, "path", text="content").select("path", F.array(F.struct(F.lit("disallowed").alias("kind"), rule("disallow").alias("value")), F.struct(F.lit("url").alias("kind"), rule("allow").alias("value")), F.struct(F.lit("sitemap").alias("kind"), rule("sitemap").alias("value"))).alias("r"))
    out = seen.select("path", F.explode("r").alias("r")).select("path", "r.*").filter("value <> '' AND NOT (kind = 'disallowed' AND value = '/')")
    return out


def sitemap(files: DataFrame) -> DataFrame:
    """(path, value): paths of the <loc> elements, whatever their namespace."""
    found = F.xpath("content", F.lit("//*[local-name()='loc']/text()"))
    return files.select("path", F.explode(found).alias("loc")).select("path", F.coalesce(F.parse_url(F.trim("loc"), F.lit("PATH")), F.lit("/")).alias("value"))


def route_path(raw: Column) -> Column:
    """Leading slash, and {name} for every style of parameter."""
    p = F.regexp_replace(raw, r"<(?:[a-z]+:)?([A-Za-z_][A-Za-z0-9_]*)>", "{$1}")
    p = F.regexp_replace(p, r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")
    p = F.regexp_replace(p, r"\[(?:\.\.\.)?([A-Za-z_][A-Za-z0-9_]*)\]", "{$1}")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


#: Route patterns per framework: groups verb and path; verb null means ALL. Priority decides which framework a tree has.
ROUTES = [
    ("express", 1, r"(?:app|router)\.(get|post|put|delete|patch|use|all)\s*\(\s*[\"'`]([^\"'`]+)"), ("fastapi", 2, r"@\w+\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)"),
    ("flask", 3, r"@\w+\.(route)\s*\(\s*[\"']([^\"']+)"), ("django", 4, r"\b(path|re_path|url)\s*\(\s*r?[\"']([^\"']*)"), ("go", 5, r"\.(HandleFunc|Handle)\s*\(\s*\"([^\"]+)"),
    ("spring", 6, r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?\"([^\"]+)"), ("aspnet", 7, r"\[(?:Http)(Get|Post|Put|Delete|Patch)\(\"([^\"]+)"), ("nestjs", 8, r"@(Get|Post|Put|Delete|Patch)\s*\(\s*'([^']+)"),
    ("rails", 9, r"^\s*(get|post|put|delete|patch)\s+[\"']([^\"']+)"), ("laravel", 10, r"Route::(get|post|put|delete|patch|any)\s*\(\s*[\"']([^\"']+)"), ("rust", 11, r"#\[(get|post|put|delete|patch)\(\"([^\"]+)"), ("phoenix", 12, r"^\s*(get|post|put|delete|patch)\s+\"([^\"]+)\",\s*[A-Z]"),
]


def routes(files: DataFrame) -> DataFrame:
    """(path, line_num, framework, priority, method, route): first of each (route, method) per file and framework."""
    lines = lines_of(files, "path", text="content")
    found = []
    for n, k, p in ROUTES:
        hits = lines.filter(F.col("line").rlike(p)).select("path", "line_num", F.explode(F.regexp_extract_all("line", F.lit(p), F.lit(0))).alias("m"))
        found.append(hits.select("path", "line_num", F.lit(n).alias("framework"), F.lit(k).alias("priority"), F.upper(F.regexp_extract("m", p, 1)).alias("verb"), F.regexp_extract("m", p, 2).alias("raw")))
    resources = lines.filter(F.col("line").rlike(r"^\s*resources\s+:[a-z_]+")).select("path", "line_num", F.lit("rails").alias("framework"), F.lit(9).alias("priority"), F.lit("ALL").alias("verb"), F.regexp_extract("line", r"resources\s+:([a-z_]+)", 1).alias("raw"))
    out = resources
    for f in found:
        out = out.unionByName(f)
    method = F.when(F.col("verb").isin("GET", "POST", "PUT", "DELETE", "PATCH"), F.col("verb")).otherwise("ALL")
    return out.select("path", "framework", "priority", method.alias("method"), route_path(F.col("raw")).alias("route"), "line_num").groupBy("path", "framework", "priority", "method", "route").agg(F.min("line_num").alias("line_num"))


def file_routes(files: DataFrame) -> DataFrame:
    """Routes of a tree where files are routes: what follows pages, app or api, without extension and index."""
    kept = files.filter(F.col("path").rlike(r"(^|/)(pages|app)/.*\.(jsx?|tsx?)$"))
    inner = F.regexp_extract("path", r"(?:^|/)(?:pages|app)/(.*)\.(?:jsx?|tsx?)$", 1)
    return kept.select("path", route_path(F.regexp_replace(inner, r"(^|/)(index|page|route)$", "")).alias("route"))


def openapi_paths(files: DataFrame) -> DataFrame:
    """(path, route) of an OpenAPI document."""
    doc = F.from_json("content", "paths map<string,string>")
    return files.filter(F.col("content").contains('"openapi"') | F.col("content").contains('"swagger"')).select("path", F.explode(F.map_keys(doc["paths"])).alias("route"))


def graphql_fields(files: DataFrame) -> DataFrame:
    """(path, operation, field) of schema types Query and Mutation."""
    body = lambda n: F.regexp_extract("content", rf"type\s+{n}\s*\{{([^}}]*)\}}", 1)
    out = None
    for n in ("Query", "Mutation"):
        part = files.select("path", F.lit(n).alias("operation"), F.explode(F.regexp_extract_all(body(n), F.lit(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*[(:]"), F.lit(1))).alias("field"))
        out = part if out is None else out.unionByName(part)
    return out


# Endpoint rules over lower-case paths (pattern, type, priority, vectors), and the kinds told before them.
ENDPOINTS = [
    ("/auth/|/login|/logout|/signin|/signout|/register|/signup|/token|/oauth|/callback|/session|/password|/verify|/confirm", "auth", 3, ["auth_bypass", "brute_force", "credential_stuffing"]),
    ("/admin|/manage|/dashboard", "admin", 3, ["auth_bypass", "privilege_escalation", "info_disclosure"]),
    ("/payment|/checkout|/order|/cart|/stripe|/billing|/subscription", "rest", 3, ["auth_bypass", "idor", "injection"]),
    ("/upload|/download|/file|/image|/media|/attachment|/export|/import", "rest", 2, ["path_traversal", "upload_bypass", "ssrf"]),
    ("/users?|/profile|/account|/me$|/preferences", "rest", 2, ["idor", "auth_bypass", "info_disclosure"]),
    ("/config|/settings|/env|/debug|/status|/health|/info|/metrics|/version", "config", 2, ["info_disclosure", "auth_bypass", "secrets_leak"]),
]
EARLY_ENDPOINTS = [
    ("graphql|gql", "graphql", 2, ["introspection", "injection", "dos_query", "auth_bypass"]), ("^/ws|websocket", "websocket", 1, ["injection", "auth_bypass"]),
    ("/rpc|/jsonrpc", "rpc", 2, ["method_enumeration", "injection", "auth_bypass"]),
]
USUAL_VECTORS = ["auth_bypass", "injection", "info_disclosure"]


def classify_endpoint(path: Column) -> Column:
    """struct(type, priority, vectors): early kinds first, then all rules fold: last type, highest priority, joined vectors."""
    low = F.lower(path)
    words = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    made = lambda t, n, v: F.struct(t.alias("type"), n.alias("priority"), v.alias("vectors"))
    hits = [low.rlike(p) for p, *_ in ENDPOINTS]
    kind = F.coalesce(*(F.when(h, t) for h, (_, t, _, _) in reversed(list(zip(hits, ENDPOINTS)))), F.lit("rest"))
    priority = F.greatest(*(F.when(h, n).otherwise(1) for h, (_, _, n, _) in zip(hits, ENDPOINTS)))
    vectors = F.array_distinct(F.flatten(F.array(*(F.when(h, words(v)).otherwise(words([])) for h, (_, _, _, v) in zip(hits, ENDPOINTS)))))
    out = made(kind, priority, F.when(F.size(vectors) == 0, words(USUAL_VECTORS)).otherwise(vectors))
    for p, t, n, v in reversed(EARLY_ENDPOINTS):
        out = F.when(low.rlike(p), made(F.lit(t), F.lit(n), words(v))).otherwise(out)
    return out


def discovery_score(sites: DataFrame, findings: DataFrame) -> DataFrame:
    """(site, score) from counted surface less weighed findings."""
    n = lambda k: F.count_if(F.col("kind") == k)
    size = sites.groupBy("site").agg(F.least(n("api") * 2 + n("url") + n("form") * 3, F.lit(100)).alias("size"))
    sev = F.col("severity")
    bad = findings.groupBy("site").agg(F.sum(F.when(sev == "critical", 20).when(sev == "high", 10).when(sev == "medium", 5).when(sev == "low", 2).otherwise(0)).alias("bad"))
    raw = F.least(F.greatest(F.lit(0), F.col("size") - F.coalesce("bad", F.lit(0))) / 100, F.lit(1.0))
    return size.join(bad, "site", "left").select("site", (F.floor(raw * 100 + 0.5) / 100).alias("score"))


REQUIRED_HEADERS = ["content-security-policy", "strict-transport-security", "x-content-type-options", "x-frame-options"]


def missing_headers(sites: DataFrame) -> DataFrame:
    """(site, header) of required headers a site does not send."""
    wanted = sites.select("site").distinct().withColumn("header", F.explode(F.array(*map(F.lit, REQUIRED_HEADERS))))
    sent = sites.filter("kind = 'header'").select("site", F.lower(F.substring_index("value", ":", 1)).alias("header"))
    return wanted.join(sent, ["site", "header"], "left_anti")


def exposures(sites: DataFrame) -> DataFrame:
    """(site, title): debug endpoints, version disclosure, sensitive files and introspection, once each."""
    v, k = F.col("value"), F.col("kind")
    title = F.when(k.isin("url", "api") & v.rlike(r"(?i)/(debug|actuator|phpinfo|server-status)"), "Debug endpoint").when(k.isin("url", "api") & v.rlike(r"(?i)/(\.env|\.git/|backup|id_rsa)"), "Sensitive file")
    title = title.when(k.isin("url", "api") & v.rlike(r"(?i)graphi?ql"), "Query introspection").when((k == "header") & v.rlike(r"(?i)^(server|x-powered-by):.*[0-9]"), "Version disclosed").when(v.rlike(r"(?i)index of /"), "Directory listing")
    return sites.select("site", title.alias("title")).filter("title IS NOT NULL").distinct()


def analyze_response(status: Column, headers: Column, body: Column, payload: Column, category: Column) -> Column:
    """First rule that fires, gated by the finding's category, or null."""
    b, c = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    has = lambda h: F.array_contains(F.transform(F.map_keys(headers), F.lower), h)
    return F.coalesce(
        F.when(c.contains("sql") & (b.rlike(r"(sql syntax|sqlite|ora-[0-9]+|psql)") | ((status == 500) & payload.contains("'"))), "sql_error"),
        F.when(c.contains("xss") & payload.rlike("<script|onerror=") & F.contains(b, F.lower(payload)), "reflected"),
        F.when(c.contains("travers") & b.rlike(r"root:x:0:|\[boot loader\]"), "file_read"),
        F.when(c.contains("disclos") & b.rlike("traceback|stack trace|exception in"), "disclosure"),
        F.when(c.contains("header") & ~has("content-security-policy"), "missing_header"),
        F.when(c.contains("cookie") & has("set-cookie") & ~F.lower(F.coalesce(F.try_element_at(headers, F.lit("set-cookie")), F.lit(""))).contains("httponly"), "cookie_flags"),
        F.when(c.contains("auth") & (status == 200) & b.rlike("admin|dashboard|internal"), "protected_content"),
        F.when(c.contains("upload") & status.isin(200, 201), "upload_accepted"),
        F.when(c.rlike("chaos|resilience") & (status >= 500), "not_resilient"),
    )


def json_urls(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, url): addresses anywhere in a JSON text, distinct."""
    return df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\"((?:https?:/)?/[^\"\s]*)\""), F.lit(1)))).alias("url"))
