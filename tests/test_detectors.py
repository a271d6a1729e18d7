"""Twins: every detector fires on the bad line and is silent on the good one."""

import pytest

from tracewright.operators import detectors, shapes
from tracewright.functions.text import lines_of

TWINS = [
    ("injection", "injection.sql", "py", 'db.execute("SELECT * FROM t WHERE id=" + x)', 'db.execute("SELECT * FROM t WHERE id=?", (x,))'),
    ("injection", "injection.command", "py", "os.system(cmd)", "subprocess.run([cmd])"),
    ("injection", "injection.code", "py", "eval(text)", "ast.literal_eval(text)"),
    ("auth", "auth.hardcoded", "py", 'password = "hunter22"', 'password = "your_password"'),
    ("auth", "auth.no_verify", "py", "requests.get(u, verify=False)", "requests.get(u, verify=True)"),
    ("buffer", "buffer.strcpy", "c", "strcpy(a, b);", "strncpy(a, b, n);"),
    ("crypto", "crypto.weak_hash", "py", "hashlib.md5(x)", "hashlib.sha256(x)"),
    ("crypto", "crypto.ecb", "py", "AES.new(k, AES.MODE_ECB)", "AES.new(k, AES.MODE_GCM)"),
    ("error_handling", "error_handling.empty_except", "py", "except ValueError: pass", "except ValueError: raise"),
    ("input_validation", "input_validation.pickle", "py", "pickle.loads(x)", "yaml.safe_load(x)"),
    ("plaintext_transmission", "plaintext_transmission.http", "py", 'u = "http://a.example/x"', 'u = "https://a.example/x"'),
    ("weak_entropy", "weak_entropy.fixed_seed", "py", "random.seed(42)", "random.seed()"),
    ("web_security", "web_security.cookie", "js", "httpOnly: false", "httpOnly: true"),
    ("dom_xss", "dom_xss.inner_html", "js", "el.innerHTML = x", "el.innerHTML = DOMPurify.sanitize(x)"),
    ("stored_xss", "stored_xss.raw", "html", "{{ x | safe }}", "{{ x }}"),
    ("template_injection", "template_injection.render", "py", "render_template_string(request.args)", "render_template('a.html')"),
    ("recursion", "recursion.unbounded_loop", "c", "while (1) {", "while (i < n) {"),
    ("dangerous_function", "dangerous_function.gets", "c", "gets(s);", "fgets(s, n, f);"),
    ("configuration", "configuration.cors_any", "js", "'Access-Control-Allow-Origin': '*'", "'Access-Control-Allow-Origin': origin"),
    ("obfuscation", "obfuscation.exec_compile", "py", "exec(compile(x, 'a', 'exec'))", "compile(x, 'a', 'exec')"),
]


@pytest.mark.parametrize("name,check,ext,bad,good", TWINS, ids=[t[1] for t in TWINS])
def test_twins(spark, name, check, ext, bad, good):
    files = spark.createDataFrame([("bad", ext, bad), ("good", ext, good), ("comment", ext, "# " + bad)], "path string, ext string, content string")
    found = {(r.path, r.check_id) for r in detectors.detect(files, [name]).collect()}
    assert ("bad", check) in found
    assert ("good", check) not in found and ("comment", check) not in found


def test_shapes_beyond_one_line(spark):
    files = spark.createDataFrame(
        [
            ("a", "x = requests.get(u)\ny = 1"), ("b", "validate(u)\nx = requests.get(u)"), ("c", "if os.path.exists(p):\n  f = open(p)"), ("d", "rows.find({k: req.body.k})"),
            ("e", "v = schema.validate(req)\nrows.find({k: req.body.k})"),
        ],
        "path string, content string",
    )
    found = {(r.path, r.check_id) for r in detectors.detect_windows(files).collect()}
    assert ("a", "injection.ssrf_window") in found and ("b", "injection.ssrf_window") not in found
    assert ("c", "concurrency.toctou") in found
    assert ("d", "signature.nosql") in found and ("e", "signature.nosql") not in found
    assert ("a", "timeout") in found


def test_lines_end_as_in_python(spark):
    text = "a\r\nb\x0bc\x85d e\n\nf\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    got = {k: [r.line for r in sorted(lines_of(df, "k").filter(f"k = {k}").collect(), key=lambda r: r.line_num)] for k in (1, 2, 3)}
    assert got == {1: text.splitlines(), 2: [], 3: []}


def test_recursion_and_same_name_pairs(spark):
    code = "def f(x):\n    return f(x - 1)\ndef g(x):\n    return f(x)\n"
    lines = lines_of(spark.createDataFrame([("a", code)], "path string, text string"), "path")
    assert [(r.line_num, r.function) for r in shapes.direct_recursion(lines, ["path"]).collect()] == [(2, "f")]
    first = spark.createDataFrame([("a", "p", 1), ("a", "q", 1)], "path string, name string, line_num int")
    second = spark.createDataFrame([("a", "p", 5), ("a", "q", 50)], "path string, name string, line_num int")
    assert [r.name for r in shapes.same_name_pairs(first, second, ["path"], 10).collect()] == ["p"]


def test_route_cover(spark):
    routes = spark.createDataFrame([("/api/users/1",), ("/apix",), ("/a/b/c",)], "route string")
    mounts = spark.createDataFrame([("/api",), ("/a/:id/*",)], "mount string")
    assert [r.route for r in shapes.uncovered(routes, mounts).collect()] == ["/apix"]
