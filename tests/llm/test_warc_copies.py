"""Lost and added copies of repeated WARC records."""

from tracewright.llm import warc


def test_lost_and_added_copies_are_located(spark, tmp_path):
    page = lambda i, body: (i, f"http://h/{i}", body)
    full = [page(1, "a"), page(2, "x"), page(2, "x"), page(2, "y"), page(None, "n")]
    made = {}
    for name, rows in {"full": full, "less": [full[0], *full[2:]], "more": [*full, page(1, "z")]}.items():
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / name), parts=1)
        made[name] = warc.trees(warc.replica(spark, str(tmp_path / name)))
    found = lambda a, b: [(r.page_id, r.state) for r in warc.audit(made[a], made[b]).collect()]
    assert found("full", "less") == [(2, "missing")] and found("less", "full") == [(2, "added")]
    assert found("full", "more") == [(1, "added")] and found("more", "full") == [(1, "missing")]


def test_multisets_of_a_segment():
    x, y, z = b"x", b"y", b"z"
    assert warc.unmatched([1, 1], [x, x], [1], [x]) == [(1, 1, "missing")]
    assert warc.unmatched([1, 2], [x, y], [1, 2, 2], [z, y, y]) == [(1, 0, "changed"), (2, 2, "added")]
