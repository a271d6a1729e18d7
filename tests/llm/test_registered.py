"""All eleven queries are registered: a name missing from an import must not make them vanish."""


def test_all_eleven_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names
