"""Clusters of long chains."""

from tracewright.operators import memory


def test_a_long_chain_is_one_cluster(spark):
    path = [0, *range(200, 100, -1)]
    rows = [(a, b, 0.9) for a, b in zip(path, path[1:])] + [(300, 301, 0.9), (301, 302, 0.1), (400, 400, 0.9), (None, 500, 0.9)]
    got = {r.id: r.cluster for r in memory.clusters(spark.createDataFrame(rows, "source_id long, target_id long, strength double")).collect()}
    assert got == {i: 0 for i in path} | {300: 300, 301: 300, 400: 400}
