"""Connected components of an edge table by alternating large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Both
rounds only ever take minima per node, which combine before the shuffle, and
join them back to the edges, which adaptive execution can split where one node
holds many edges. Nothing but a count and a checksum of the edges reaches the
driver, and every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stage


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. Rows have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of any comparable type: (node, root) for every node that is not
    its own root, root being the least node of the component. Self links and repeated
    links are allowed; nulls are not linked. An empty table gives an empty table."""
    links = links.filter(F.col("u") != F.col("v"))
    edges = Stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges.read())
    while True:
        turned = Stage(_small_star(_large_star(edges.read())), "links")
        edges.drop()
        edges, before, mark = turned, mark, _mark(turned.read())
        if mark == before:
            return edges.read().select(F.col("u").alias("node"), F.col("v").alias("root"))
