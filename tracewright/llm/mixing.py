"""Operator 7: mixing sources to target weights by Sainte-Laguë apportionment.

Every source is given a target of words: a share of all words by weight, never
more than three times what it has, the excess shared again by weight. The whole
target is cut into equal blocks of words, and whole blocks are apportioned to the
sources by highest quotients target / (2k + 1), so quotas are integers that sum
up exactly. A source's documents are dealt by a seeded hash into shards of about
ROWS_A_SHARD rows and laid end to end in seeded order, shard after shard; a block
belongs to the shard in which it starts. Whole turns of the quota take every block
once more; what is left is apportioned to the shards by highest quotients of their
numbers of blocks, and each shard selects as many of its blocks as its quota says
by a seeded permutation of their numbers. Words under a selected block are taken.

Only tables with a row per source or per shard meet in one task. A source with most
of all rows has most of the shards and is sorted by many tasks; a prefix sum over
shards joins them. All arithmetic is on integers and reruns agree.

A null source is a source of its own, ordered last. Null and empty texts have
size 0 and are never taken. Rows with one doc_id are documents of their own.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, SPACE_CLASS, Stage

#: Weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST_TURNS = 3
#: The least positive target is cut into this many blocks or more.
BLOCKS_OF_LEAST = 1000
#: Rows of a shard, on average.
ROWS_A_SHARD = 4_000
SEED = 20240607
#: Primes beyond any number of blocks of a shard: multipliers of the permutations of block numbers.
PRIMES = (2147483647, 2147483629, 2147483587)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, SPACE_CLASS))
    edge = F.when(t.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    blank = ~t.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 0).otherwise(parts - edge).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, size) rows: (source, source_size, target), target as whole-number
    fraction num / den and as a double.

    The capped share is found in one pass: with sources in the order of cap / weight,
    those capped are a prefix, the shortest one after which the even share of what is
    left exceeds no cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", MOST_TURNS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    per = per.withColumns(
        {
            "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), zero),
            "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero),
        }
    )
    # A source is capped if the even share when it comes would exceed its cap.
    per = per.withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("weights"))
    free = F.min(F.when(~F.col("capped"), F.struct((-F.col("left")).alias("l"), F.col("weights").alias("w")))).over(whole)
    num = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * -free["l"])
    den = F.when(F.col("capped"), 1).otherwise(free["w"])
    return per.select("source", "source_size", num.alias("num"), den.alias("den"), (num.cast("double") / den).alias("target"))


def sainte_lague(df: DataFrame, weight: str, seats: Column, group: list[str], key: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` of each group dealt to its rows by highest quotients weight / (2k + 1), ties by ``key``.

    Rounding each row's share to a whole number leaves the sum off by less than one
    seat a row; the difference goes to the highest quotients (or comes from the
    lowest), of which each row can hold only as many as its share of the difference,
    so the list of quotients to rank has a few rows per row of ``df``.
    """
    whole, ties = Window.partitionBy(*group), [F.col(k).asc_nulls_last() for k in key]
    w = F.col(weight).cast("double")
    t = df.withColumn("seats_", seats.cast("long")).withColumns({"whole_": F.sum(w).over(whole), "n_": F.count(F.lit(1)).over(whole), "place_": F.row_number().over(whole.orderBy(*ties))})
    t = t.withColumn("share_", F.when(F.col("whole_") > 0, w / F.col("whole_")).otherwise(0.0))
    t = t.withColumn("first_", F.floor(F.col("seats_") * F.col("share_") + 0.5).cast("long"))
    t = t.withColumn("miss_", F.col("seats_") - F.sum("first_").over(whole))
    reach = F.ceil((F.abs("miss_") + F.col("n_")) * F.col("share_")).cast("int") + 1
    names = list(dict.fromkeys([*group, *key]))
    more = t.filter((F.col("miss_") != 0) & (w > 0)).select(*names, w.alias("w_"), "first_", "miss_", "place_", F.explode(F.sequence(F.lit(1), reach)).alias("k_"))
    # Adding the k-th seat has quotient w / (2 (first + k) - 1); taking the k-th away w / (2 (first - k) + 1).
    seat = F.when(F.col("miss_") > 0, F.col("first_") + F.col("k_")).otherwise(F.col("first_") - F.col("k_") + 1)
    more = more.withColumn("quotient_", F.col("w_") / (2 * seat - 1)).filter(seat >= 1)
    sign = F.when(F.col("miss_") > 0, -1).otherwise(1)
    ranked = more.withColumn("rank_", F.row_number().over(Window.partitionBy(*group).orderBy(sign * F.col("quotient_"), -sign * F.col("place_"))))
    changed = ranked.filter(F.col("rank_") <= F.abs("miss_")).groupBy(*(F.col(k).alias(f"c_{k}") for k in names)).agg(F.sum(F.signum("miss_")).cast("long").alias("change_"))
    met = t.join(changed, [t[k].eqNullSafe(changed[f"c_{k}"]) for k in names], "left")
    return met.select(*df.columns, (F.col("first_") + F.coalesce("change_", F.lit(0))).cast("long").alias("quota"))


def apportion(targets: DataFrame) -> DataFrame:
    """(source, source_size, target, block, quota): whole blocks of ``block`` words dealt to the sources."""
    whole = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    t = targets.select("source", "source_size", "target", F.greatest(F.lit(1), F.floor(least / BLOCKS_OF_LEAST)).cast("long").alias("block"))
    t = t.withColumn("all_blocks", F.round(F.sum("target").over(whole) / F.coalesce("block", F.lit(1))))
    return sainte_lague(t, "target", F.col("all_blocks"), [], ["source"]).withColumn("block", F.coalesce("block", F.lit(1).cast("long"))).drop("all_blocks")


def chosen(number: Column, shard: dict[str, Column]) -> Column:
    """Whether the block of a number is among the ``picks`` blocks that its shard (first, blocks, picks, key) selects."""
    n, key = F.greatest(F.lit(1).cast("long"), shard["blocks"]), shard["key"]
    prime = F.element_at(F.array(*(F.lit(p).cast("long") for p in PRIMES)), (F.pmod(key, F.lit(len(PRIMES))) + 1).cast("int"))
    # Steps of a prime that does not divide their count visit all numbers once.
    return F.pmod((number - shard["first"]) * F.pmod(prime, n) + F.pmod(key, n), n) < shard["picks"]


def shard_quotas(shards: DataFrame, quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """From (source, shard, size) and the sources' quotas, a row per shard: s_source, s_shard, ``ahead`` (words of the
    source before it), source_size, target, block, turns, its blocks (first, blocks, picks, key), and ``lead``: whether
    the block that reaches into it from an earlier shard is selected."""
    ahead = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    q = quotas.withColumnRenamed("source", "q_source")
    s = shards.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("long")))
    s = s.join(q, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    ceil = lambda words: F.expr(f"({words} + block - 1) div block")
    s = s.withColumn("first", ceil("ahead")).withColumn("blocks", ceil("(ahead + size)") - F.col("first"))
    s = s.withColumn("all_blocks", F.greatest(F.lit(1).cast("long"), ceil("source_size"))).withColumn("quota", F.least("quota", MOST_TURNS * F.col("all_blocks")))
    s = s.withColumn("turns", F.expr("quota div all_blocks")).withColumn("rest", F.expr("quota % all_blocks"))
    s = s.drop("quota").withColumn("key", F.expr("abs(xxhash64(%dL, source, shard) %% 1073741789)" % seed))
    s = sainte_lague(s, "blocks", F.col("rest"), ["source"], ["shard"]).withColumnRenamed("quota", "picks")
    parts = ["first", "blocks", "picks", "key"]
    owner = F.last(F.when(F.col("blocks") > 0, F.struct(*parts)), ignorenulls=True).over(ahead)
    s = s.withColumn("owner", owner)
    lead = chosen(F.expr("ahead div block"), {p: F.col("owner")[p] for p in parts})
    return s.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "ahead", "source_size", "target", "block", "turns", *parts, F.coalesce(lead, F.lit(False)).alias("lead"))


def mix(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row of ``df``: doc_id, size, source, source_size, target, taken (words), and
    copies, the number of whole copies a whole-document mix takes, and row_key.

    A whole-document mix cannot cut documents: beside whole turns a shard takes, in its
    seeded order, documents up to the number of words of its selected blocks."""
    read = df.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("row_key"))
    sized = Stage(read, "sized").read()
    rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).select(F.col("source").alias("n_source"), F.expr(f"(rows + {ROWS_A_SHARD} - 1) div {ROWS_A_SHARD}").alias("n_shards"))
    # A row per source: joined by broadcast if its size, known from the written table, allows.
    rows = Stage(rows, "rows").read()
    sized = sized.join(rows, F.col("source").eqNullSafe(F.col("n_source")))
    sized = sized.withColumn("shard", F.pmod(F.shiftright("row_key", 20), F.col("n_shards"))).drop("n_source", "n_shards")
    # Source totals, a small table by source, come from the shard totals.
    shards = Stage(sized.groupBy("source", "shard").agg(F.sum("size").alias("size")), "shards").read()
    quotas = Stage(apportion(source_targets(shards)), "quotas").read()
    dealt = Stage(shard_quotas(shards, quotas, seed), "shard-quotas").read()
    inner = Window.partitionBy("source", "shard").orderBy("row_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(inner), zero))
    met = placed.join(dealt, placed.source.eqNullSafe(dealt.s_source) & (placed.shard == dealt.s_shard))
    met = met.withColumn("a", F.col("start") + F.col("ahead"))
    size, block = F.col("size"), F.col("block")
    mine = {p: F.col(p) for p in ("first", "blocks", "picks", "key")}

    def words(number: Column) -> Column:
        """Words of the document in a block, if that is selected."""
        here = F.least(F.col("a") + size, (number + 1) * block) - F.greatest(F.col("a"), number * block)
        return F.when(F.when(number < F.col("first"), F.col("lead")).otherwise(chosen(number, mine)), here).otherwise(zero)

    numbers = F.sequence(F.expr("a div block"), F.expr("(a + size - 1) div block"))
    part = F.when(size > 0, F.aggregate(numbers, zero, lambda acc, j: acc + words(j))).otherwise(zero)
    met = met.withColumn("part", part)
    whole = Window.partitionBy("source", "shard")
    once = (F.col("start") + F.expr("size div 2") < F.sum("part").over(whole)).cast("int")
    return met.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("turns") * size + F.col("part")).cast("long").alias("taken"),
        F.when(size > 0, F.col("turns") + once).otherwise(0).cast("int").alias("copies"),
        "row_key",
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The columns of documents with every document as often as the mix takes it: whole
    turns, and once more if the document's middle word lies in the part of a turn. Rows
    that share doc_id and text share their number of copies (the largest of them)."""
    found = mix(docs, seed).filter(F.col("copies") > 0).groupBy("doc_id", "row_key").agg(F.max("copies").alias("copies"))
    found = found.withColumnRenamed("doc_id", "m_id")
    known = docs.select(DOC_COLUMNS).withColumn("row_key_", F.xxhash64(F.lit(seed), "doc_id", "text"))
    met = known.join(found, known.doc_id.eqNullSafe(F.col("m_id")) & (F.col("row_key_") == F.col("row_key")))
    return met.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(DOC_COLUMNS)
