"""Remembered findings: vector and text search, fusion, decay, diversity, links and clusters."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.similarity import confidence_boost, dot, norm, relation_type, temporal_decay
from ..functions.stages import Stage
from ..functions.text import SORT_RANK, lookup, text

VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
LEAST_CONFIDENCE = 0.1
MMR_LAMBDA = 0.8


def vector_topk(memories: DataFrame, query: list[float], k: int, exclude: object = None) -> DataFrame:
    """V2, V3: the k nearest by cosine among vectors of the query's size, ties by id; a top-k without a full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = float(np.sqrt(sum(x * x for x in query)))
    some = memories.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)))
    if exclude is not None:
        some = some.filter(F.col("id") != exclude)
    n = norm(F.col("embedding"))
    scored = some.select("id", F.when((n > 0) & F.lit(size > 0), dot(F.col("embedding"), q) / (n * size)).otherwise(0.0).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def text_search(memories: DataFrame, words: list[str], k: int, column: str = "content") -> DataFrame:
    """V4: memories with all words, ranked by how often they occur for the text's length (a rank of our own)."""
    cut = F.split(F.lower(text(F.col(column))), r"[^a-z0-9]+")
    hits = F.size(F.filter("cut", lambda w: w.isin(words)))
    found = memories.withColumn("cut", cut).filter(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.col("cut"), w)))
    return found.withColumn("rank", hits / F.sqrt(F.size("cut").cast("double"))).drop("cut").orderBy(F.desc("rank"), "id").limit(k)


def substring_search(memories: DataFrame, query: str, columns: list[str], k: int) -> DataFrame:
    """V5: any column contains the query, case left aside; newest first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(text(F.col(c).cast("string"))).contains(query.lower())
    return memories.filter(hit).orderBy(F.desc("created_at"), "id").limit(k)


def hybrid_fusion(by_vector: DataFrame, by_text: DataFrame) -> DataFrame:
    """V6: lists (id, score), each divided by its best, joined in full and weighed."""
    best = lambda df, out: df.withColumn("top", F.max("score").over(Window.partitionBy())).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias(out))
    both = best(by_vector, "v").join(best(by_text, "t"), "id", "full")
    return both.select("id", (VECTOR_WEIGHT * F.coalesce("v", F.lit(0.0)) + TEXT_WEIGHT * F.coalesce("t", F.lit(0.0))).alias("score"))


def ranked(scored: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    """V6 to V8: fused scores with decay and confidence."""
    met = scored.join(memories.select("id", "created_at", "confidence"), "id")
    return met.withColumn("score", confidence_boost(F.col("score") * temporal_decay(F.col("created_at"), as_of), F.col("confidence")))


def memory_order(memories: DataFrame, as_of: Column) -> DataFrame:
    """T5 with FLT13: severity, then freshness times confidence; little-trusted memories are dropped."""
    some = memories.filter(F.col("confidence") >= LEAST_CONFIDENCE)
    fresh = temporal_decay(F.col("created_at"), as_of) * F.col("confidence")
    return some.withColumn("weight", F.round(fresh, 9)).orderBy(lookup(F.col("severity"), SORT_RANK, 5), F.desc("weight"), "id")


def similar_edges(memories: DataFrame, least: float = 0.75, most: int = 3, block: str = "label") -> DataFrame:
    """For every memory its ``most`` nearest of ``least`` or more within its block (a category), as edges.

    Vectors of a block are compared tile by tile: each is dealt to the tiles it meets, and a task holds two tiles, so
    that a large block is many bounded tasks and pairs are never spelled out before they are scored.
    """
    tile_rows = 512
    sized = memories.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    placed = memories.select("id", block, "embedding").join(sized, block).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select("id", block, "embedding", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["embedding"].tolist(), np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        x = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
        ids, tile = pdf["id"].to_numpy(), pdf["tile"].to_numpy()
        same = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        score = np.einsum("ik,jk->ij", x, x)
        ok = (score >= least) & (ids[:, None] != ids[None, :]) & (np.ones_like(score, bool) if same else tile[:, None] != tile[None, :])
        out = []
        for i in np.flatnonzero(ok.any(axis=1)):
            near = np.flatnonzero(ok[i])
            near = near[np.lexsort((ids[near], -score[i, near]))][:most]
            out += [(ids[i], ids[j], float(score[i, j])) for j in near]
        return pd.DataFrame(out, columns=["source_id", "target_id", "strength"])

    kind = dict(memories.dtypes)["id"]
    found = sent.groupBy(block, "low", "high").applyInPandas(tiles, f"source_id {kind}, target_id {kind}, strength double")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc(F.round("strength", 9)), "target_id"))
    return found.withColumn("rn", rank).filter(F.col("rn") <= most).drop("rn")


def similar_sets(df: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """Pairs (a, b, jaccard) of rows whose distinct ``items`` overlap by ``least`` or more. With items in the order of
    rarity, two such sets share one among the first n - ceil(least * n) + 1 of each, so only those are joined, and
    frequent items meet nobody."""
    each = df.select(key, F.explode(items).alias("item"))
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts, "item").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("s"))
    sets = ranked.select(key, F.transform("s", lambda x: x["item"]).alias("s")).withColumn("n", F.size("s"))
    heads = sets.select(key, F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("item"))
    met = heads.select(F.col(key).alias("a"), "item").join(heads.select(F.col(key).alias("b"), "item"), "item").filter("a < b").select("a", "b").distinct()
    met = met.join(sets.select(F.col(key).alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col(key).alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard")).filter(F.col("jaccard") >= least)


def related(edges: DataFrame, memories: DataFrame, of: object) -> DataFrame:
    """What an edge links with one memory, either way where the edge goes both ways."""
    out = edges.filter(F.col("source_id") == of).select(F.col("target_id").alias("id"), "relation_type", "strength")
    back = edges.filter((F.col("target_id") == of) & F.col("bidirectional")).select(F.col("source_id").alias("id"), "relation_type", "strength")
    return out.union(back).join(memories, "id", "left").orderBy(F.desc("strength"), "id")


def relations(pairs: DataFrame) -> DataFrame:
    """V12 over joined pairs with finding types and categories."""
    return pairs.withColumn("relation_type", relation_type(F.col("a_type"), F.col("b_type"), F.col("a_category"), F.col("b_category")))


def clusters(edges: DataFrame, least: float = 0.75) -> DataFrame:
    """(id, cluster) over edges of ``least`` strength or more, cluster being the least id of the component.

    Components are found by alternating star rounds until no edge changes, however long a chain is. Null ends link nothing.
    """
    e = edges.filter(F.col("strength") >= least).select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    e = Stage(e.distinct(), "edges").read()
    ids = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id"))).distinct()
    roots = components(e)
    return ids.join(roots, ids.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("cluster"))


def mmr(candidates: DataFrame, keys: list[str], k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Per key, of a bounded candidate list (id, score, embedding), k picked one by one for score and difference
    from what is picked: weight * score / best - (1 - weight) * highest cosine. Ties go to the lower id."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.array(pdf["embedding"].tolist(), np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        x = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
        left, chosen, near = list(range(len(pdf))), [], np.zeros(len(pdf))
        score = pdf["score"].to_numpy(float)
        while left and len(chosen) < k:
            top = max(score[left].max(), 1e-12)
            value = weight * score[left] / top - (1 - weight) * near[left]
            best = left[int(np.argmax(np.round(value, 12)))]
            chosen.append(best)
            left.remove(best)
            near = np.maximum(near, x @ x[best])
        out = pdf.loc[chosen, [*keys, "id", "score"]]
        out["place"] = range(1, len(chosen) + 1)
        return out

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in candidates.select(*keys, "id").schema]
    return candidates.groupBy(*keys).applyInPandas(pick, ", ".join([*fields, "score double", "place int"]))


def pattern_profile(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, confirmed and false positives by pattern."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("label") == "tp").alias("confirmed"), F.count_if(F.col("label") == "fp").alias("false_positives"))


