"""Operator 1: token counts from an exact length histogram.

Documents are aggregated by their encoded length; everything a budget question
asks (totals, quantiles, totals after truncation to a context limit) is then a
suffix sum over the histogram, which is bounded by the longest document and not
by the number of documents. The sums run in two levels (blocks of lengths, then
lengths within a block), so that no task sees more than one block of lengths.

Null and empty texts have length 0. An empty table gives an empty histogram.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage
from .encoding import token_lengths

#: Lengths of a block.
BLOCK = 4096


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """From (n_tokens, n_docs), possibly repeated: one row per distinct length with

    n_docs, tokens (all of these documents), docs_from and tokens_from (documents
    at least as long), docs_below, tokens_below, truncated_total (tokens left when
    every document is cut to n_tokens), quantile (share of documents no longer).
    """
    hist = lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    # Read twice below: written, so that no text is encoded twice.
    hist = Stage(hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "histogram").read()
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = blocks.select(
        "block",
        zero("d", below).alias("d_before"),
        zero("t", below).alias("t_before"),
        F.sum("d").over(total).alias("all_docs"),
        F.sum("t").over(total).alias("all_tokens"),
    )
    inner = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(blocks, "block").withColumns(
        {"docs_below": F.col("d_before") + zero("n_docs", inner), "tokens_below": F.col("t_before") + zero("tokens", inner)}
    )
    docs_from = F.col("all_docs") - F.col("docs_below")
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_below",
        "tokens_below",
        docs_from.alias("docs_from"),
        (F.col("all_tokens") - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("n_tokens") * docs_from).alias("truncated_total"),
        ((F.col("docs_below") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def token_length_histogram(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The histogram of ``text`` under the tokenizer file ``path``, with its suffix sums."""
    return suffix_sums(token_lengths(df, path, text))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to ``limit``: one row, 0 for an empty histogram."""
    cut: Column = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return sums.select(F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_total"))


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed (null if empty)."""
    return sums.filter(F.col("quantile") >= share).select(F.min("n_tokens").alias("n_tokens"))
