"""Token counts from an exact length histogram.

Documents are encoded and aggregated by encoded length; everything else is a
suffix sum over the histogram, which has one row for each distinct length and
so stays small whatever the corpus. For a context limit c equal to a length of
the histogram (`limits` evaluates any other): `n_longer` documents have more
than c tokens and `truncated_tokens` = sum of min(length, c).

The suffix sums run in two levels - within blocks of `BLOCK` lengths, then over
the blocks' totals - so no task gets the whole histogram at once.

Edge cases: null and empty texts have length 0 and are counted; repeated rows
count each time; an empty table gives an empty histogram; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelarium.llm.common import Scratch, read_table
from allelarium.llm.sentencepiece_codec import encode_decode

BLOCK = 1024


def length_histogram(docs: DataFrame, *, model_path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    lengths = encode_decode(docs, ("n_tokens",), model_path=model_path)
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length c of the histogram the totals at, above and up to it."""
    h = histogram.select("n_tokens", "n_docs", F.expr(f"n_tokens div {BLOCK}").alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(over), F.lit(0)).alias("before_docs"),
        F.coalesce(F.sum("b_tokens").over(over), F.lit(0)).alias("before_tokens"),
        F.sum("b_docs").over(whole).alias("all_docs"),
        F.sum("b_tokens").over(whole).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens")
    at = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("before_docs") + F.sum("n_docs").over(within)).alias("docs_up_to"),
        (F.col("before_tokens") + F.sum("tokens").over(within)).alias("tokens_up_to"),
        "all_docs",
        "all_tokens",
    )
    longer = F.col("all_docs") - F.col("docs_up_to")
    return at.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens_at"),
        longer.alias("n_longer"),
        (F.col("all_tokens") - F.col("tokens_up_to")).alias("tokens_longer"),
        (F.col("tokens_up_to") + F.col("n_tokens") * longer).alias("truncated_tokens"),
        (F.col("all_tokens") - F.col("tokens_up_to") - F.col("n_tokens") * longer).alias("cut_tokens"),
        F.col("all_tokens").alias("total_tokens"),
        F.col("all_docs").alias("total_docs"),
        (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"),
    )


def quantiles(sums: DataFrame, at: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the least length that a share q of the documents does not exceed."""
    each = sums.select("quantile", "context_limit", F.explode(F.array([F.lit(float(q)) for q in at])).alias("q"))
    return each.where("quantile >= q").groupBy("q").agg(F.min("context_limit").alias("n_tokens"))


def limits(histogram: DataFrame, at: Sequence[int]) -> DataFrame:
    """(context_limit, n_longer, truncated_tokens) for any stated limits."""
    each = histogram.select("n_tokens", "n_docs", F.explode(F.array([F.lit(int(c)).cast("long") for c in at])).alias("context_limit"))
    return each.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("n_longer"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct encoded length of `documents`, with every suffix sum at that context limit."""
    # written, as the sums read it twice and the corpus is to be encoded once
    histogram = Scratch(spark, "token-counts").write(length_histogram(read_table(spark, sf_dir, "documents")), "histogram")
    return suffix_sums(histogram)


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
