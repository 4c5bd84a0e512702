"""Incremental concordance: the 25 counts are sums, so batches of joined cells add up.

A batch holds whole variants; each adds its long-form counts to a table of
totals, and rates are derived when the totals are read. Batches are told apart
by their number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from allelarium.operators.confusion import COUNTS, count_cells, with_statistics


def cell_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """The 25 counts by keys of cells with states l and r."""
    return cells.groupBy(*keys).agg(*count_cells(F.lit(1)))


def start(cells: DataFrame, totals: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Add a stream of cells (l, r and keys) to the table of totals at a path."""

    def add(batch: DataFrame, number: int) -> None:
        cell_counts(batch, *keys).write.mode("overwrite").parquet(f"{totals}/batch={number}")

    return cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_totals(spark: SparkSession, totals: str, *keys: str) -> DataFrame:
    """Counts over all batches with their rates."""
    return with_statistics(spark.read.parquet(totals).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS)))
