"""Two call sets of the same individuals: overlaps and the sparse joined cells."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelarium.model import VARIANT, CallSet


class JoinType(str, Enum):
    """Which variants are compared: those of both call sets, or of either."""

    inner = "inner"
    outer = "outer"


def check_samples(*sets: CallSet) -> None:
    """Raise where a call set has a sample id twice."""
    for side, cs in zip(("exome", "imputation"), sets, strict=False):
        twice = [r["s"] for r in cs.samples.groupBy("s").count().where("count > 1").orderBy("s").limit(20).collect()]
        if twice:
            raise ValueError(f"duplicate sample ids in the {side} call set: {', '.join(map(str, twice))}")


def _flags(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    left, right = left.select(*key, F.lit(True).alias("EXOME")), right.select(*key, F.lit(True).alias("IMPUTATION"))
    return left.join(right, key, how).select(*key, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("EXOME", "IMPUTATION")))


def sample_overlaps(exo: CallSet, imp: CallSet) -> DataFrame:
    """(s, EXOME, IMPUTATION) of every sample."""
    return _flags(exo.samples, imp.samples, ["s"], "full")


def n_sample_overlaps(exo: CallSet, imp: CallSet) -> DataFrame:
    return sample_overlaps(exo, imp).agg(F.count_if(F.col("EXOME") & F.col("IMPUTATION")).alias("n_samples"))


def variant_overlaps(exo: CallSet, imp: CallSet) -> DataFrame:
    """(contig, position, alleles, EXOME, IMPUTATION) of the variants in both."""
    return _flags(exo.variants, imp.variants, [*VARIANT], "inner")


def _struct(df: DataFrame, key: tuple[str, ...], name: str) -> DataFrame:
    fields = [F.col(c) for c in df.columns if c not in key]
    return df.select(*key, F.struct(*key, *fields).alias(name) if name.endswith(("row", "col")) else F.struct(F.lit(True).alias("present"), *fields).alias(name))


#: Samples that are sent to every task.
BROADCAST_SAMPLES = 2_000_000


def of_samples(entries: DataFrame, samples: DataFrame, how: str = "left_semi") -> DataFrame:
    """Entries joined to samples by `s`, without moving entries where the samples are at most BROADCAST_SAMPLES, which is checked."""
    few = len(samples.select("s").limit(BROADCAST_SAMPLES + 1).groupBy().count().where(F.col("count") <= BROADCAST_SAMPLES).take(1)) > 0
    return entries.join(F.broadcast(samples) if few else samples, "s", how)


def joined_samples(exo: CallSet, imp: CallSet) -> DataFrame:
    """(s, left_col, right_col) of the samples in both."""
    return _struct(exo.samples, ("s",), "left_col").join(_struct(imp.samples, ("s",), "right_col"), "s")


def joined_variants(exo: CallSet, imp: CallSet, join_type: JoinType) -> DataFrame:
    """(variant, left_row, right_row); a side's struct is NULL where it lacks the variant."""
    how = "inner" if JoinType(join_type) is JoinType.inner else "full"
    return _struct(exo.variants, VARIANT, "left_row").join(_struct(imp.variants, VARIANT, "right_row"), [*VARIANT], how)


def joined_entries(exo: CallSet, imp: CallSet) -> DataFrame:
    """(variant, s, left_entry, right_entry) of every cell that either call set has; a missing entry is a NULL struct.

    The dense grid is never built: cells that both lack are counted by arithmetic.
    """
    return _struct(exo.entries, (*VARIANT, "s"), "left_entry").join(_struct(imp.entries, (*VARIANT, "s"), "right_entry"), [*VARIANT, "s"], "full")
