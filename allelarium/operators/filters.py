"""Filters of call sets: lists, contigs, samples of rows, intervals, genotypes, high-quality sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelarium.functions.calls import depth
from allelarium.functions.genome import contig_index, parse_variant
from allelarium.model import VARIANT, CallSet

SEED = 1
#: Bases of one bucket of an interval join.
BUCKET = 1 << 20


def hash_sample(df: DataFrame, fraction: float, *key: str, seed: int = SEED) -> DataFrame:
    """About a share `fraction` of the rows, chosen by a hash of their key, so alike for any partitioning."""
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(round(fraction * 1_000_000)))


def head_variants(variants: DataFrame, n: int) -> DataFrame:
    """The first n variants in genome order."""
    return variants.orderBy(contig_index(F.col("contig")), "contig", "position", "alleles").limit(n)


def head_samples(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples, by their place in the file where it is known, else by id."""
    return samples.orderBy(*(["col_idx"] if "col_idx" in samples.columns else []), "s").limit(n)


def variant_keys(names: DataFrame) -> DataFrame:
    """Variant keys of a list whose first column has `chr:pos:ref:alt`; a malformed name raises when it is read."""
    name = F.col(names.columns[0])
    parsed = parse_variant(name)
    checked = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not a variant: "), name)).cast("struct<contig:string,position:int,alleles:array<string>>")).otherwise(parsed)
    return names.select(checked.alias("v")).select("v.*").distinct()


def apply_filters(
    cs: CallSet,
    *,
    sample_list: DataFrame | None = None,
    variant_list: DataFrame | None = None,
    contigs: list[str] | None = None,
    downsample_variants: float | None = None,
    downsample_samples: float | None = None,
    n_variants: int | None = None,
    n_samples: int | None = None,
    seed: int = SEED,
) -> tuple[CallSet, bool]:
    """The filters in this order; and whether variants or samples other than by the sample list were left out."""
    down = False
    if sample_list is not None:
        cs = cs.only_samples(sample_list)
    if variant_list is not None:
        cs, down = cs.only_variants(variant_keys(variant_list)), True
    if contigs:
        on = F.col("contig").isin(list(contigs))
        cs, down = cs.with_(variants=cs.variants.where(on), entries=cs.entries.where(on)), True
    if downsample_variants is not None:
        cs, down = cs.only_variants(hash_sample(cs.variants, downsample_variants, *VARIANT, seed=seed)), True
    if downsample_samples is not None:
        cs, down = cs.only_samples(hash_sample(cs.samples, downsample_samples, "s", seed=seed)), True
    if n_variants is not None:
        cs, down = cs.only_variants(head_variants(cs.variants, n_variants)), True
    if n_samples is not None:
        cs, down = cs.only_samples(head_samples(cs.samples, n_samples)), True
    return cs, down


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint (contig, start, end) with start < position <= end, from any that may overlap or touch."""
    before = Window.partitionBy("contig").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("contig").orderBy("start", "end")
    new = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    return intervals.where("start < end").withColumn("new", new).withColumn("run", F.sum("new").over(running)).groupBy("contig", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def in_intervals(rows: DataFrame, intervals: DataFrame, *, keep: bool = True) -> DataFrame:
    """Rows whose position lies in an interval, or, without `keep`, in none.

    Intervals are cut at bucket borders and joined by contig and bucket, so the
    join is one on equal keys with a residual range, never a nested loop.
    """
    merged = merge_intervals(intervals)
    buckets = F.explode(F.sequence(F.floor((F.col("start") + 1) / BUCKET), F.floor(F.col("end") / BUCKET)))
    cut = merged.select(F.col("contig").alias("_contig"), F.col("start").alias("_start"), F.col("end").alias("_end"), buckets.alias("_bucket"))
    on = (F.col("contig") == F.col("_contig")) & (F.floor(F.col("position") / BUCKET) == F.col("_bucket")) & (F.col("position") > F.col("_start")) & (F.col("position") <= F.col("_end"))
    return rows.join(cut, on, "left_semi" if keep else "left_anti")


def filter_to_exome_intervals(cs: CallSet, low_complexity: DataFrame, exome: DataFrame, *, is_gatk: bool = True) -> CallSet:
    """Loci in the exome and outside regions of low complexity; not for GATK: and with an empty, known set of filters."""
    rows = cs.variants
    if not is_gatk:
        rows = rows.where(F.size("filters") == 0)
    rows = in_intervals(in_intervals(rows, low_complexity, keep=False), exome)
    return cs.with_(variants=rows, entries=cs.entries.join(rows.select(*VARIANT), [*VARIANT], "left_semi"))


def good_genotype(*, is_gatk: bool, dp_thresh: int = 10, gq_thresh: int = 20, ab_thresh: float = 0.2, dp: Column | None = None) -> Column:
    """Whether an entry passes: called, deep and sure enough, and hets balanced. Otherwise than for GATK depth is the sum of `ad`, and only calls with an alternate allele need it."""
    total = dp if dp is not None else F.col("dp") if is_gatk else depth(F.col("ad"))
    n_alt = F.col("n_alt")
    deep = total >= dp_thresh if is_gatk else F.when(n_alt > 0, F.coalesce(total >= dp_thresh, F.lit(False))).otherwise(n_alt == 0)
    share = F.try_divide(F.get("ad", F.lit(1)).cast("double"), total.cast("double"))
    balanced = (n_alt != 1) | share.between(ab_thresh, 1 - ab_thresh)
    return F.coalesce(n_alt.isNotNull() & deep & (F.col("gq") >= gq_thresh) & balanced, F.lit(False))


def filter_genotypes(cs: CallSet, *, is_gatk: bool, dp_thresh: int = 10, gq_thresh: int = 20, ab_thresh: float = 0.2) -> CallSet:
    """Only the entries that pass; the others become missing."""
    return cs.with_(entries=cs.entries.where(good_genotype(is_gatk=is_gatk, dp_thresh=dp_thresh, gq_thresh=gq_thresh, ab_thresh=ab_thresh)))
