"""Statistics of variants: allele counts, frequencies and call rates; sites of high quality; splitting of multi-allelic variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelarium.functions.calls import local_to_global, min_rep, n_alt
from allelarium.model import VARIANT, CallSet
from allelarium.operators.filters import filter_genotypes, filter_to_exome_intervals


def allele_counts(cs: CallSet) -> DataFrame:
    """Variants with AC (alternate alleles of all calls) and AF = AC / (2 * calls); without a call AC is 0 and AF is NaN."""
    counts = cs.entries.groupBy(*VARIANT).agg(F.sum("n_alt").alias("AC"), F.count("n_alt").alias("n_called"))
    out = cs.variants.drop("AC", "AF", "n_called").join(counts, [*VARIANT], "left")
    called = F.coalesce("n_called", F.lit(0)).cast("long")
    share = F.when(called > 0, F.col("AC") / (2 * F.col("n_called"))).otherwise(F.lit(float("nan")))
    return out.withColumn("AF", share).withColumn("AC", F.coalesce("AC", F.lit(0)).cast("long")).withColumn("n_called", called)


def variant_qc(cs: CallSet) -> DataFrame:
    """(variant, AC [ref, alt], AF [ref, alt], AN, n_called, call_rate); the call rate is of all samples."""
    n = cs.samples.agg(F.count("*").alias("n_samples"))
    counts = cs.entries.groupBy(*VARIANT).agg(F.sum("n_alt").alias("alt"), F.count("n_alt").alias("n_called"))
    rows = cs.variants.select(*VARIANT).join(counts, [*VARIANT], "left").crossJoin(F.broadcast(n))  # one row
    called = F.coalesce("n_called", F.lit(0)).cast("long")
    alt, total = F.coalesce("alt", F.lit(0)).cast("long"), 2 * called
    share = lambda c: F.when(called > 0, c / total).otherwise(F.lit(float("nan")))
    return rows.select(
        *VARIANT, F.array(total - alt, alt).alias("AC"), F.array(share(total - alt), share(alt)).alias("AF"), total.alias("AN"), called.alias("n_called"), F.try_divide(called, F.col("n_samples")).alias("call_rate")
    )


def common_sites(cs: CallSet, *, maf_thresh: float = 0.01, mac_thresh: int = 10, call_rate_thresh: float = 0.95) -> DataFrame:
    """Keys of variants whose rarest allele is over maf_thresh and has mac_thresh copies, with a call rate over call_rate_thresh."""
    least_af = F.array_min("AF")
    good = (least_af > maf_thresh) & ~F.isnan(least_af) & (F.col("call_rate") > call_rate_thresh) & (F.array_min("AC") >= mac_thresh)
    return variant_qc(cs).where(good).select(*VARIANT)


def high_quality_sites(cs: CallSet, low_complexity: DataFrame, exome: DataFrame, *, is_gatk: bool, dp_thresh: int = 10, gq_thresh: int = 20, ab_thresh: float = 0.2, maf_thresh: float = 0.01, mac_thresh: int = 10, call_rate_thresh: float = 0.95) -> DataFrame:
    """Keys of common variants in the exome, outside low complexity, judged by genotypes that pass."""
    kept = filter_to_exome_intervals(cs, low_complexity, exome, is_gatk=is_gatk)
    kept = filter_genotypes(kept, is_gatk=is_gatk, dp_thresh=dp_thresh, gq_thresh=gq_thresh, ab_thresh=ab_thresh)
    return common_sites(kept, maf_thresh=maf_thresh, mac_thresh=mac_thresh, call_rate_thresh=call_rate_thresh)


def calls_from_local(entries: DataFrame) -> DataFrame:
    """Entries with `gt` and `n_alt`, from `lgt` and `la` where there is no `gt`."""
    if "gt" not in entries.columns:
        if not {"lgt", "la"} <= set(entries.columns):
            raise ValueError("entries have neither gt nor lgt and la")
        entries = entries.withColumn("gt", local_to_global(F.col("lgt"), F.col("la")))
    return entries.withColumn("n_alt", n_alt(F.col("gt")))


def split_multi(cs: CallSet) -> CallSet:
    """A row for each alternate allele in least representation; other alleles count as the reference.

    gt is recoded to 0 and 1, ad to [others, this allele]; other fields stay. A
    variant without alternate alleles has no row.
    """
    alt = F.posexplode(F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(0)))).alias("_i", "_alt")
    rest = [c for c in cs.variants.columns if c not in VARIANT]
    rows = cs.variants.select(*VARIANT, *rest, alt)
    least = min_rep(F.col("position"), F.get("alleles", F.lit(0)), F.col("_alt"))
    rows = rows.select("contig", F.col("position").alias("_position"), F.col("alleles").alias("_alleles"), (F.col("_i") + 1).alias("a_index"), least.alias("_m"), *rest, (F.size("alleles") > 2).alias("was_split"))
    rows = rows.select("contig", F.col("_m.position").alias("position"), F.array("_m.ref", "_m.alt").alias("alleles"), "_position", "_alleles", "a_index", "was_split", *rest)
    keys = rows.select("contig", F.col("position").alias("_new"), F.col("alleles").alias("_new_alleles"), F.col("_position").alias("position"), F.col("_alleles").alias("alleles"), "a_index")
    old = cs.entries.join(keys, [*VARIANT])
    changed = {"gt", "ad", "n_alt", *VARIANT, "s"}
    i = F.col("a_index")
    new = []
    if "gt" in cs.entries.columns:
        gt = F.transform("gt", lambda a: F.when(a == i, 1).when(a.isNotNull(), 0))
        new = [gt.alias("gt"), n_alt(gt).alias("n_alt")]
    else:
        new = [F.col("n_alt")]
    if "ad" in cs.entries.columns:
        own = F.get("ad", i)
        others = F.aggregate(F.filter("ad", lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) - F.coalesce(own, F.lit(0))
        new.append(F.when(F.col("ad").isNotNull(), F.array(others, own)).alias("ad"))
    entries = old.select("contig", F.col("_new").alias("position"), F.col("_new_alleles").alias("alleles"), "s", *new, *(c for c in cs.entries.columns if c not in changed))
    return cs.with_(variants=rows.drop("_position", "_alleles"), entries=entries)


def union_rows(sets: list[CallSet]) -> CallSet:
    """Call sets of the same samples over different variants, one after the other; the samples are those of the first."""
    if not sets:
        raise ValueError("no call sets")
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return sets[0].with_(variants=union([c.variants for c in sets]), entries=union([c.entries for c in sets]))
