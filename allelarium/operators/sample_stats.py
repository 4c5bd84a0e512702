"""Statistics of samples: contamination, chimerism, call rate by genotype quality, sex, counts of calls, outliers.

Formulas that come from public methods are stated with each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelarium.functions.calls import allele_class, depth
from allelarium.functions.genome import in_autosome, in_x_nonpar
from allelarium.model import VARIANT, CallSet
from allelarium.operators.variant_stats import allele_counts

METRICS = ("n_het", "n_hom_var", "n_singleton", "n_snp", "n_insertion", "n_deletion", "n_transition", "n_transversion", "r_ti_tv", "r_het_hom_var", "r_insertion_deletion")
#: Metrics that outliers are looked for in, with the allowed deviations below and above.
OUTLIER_METRICS = ("n_singleton", "n_snp", "n_insertion", "n_deletion", "n_transition", "n_transversion", "r_ti_tv", "r_het_hom_var", "r_insertion_deletion")
MAD_SCALE = 1.4826


def contamination(cs: CallSet, *, charr_thresh: float = 0.05, min_af: float = 0.05, max_af: float = 0.95, min_dp: int = 10, max_dp: int = 100, min_gq: int = 20, ref_af: DataFrame | None = None) -> DataFrame:
    """(s, contamination {charr, is_passing}).

    CHARR: mean over a sample's homozygous alternate calls at autosomal
    biallelic SNVs of ad[0] / (ad[0] + ad[1]) / reference allele frequency, for
    frequencies in (min_af, max_af), depths in [min_dp, max_dp] and gq from
    min_gq on. `ref_af`: (variant, ref_af); without it 1 - AF of the cohort.
    A sample without such a call has NULL for both.
    """
    if ref_af is None:
        ref_af = allele_counts(cs).select(*VARIANT, (1 - F.col("AF")).alias("ref_af"))
    sites = cs.variants.select(*VARIANT).where(in_autosome(F.col("contig")) & (F.size("alleles") == 2) & (F.length(F.get("alleles", F.lit(0))) == 1) & (F.length(F.get("alleles", F.lit(1))) == 1))
    sites = sites.join(ref_af.select(*VARIANT, "ref_af"), [*VARIANT]).where((F.col("ref_af") > min_af) & (F.col("ref_af") < max_af))
    dp = F.col("dp") if "dp" in cs.entries.columns else depth(F.col("ad"))
    calls = cs.entries.where((F.col("n_alt") == 2) & dp.between(min_dp, max_dp) & (F.col("gq") >= min_gq)).join(sites, [*VARIANT])
    reference, total = F.get("ad", F.lit(0)), F.get("ad", F.lit(0)) + F.get("ad", F.lit(1))
    charr = calls.groupBy("s").agg(F.avg(F.try_divide(reference.cast("double"), total.cast("double")) / F.col("ref_af")).alias("charr"))
    return cs.samples.select("s").join(charr, "s", "left").select("s", F.struct("charr", (F.col("charr") <= charr_thresh).alias("is_passing")).alias("contamination"))


#: Samples from which on a cohort's own frequencies are taken.
OWN_FREQUENCIES = 10_000


def reference_frequencies(cs: CallSet, given: DataFrame | None = None, public: DataFrame | None = None) -> DataFrame | None:
    """(variant, ref_af) for `contamination`: the given table; else, for fewer than OWN_FREQUENCIES samples, 1 - AF of public sites (variant, AF) if there are any; else None, the cohort's own."""
    if given is not None or public is None:
        return given
    if cs.samples.select("s").limit(OWN_FREQUENCIES).count() >= OWN_FREQUENCIES:
        return None
    return public.select(*VARIANT, (1 - F.col("AF")).alias("ref_af"))


def chimera(rates: DataFrame, *, threshold: float = 0.05) -> DataFrame:
    """(s, chimera_reads {chimera_rate, is_passing: rate < threshold})."""
    return rates.select("s", F.struct(F.col("chimera_rate").cast("double").alias("chimera_rate"), (F.col("chimera_rate") < threshold).alias("is_passing")).alias("chimera_reads"))


def gq_fraction(cs: CallSet, *, gq_thresh: int = 20, fraction_thresh: float = 0.9) -> DataFrame:
    """(s, gq_fraction {gq_fraction, is_passing}): the share of a sample's autosomal entries with gq from gq_thresh on; a missing gq counts as lower."""
    share = F.try_divide(F.count_if(F.col("gq") >= gq_thresh), F.count("*"))
    per = cs.entries.where(in_autosome(F.col("contig"))).groupBy("s").agg(share.alias("f"))
    return cs.samples.select("s").join(per, "s", "left").select("s", F.struct(F.col("f").alias("gq_fraction"), (F.col("f") >= fraction_thresh).alias("is_passing")).alias("gq_fraction"))


def sex_check(cs: CallSet, *, maf_threshold: float = 0.0, male_fhet_thresh: float = 0.8, female_fhet_thresh: float = 0.2, maf: DataFrame | None = None, reported: DataFrame | None = None, build: str | None = "GRCh38") -> DataFrame:
    """(s, sex_info {is_female, is_passing, sex_check, f_stat, n_called, expected_homs, observed_homs}).

    F = (observed - expected) / (called - expected) homozygous calls at biallelic
    X sites outside the pseudo-autosomal regions of `build` (None: there are none), expected = sum of 1 - 2 p (1 - p)
    with p the alternate frequency (`maf`: (variant, AF), else of the cohort),
    for p over maf_threshold and under 1 - maf_threshold. Haploid calls count as
    homozygous. Female below the one threshold, male above the other, else
    unknown. sex_check compares with `reported` (s, reported_is_female) where
    both are known; a sample without a comparison passes.
    """
    x = (F.size("alleles") == 2) & in_x_nonpar(F.col("contig"), F.col("position"), build)
    entries = cs.entries.where(x)
    if "gt" in entries.columns:
        entries = entries.withColumn("n_alt", F.when(F.size("gt") == 1, 2 * F.col("n_alt")).otherwise(F.col("n_alt")))
    sites = cs.variants.where(x).select(*VARIANT)
    p = maf.select(*VARIANT, "AF") if maf is not None else allele_counts(cs.with_(variants=sites, entries=entries)).select(*VARIANT, "AF")
    sites = sites.join(p, [*VARIANT]).where(~F.isnan("AF") & (F.col("AF") > maf_threshold) & (F.col("AF") < 1 - maf_threshold))
    calls = entries.where(F.col("n_alt").isNotNull()).join(sites, [*VARIANT])
    per = calls.groupBy("s").agg(F.count("*").alias("n_called"), F.sum(1 - 2 * F.col("AF") * (1 - F.col("AF"))).alias("expected_homs"), F.count_if(F.col("n_alt") != 1).alias("observed_homs"))
    f = F.try_divide(F.col("observed_homs") - F.col("expected_homs"), F.col("n_called") - F.col("expected_homs"))
    per = cs.samples.select("s").join(per.withColumn("f_stat", f), "s", "left")
    female = F.when(F.col("f_stat") < female_fhet_thresh, True).when(F.col("f_stat") > male_fhet_thresh, False)
    per = per.withColumn("is_female", female)
    if reported is not None:
        per = per.join(reported.select("s", "reported_is_female"), "s", "left")
        check = F.col("is_female") == F.col("reported_is_female")
    else:
        check = F.lit(None).cast("boolean")
    per = per.withColumn("sex_check", check)
    return per.select("s", F.struct("is_female", F.coalesce("sex_check", F.lit(True)).alias("is_passing"), "sex_check", "f_stat", "n_called", "expected_homs", "observed_homs").alias("sex_info"))


def sample_qc(cs: CallSet) -> DataFrame:
    """(s, METRICS): counts of a sample's calls. Kinds of alleles count once for each copy; a singleton is the one copy of an allele in the cohort; a ratio with denominator 0 is NULL."""
    counts = cs.entries.groupBy(*VARIANT).agg(F.sum("n_alt").alias("ac"))
    kinds = counts.select(*VARIANT, "ac", allele_class(F.get("alleles", F.lit(0)), F.get("alleles", F.lit(1))).alias("kind"))
    calls = cs.entries.where("n_alt > 0").join(kinds, [*VARIANT])
    copies = lambda on: F.coalesce(F.sum(F.when(on, F.col("n_alt"))), F.lit(0)).cast("long")
    kind = F.col("kind")
    per = calls.groupBy("s").agg(
        F.count_if(F.col("n_alt") == 1).alias("n_het"),
        F.count_if(F.col("n_alt") == 2).alias("n_hom_var"),
        F.count_if((F.col("ac") == 1) & (F.col("n_alt") == 1)).alias("n_singleton"),
        copies(kind.isin("transition", "transversion")).alias("n_snp"),
        copies(kind == "insertion").alias("n_insertion"),
        copies(kind == "deletion").alias("n_deletion"),
        copies(kind == "transition").alias("n_transition"),
        copies(kind == "transversion").alias("n_transversion"),
    )
    per = cs.samples.select("s").join(per, "s", "left").na.fill(0)
    return per.select("*", *(F.try_divide(a, b).alias(c) for a, b, c in (("n_transition", "n_transversion", "r_ti_tv"), ("n_het", "n_hom_var", "r_het_hom_var"), ("n_insertion", "n_deletion", "r_insertion_deletion"))))


def outliers(metrics: DataFrame, strata: DataFrame | None = None, *, columns: tuple[str, ...] = OUTLIER_METRICS, deviations: float = 4.0, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(s, qc_metrics {each metric, fail_<metric>, is_passing}).

    A metric fails outside median -+ deviations * MAD of the sample's stratum
    (strata: (s, ancestry_pop); samples without one are a stratum), MAD being
    1.4826 times the median absolute deviation. `overrides` has other
    deviations below and above by metric; n_singleton has (4, 8) by default. A
    missing value does not fail.
    """
    bounds = {"n_singleton": (4.0, 8.0)} | (overrides or {})
    rows = metrics.join(strata.select("s", F.col("ancestry_pop").alias("_stratum")), "s", "left") if strata is not None else metrics.withColumn("_stratum", F.lit(None).cast("string"))
    middle = rows.groupBy("_stratum").agg(*(F.median(c).alias(f"_m_{c}") for c in columns)).withColumnRenamed("_stratum", "_of")
    rows = rows.join(F.broadcast(middle), F.col("_stratum").eqNullSafe(F.col("_of"))).drop("_of")  # a row for each stratum
    spread = rows.groupBy("_stratum").agg(*((F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))) * MAD_SCALE).alias(f"_d_{c}") for c in columns)).withColumnRenamed("_stratum", "_of")
    rows = rows.join(F.broadcast(spread), F.col("_stratum").eqNullSafe(F.col("_of")))
    fails = []
    for c in columns:
        low, high = bounds.get(c, (deviations, deviations))
        fails.append(F.coalesce((F.col(c) < F.col(f"_m_{c}") - low * F.col(f"_d_{c}")) | (F.col(c) > F.col(f"_m_{c}") + high * F.col(f"_d_{c}")), F.lit(False)).alias(f"fail_{c}"))
    rows = rows.select("*", *fails)
    passing = F.lit(True)
    for c in columns:
        passing = passing & ~F.col(f"fail_{c}")
    return rows.select("s", F.struct(*columns, *(f"fail_{c}" for c in columns), passing.alias("is_passing")).alias("qc_metrics"))
