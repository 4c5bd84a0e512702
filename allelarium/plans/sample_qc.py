"""Sample QC: all statistics of samples in one table, with accessors, exports and plot data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from allelarium.functions.genome import in_autosome, in_x_nonpar
from allelarium.model import CallSet
from allelarium.operators.linear import compute_pcs, ld_prune
from allelarium.operators.sample_stats import OUTLIER_METRICS, chimera, contamination, gq_fraction, outliers, reference_frequencies, sample_qc, sex_check
from allelarium.sources.files import round_folder, written


class SampleQCResult:
    """A row for each sample; each statistic is a struct column."""

    def __init__(self, table: DataFrame):
        self.table = table

    @staticmethod
    def load(spark: SparkSession, path: str) -> SampleQCResult:
        return SampleQCResult(spark.read.parquet(path))

    def write(self, path: str, *, overwrite: bool = True) -> SampleQCResult:
        self.table.write.mode("overwrite" if overwrite else "error").parquet(path)
        return SampleQCResult.load(self.table.sparkSession, path)

    def close(self) -> None:
        self.table.unpersist()

    contamination = property(lambda self: F.col("contamination"))
    chimera_reads = property(lambda self: F.col("chimera_reads"))
    qc_metrics = property(lambda self: F.col("qc_metrics"))
    gq_fraction = property(lambda self: F.col("gq_fraction"))
    sex_info = property(lambda self: F.col("sex_info"))
    ancestry_pop = property(lambda self: F.col("ancestry.ancestry_pop"))
    pcs = property(lambda self: F.col("pcs"))
    sample_id = property(lambda self: F.col("s"))

    def default_passing(self) -> Column:
        """Passing contamination, chimerism and sex where known, genotype quality, and every metric but singletons; NULL if one is unknown and none fails."""
        out = F.col("contamination.is_passing") & F.coalesce("chimera_reads.is_passing", F.lit(True)) & F.coalesce("sex_info.is_passing", F.lit(True)) & F.col("gq_fraction.is_passing")
        for c in OUTLIER_METRICS:
            if c != "n_singleton":
                out = out & ~F.col(f"qc_metrics.fail_{c}")
        return out

    def passing_samples(self, is_passing: Column | None = None) -> SampleQCResult:
        return self.filter_to(self.default_passing() if is_passing is None else is_passing)

    def filter_to(self, predicate: Column) -> SampleQCResult:
        return SampleQCResult(self.table.where(predicate))

    def flat(self, *columns: Column | str) -> DataFrame:
        """The columns (all by default) without structs: names joined by dots, arrays as text joined by commas."""
        df = self.table.select(*columns) if columns else self.table
        out = []

        def add(column: Column, name: str, kind) -> None:
            if isinstance(kind, StructType):
                for f in kind.fields:
                    add(column.getField(f.name), f"{name}.{f.name}", f.dataType)
            elif kind.typeName() == "array":
                out.append(F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(name))
            else:
                out.append(column.alias(name))

        for f in df.schema.fields:
            add(F.col(f"`{f.name}`"), f.name, f.dataType)
        return df.select(*out)

    def export(self, path: str, *columns: Column | str, delimiter: str = "\t", missing: str = "NA", header: bool = True) -> None:
        """Delimited text without structs; missing values as `missing`."""
        self.flat(*columns).write.mode("overwrite").option("sep", delimiter).option("nullValue", missing).option("header", header).csv(path)

    def plot_pcs_data(self, i: int, j: int) -> DataFrame:
        """Points of the i-th and j-th component, counted from 1."""
        at = lambda k: F.get("pcs.scores", F.lit(k - 1))
        return self.table.select("s", at(i).alias("x"), at(j).alias("y"), F.col("ancestry.ancestry_pop").alias("ancestry"))

    def plot_qc_metric_data(self) -> DataFrame:
        """(s, ancestry, metric, value, fail) for boxplots and densities."""
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"qc_metrics.{c}").cast("double").alias("value"), F.col(f"qc_metrics.fail_{c}").alias("fail")) for c in OUTLIER_METRICS)))
        return self.table.select("s", F.col("ancestry.ancestry_pop").alias("ancestry"), each.alias("m")).select("s", "ancestry", "m.*")

    def plot_gq_fraction_data(self) -> DataFrame:
        return self.table.select("s", F.col("ancestry.ancestry_pop").alias("ancestry"), F.col("gq_fraction.gq_fraction").alias("value"))

    def plot_chimera_data(self) -> DataFrame:
        return self.table.select("s", F.col("ancestry.ancestry_pop").alias("ancestry"), F.col("chimera_reads.chimera_rate").alias("value"), (~F.col("chimera_reads.is_passing")).alias("fail"))


def prune_variants(cs: CallSet, pre_pruned: DataFrame | None = None, *, r2_thresh: float = 0.2, bp_window_size: int = 1_000_000) -> DataFrame:
    """Keys of the variants left: those of a given list, or those that LD pruning keeps."""
    if pre_pruned is not None:
        return cs.variants.join(pre_pruned, ["contig", "position", "alleles"], "left_semi").select("contig", "position", "alleles")
    return ld_prune(cs, r2_thresh=r2_thresh, bp_window_size=bp_window_size)


#: Fields of entries that the statistics read.
FIELDS = ("contig", "position", "alleles", "s", "n_alt", "gq", "dp", "ad", "gt")


def at_sites(cs: CallSet, sites: DataFrame) -> CallSet:
    """The call set at the sites, its entries in the checkpoint folder."""
    root = round_folder(cs.variants.sparkSession, "sample-qc")
    sites = written(sites.select("contig", "position", "alleles").distinct(), f"{root}/sites")
    kept = cs.only_variants(sites)
    entries = kept.entries.select(*(c for c in FIELDS if c in kept.entries.columns))
    return kept.with_(entries=written(entries, f"{root}/entries"), variants=written(kept.variants, f"{root}/variants"))


def calculate_sample_qc_stats(
    cs: CallSet,
    high_quality_sites: DataFrame,
    *,
    pre_pruned_variants: DataFrame | None = None,
    ld_prune_r2_thresh: float = 0.2,
    ld_prune_bp_window_size: int = 1_000_000,
    chimera_rate: DataFrame | None = None,
    chimera_threshold: float = 0.05,
    contamination_options: dict | None = None,
    public_frequencies: DataFrame | None = None,
    pcs_k: int = 10,
    ancestry_pop_labels: DataFrame | None = None,
    coverage_gq_thresh: int = 20,
    coverage_fraction_thresh: float = 0.9,
    reported_sex: DataFrame | None = None,
    sex_male_fhet_thresh: float = 0.8,
    sex_female_fhet_thresh: float = 0.2,
    compute_components: bool = True,
    build: str | None = "GRCh38",
) -> SampleQCResult:
    """All statistics over the raw entries at the sites of high quality: autosomes for contamination, genotype quality and outliers, pruned autosomes for components, X for sex.

    Those entries are written once, with the fields that any statistic reads.
    public_frequencies: (variant, AF), for contamination in small cohorts.
    """
    hq = at_sites(cs, high_quality_sites)
    auto = hq.where_variants(in_autosome(F.col("contig")))
    x = hq.where_variants(in_x_nonpar(F.col("contig"), F.col("position"), build))
    samples, options = cs.samples.select("s"), contamination_options or {}
    labels = ancestry_pop_labels if ancestry_pop_labels is not None else samples.select("s", F.struct(F.lit("unknown").alias("ancestry_pop")).alias("ancestry"))
    strata = labels.select("s", F.col("ancestry.ancestry_pop").alias("ancestry_pop")) if ancestry_pop_labels is not None else None
    tables = [
        contamination(auto, **(options | {"ref_af": reference_frequencies(cs, options.get("ref_af"), public_frequencies)})),
        gq_fraction(auto, gq_thresh=coverage_gq_thresh, fraction_thresh=coverage_fraction_thresh),
        outliers(sample_qc(auto), strata),
        sex_check(x, male_fhet_thresh=sex_male_fhet_thresh, female_fhet_thresh=sex_female_fhet_thresh, reported=reported_sex, build=build),
        labels.join(samples, "s", "left_semi"),
    ]
    if compute_components:
        tables.append(compute_pcs(auto.only_variants(prune_variants(auto, pre_pruned_variants, r2_thresh=ld_prune_r2_thresh, bp_window_size=ld_prune_bp_window_size)), k=pcs_k))
    else:
        tables.append(samples.select("s", F.struct(F.array().cast("array<double>").alias("scores")).alias("pcs")))
    rates = chimera_rate if chimera_rate is not None else samples.select("s", F.lit(None).cast("double").alias("chimera_rate"))
    tables.append(chimera(rates.join(samples, "s", "left_semi"), threshold=chimera_threshold))
    return SampleQCResult(reduce(lambda a, b: a.join(b, "s", "full"), tables))
