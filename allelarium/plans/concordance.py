"""The whole concordance analysis: read, filter, compare, write tables and delimited files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.functions import bins
from allelarium.functions.calls import depth
from allelarium.model import CallSet, variables
from allelarium.operators import filters, joint
from allelarium.operators.concordance import global_concordance, sample_concordance, variant_concordance
from allelarium.operators.variant_stats import allele_counts, split_multi
from allelarium.sources.call_sets import load_data, read_list
from allelarium.sources.files import write_text

LOG = logging.getLogger("allelarium")
#: Option -> (side, axis, name, bin, needed column); those of rows and entries by which counts are grouped or aggregated.
GROUPS = {"exome_maf": ("exome", "exo_maf", bins.maf_bin), "imputation_maf": ("imputation", "imp_maf", bins.maf_bin), "exome_mac": ("exome", "exo_mac", bins.mac_bin), "imputation_mac": ("imputation", "imp_mac", bins.mac_bin)}
AGGS = {
    "qual_approx": ("exome", "row", "qual_approx", bins.qual_approx_bin, "qual_approx"),
    "info": ("imputation", "row", "info_score", bins.info_score_bin, "info"),
    "dp": ("exome", "entry", "DP", bins.dp_bin, "dp"),
    "gq": ("exome", "entry", "GQ", bins.gq_bin, "gq"),
    "max_gp": ("imputation", "entry", "MAX_GP", bins.max_gp_bin, "max_gp"),
}
_COMMON = {"n_concordant": "# Concordant", "n_total": "# Total Genotypes", "HET_HOMREF": "Het->Ref", "HET_HET": "Het->Het"}
FIELDS = {"concordance_rate": "Concordance Rate", "nonref_concordance_rate": "Non-ref Concordance", **_COMMON}


def _prepared(exo: CallSet, imp: CallSet) -> tuple[CallSet, CallSet]:
    """Entries with the depth and the greatest genotype probability where their parts are there."""
    e, i = exo.entries, imp.entries
    if "ad" in e.columns:
        e = e.withColumn("dp", F.coalesce("dp", depth(F.col("ad"))) if "dp" in e.columns else depth(F.col("ad")))
    if "max_gp" not in i.columns and "gp" in i.columns:
        i = i.withColumn("max_gp", F.array_max("gp"))
    return exo.with_(entries=e), imp.with_(entries=i)


def compare(
    exo: CallSet, imp: CallSet, out_dir: str, *, options: set[str] = frozenset(), sample_list: DataFrame | None = None, variant_list: DataFrame | None = None, contigs: list[str] | None = None,
    n_samples: int | None = None, n_variants: int | None = None, downsample_samples: float | None = None, downsample_variants: float | None = None, seed: int = filters.SEED,
    join_type: joint.JoinType = joint.JoinType.inner, variant_conc: bool = False, sample_conc: bool = False, global_conc: bool = False,
) -> dict:
    """Write the tables and files of the asked-for analyses below out_dir; the concordance tables by name.

    Allele counts and frequencies are those of the whole call sets before any
    filter, and multi-allelic variants are split after the filters.
    """
    if unknown := options - {*GROUPS, *AGGS}:
        raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
    spark, out = exo.variants.sparkSession, out_dir.rstrip("/")
    joint.check_samples(exo, imp)
    exo, imp = _prepared(exo, imp)
    for name in sorted(options & set(AGGS)):
        side, axis, _, _, column = AGGS[name]
        cs = exo if side == "exome" else imp
        if column not in (cs.variants if axis == "row" else cs.entries).columns:
            raise ValueError(f"the {side} call set has no {column}")
    exo, imp = (cs.with_(variants=allele_counts(cs)) if options & {o for o, g in GROUPS.items() if g[0] == side} else cs for cs, side in ((exo, "exome"), (imp, "imputation")))
    kept, down = [], []
    for cs in (exo, imp):
        cs, d = filters.apply_filters(cs, sample_list=sample_list, variant_list=variant_list, contigs=contigs, n_variants=n_variants, downsample_variants=downsample_variants, seed=seed)
        kept.append(split_multi(cs))
        down.append(d)
    if not all(down):
        LOG.warning("the call sets are not both downsampled; this can take long")
    exo, imp = kept
    if n_samples is not None or downsample_samples is not None:
        both = joint.sample_overlaps(exo, imp).where("EXOME and IMPUTATION").select("s")
        both = filters.hash_sample(both, downsample_samples, "s", seed=seed) if downsample_samples is not None else both
        both = filters.head_samples(both, n_samples) if n_samples is not None else both
        exo, imp = exo.only_samples(both), imp.only_samples(both)

    def pick(axes: tuple[str, ...]) -> tuple[list, list]:
        groups = [v for o, (side, name, f) in GROUPS.items() if o in options and "row" in axes for v in variables(side, "row", {name: f})]
        aggs = [v for o, (side, axis, name, f, _) in AGGS.items() if o in options and axis in axes for v in variables(side, axis, {name: f})]
        return groups, aggs

    made = {}
    if variant_conc:
        joint.variant_overlaps(exo, imp).write.mode("overwrite").parquet(f"{out}/variant_overlaps.parquet")
        table = made["variant"] = variant_concordance(exo, imp, *pick(("entry",)), join_type).write(f"{out}/variant_conc")
        table.get_view(agg_names=[v.name for v in pick(("entry",))[1]], ordering=bins.ORDERINGS).export_all(f"{out}/variant-results", FIELDS)
    if sample_conc:
        overlaps = joint.sample_overlaps(exo, imp)
        overlaps.write.mode("overwrite").parquet(f"{out}/sample_overlaps.parquet")
        write_text(spark, f"{out}/sample_overlaps.tsv", overlaps.orderBy("s").toPandas().to_csv(sep="\t", index=False))
        table = made["sample"] = sample_concordance(exo, imp, join_type).write(f"{out}/sample_conc")
        table.get_view().export_all(f"{out}/sample-results", FIELDS)
    if global_conc:
        groups, aggs = pick(("row", "entry"))
        table = made["global"] = global_concordance(exo, imp, groups, aggs, join_type).write(f"{out}/global_concordance_table")
        view = table.get_view(ordering=bins.ORDERINGS)
        view.export_all(f"{out}/global-results", FIELDS)
        for statistic, folder in (("nonref_concordance_rate", "nonref-conc"), ("f1_score", "f1-score")):
            try:
                view.plot_all(f"{out}/global-plots/{folder}", statistic)
            except ImportError:
                LOG.info("plotnine is not installed: no plots")
        whole = table.get_view(group_names=["ALL"], agg_names=["ALL"]).result()
        LOG.info("concordance %s, non-reference concordance %s", whole["concordance_rate"].iloc[0], whole["nonref_concordance_rate"].iloc[0])
    return made


def concordance(spark: SparkSession, *, exome_path: str, imputation_path: str, out_dir: str, sample_list: str | None = None, variant_list: str | None = None, n_exome_partitions: int | None = None, n_imp_partitions: int | None = None, **options) -> dict:
    """`compare` for call sets and lists at paths."""
    exo = load_data(spark, exome_path, "exome", LOG, n_exome_partitions)
    imp = load_data(spark, imputation_path, "imputation", LOG, n_imp_partitions)
    return compare(exo, imp, out_dir, sample_list=read_list(spark, sample_list, True) if sample_list else None, variant_list=read_list(spark, variant_list, False) if variant_list else None, **options)
