"""Command line: `python -m allelarium.cli concordance ...` and `... sample-qc ...`."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from allelarium.functions.genome import X_PAR
from allelarium.operators import packed
from allelarium.operators.filters import SEED, apply_filters
from allelarium.operators.joint import JoinType
from allelarium.operators.linear import ancestry, project, with_ancestry
from allelarium.operators.variant_stats import common_sites, high_quality_sites
from allelarium.operators.filters import filter_genotypes
from allelarium.plans.concordance import AGGS, GROUPS, concordance
from allelarium.plans.sample_qc import calculate_sample_qc_stats
from allelarium.sources.call_sets import load_data, read_bed, read_list
from allelarium.sources.files import read_bytes, write_text

LOG = logging.getLogger("allelarium")
FLAGS = {"--EXOME-MAF": "exome_maf", "--IMPUTATION-MAF": "imputation_maf", "--EXOME-MAC": "exome_mac", "--IMPUTATION-MAC": "imputation_mac", "--QUAL-APPROX": "qual_approx", "--INFO": "info", "--DP": "dp", "--GQ": "gq", "--MAX-GP": "max_gp"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="allelarium")
    p.add_argument("--master", help="Spark master")
    p.add_argument("--app-name", default="allelarium")
    p.add_argument("--local", default="local[*]", help="master where neither --master nor a setting names one")
    p.add_argument("--spark-conf", default="{}", help="Spark settings as JSON")
    p.add_argument("--tmp-dir", help="folder that driver and executors share, for the tables of rounds (spark.checkpoint.dir)")
    p.add_argument("--local-tmpdir", help="folder of each machine (spark.local.dir)")
    p.add_argument("--min-block-size", type=int, default=0, help="MB of a file that one task reads at least")
    p.add_argument("--branching-factor", type=int, default=packed.FAN_IN, help="partial sums of matrices that are added up at once")
    p.add_argument("--default-reference", choices=sorted(X_PAR), default="GRCh38", help="genome build")
    p.add_argument("--global-seed", type=int, default=SEED, help="seed of samples of rows")
    p.add_argument("--log", help="file for log messages")
    p.add_argument("--append", action="store_true", help="add to that file")
    p.add_argument("--quiet", action="store_true", help="warnings only")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("concordance", help="compare two call sets of the same samples")
    for name in ("--exome", "--imputation", "--output-dir"):
        c.add_argument(name, required=True)
    for flag, name in FLAGS.items():
        c.add_argument(flag, dest="options", action="append_const", const=name)
    s = sub.add_parser("sample-qc", help="statistics of samples")
    for name in ("--dataset", "--output-dir", "--exome-regions", "--low-complexity-regions"):
        s.add_argument(name, required=True)
    for q in (c, s):
        q.add_argument("--sample-list", help="file with a column s")
        q.add_argument("--variant-list", help="file of chr:pos:ref:alt")
        q.add_argument("--contig", action="append", dest="contigs")
        q.add_argument("--n-samples", type=int)
        q.add_argument("--n-variants", type=int)
        q.add_argument("--downsample-samples", type=float)
        q.add_argument("--downsample-variants", type=float)
        q.add_argument("--log-path")
    c.add_argument("--join-type", type=JoinType, choices=list(JoinType), default=JoinType.inner)
    for name in ("--variant-conc", "--sample-conc", "--global-conc"):
        c.add_argument(name, action="store_true")
    c.add_argument("--n-exome-partitions", type=int)
    c.add_argument("--n-imp-partitions", type=int)

    s.add_argument("--gatk", action="store_true")
    s.add_argument("--dragen", action="store_true")
    for name, kind, default in (("dp-thresh", int, 10), ("gq-thresh", int, 20), ("ab-thresh", float, 0.2), ("maf-thresh", float, 0.01), ("mac-thresh", int, 10), ("call-rate-thresh", float, 0.95), ("ld-prune-r2-thresh", float, 0.2), ("ld-prune-bp-window-size", int, 1_000_000), ("chimera-threshold", float, 0.05), ("contamination-charr-thresh", float, 0.05), ("contamination-min-af", float, 0.05), ("contamination-max-af", float, 0.95), ("contamination-min-dp", int, 10), ("contamination-max-dp", int, 100), ("contamination-min-gq", int, 20), ("pcs-k", int, 10), ("coverage-gq-thresh", int, 20), ("coverage-fraction-thresh", float, 0.9), ("sex-male-fhet-thresh", float, 0.8), ("sex-female-fhet-thresh", float, 0.2), ("num-pcs", int, 20), ("min-prob", float, 0.75), ("n-partitions", int, None)):
        s.add_argument(f"--{name}", type=kind, default=default)
    for name in ("pre-pruned-variants", "pca-loadings", "onnx-rf", "ref-af", "ref-af-col", "public-af", "reported-sex", "reported-sex-col", "chimera-rate", "chimera-rate-col"):
        s.add_argument(f"--{name}")
    return p


def _session(a: argparse.Namespace) -> SparkSession:
    conf = {"spark.app.name": a.app_name} | json.loads(a.spark_conf)
    if a.master or "spark.master" not in {**conf, **dict(SparkConf().getAll())}:
        conf["spark.master"] = a.master or a.local
    for name, value in (("spark.checkpoint.dir", a.tmp_dir), ("spark.local.dir", a.local_tmpdir), ("spark.sql.files.maxPartitionBytes", a.min_block_size > 128 and f"{a.min_block_size}m")):
        conf |= {name: value} if value else {}
    packed.FAN_IN = max(2, a.branching_factor)
    return SparkSession.builder.config(map=conf).getOrCreate()


def _column(spark: SparkSession, path: str | None, column: str | None, what: str, name: str):
    """(s, name) of a table at a path, whose column must be named."""
    if not path:
        return None
    if not column:
        raise SystemExit(f"--{what}-col is needed with --{what}")
    return spark.read.parquet(path).select("s", F.col(column).alias(name))


def run_sample_qc(spark: SparkSession, a: argparse.Namespace):
    if a.gatk == a.dragen:
        raise SystemExit("give exactly one of --gatk and --dragen")
    cs = load_data(spark, a.dataset, "dataset", LOG, a.n_partitions)
    cs, _ = apply_filters(cs, sample_list=read_list(spark, a.sample_list, True) if a.sample_list else None, variant_list=read_list(spark, a.variant_list, False) if a.variant_list else None, contigs=a.contigs, n_samples=a.n_samples, n_variants=a.n_variants, downsample_samples=a.downsample_samples, downsample_variants=a.downsample_variants, seed=a.global_seed)
    genotype = {"is_gatk": a.gatk, "dp_thresh": a.dp_thresh, "gq_thresh": a.gq_thresh, "ab_thresh": a.ab_thresh}
    sites = high_quality_sites(cs, read_bed(spark, a.low_complexity_regions), read_bed(spark, a.exome_regions), **genotype, maf_thresh=a.maf_thresh, mac_thresh=a.mac_thresh, call_rate_thresh=a.call_rate_thresh)
    labels = None
    if a.pca_loadings and a.onnx_rf:
        good = filter_genotypes(cs, **genotype)
        good = good.only_variants(common_sites(good, maf_thresh=0.0, mac_thresh=0, call_rate_thresh=a.call_rate_thresh))
        labels = ancestry(project(good, spark.read.parquet(a.pca_loadings)), read_bytes(spark, a.onnx_rf), cs.samples, num_pcs=a.num_pcs, min_prob=a.min_prob)
    elif "ancestry_pop" in cs.samples.columns:
        labels = with_ancestry(cs.samples.select("s", "ancestry_pop"), cs.samples)
    ref_af = None
    if a.ref_af:
        if not a.ref_af_col:
            raise SystemExit("--ref-af-col is needed with --ref-af")
        ref_af = spark.read.parquet(a.ref_af).select("contig", "position", "alleles", F.col(a.ref_af_col).alias("ref_af"))
    result = calculate_sample_qc_stats(
        cs, sites, pre_pruned_variants=spark.read.parquet(a.pre_pruned_variants) if a.pre_pruned_variants else None, ld_prune_r2_thresh=a.ld_prune_r2_thresh, ld_prune_bp_window_size=a.ld_prune_bp_window_size,
        chimera_rate=_column(spark, a.chimera_rate, a.chimera_rate_col, "chimera-rate", "chimera_rate"), chimera_threshold=a.chimera_threshold,
        contamination_options={"charr_thresh": a.contamination_charr_thresh, "min_af": a.contamination_min_af, "max_af": a.contamination_max_af, "min_dp": a.contamination_min_dp, "max_dp": a.contamination_max_dp, "min_gq": a.contamination_min_gq, "ref_af": ref_af},
        pcs_k=a.pcs_k, ancestry_pop_labels=labels, coverage_gq_thresh=a.coverage_gq_thresh, coverage_fraction_thresh=a.coverage_fraction_thresh,
        reported_sex=_column(spark, a.reported_sex, a.reported_sex_col, "reported-sex", "reported_is_female"), sex_male_fhet_thresh=a.sex_male_fhet_thresh, sex_female_fhet_thresh=a.sex_female_fhet_thresh, build=a.default_reference,
        public_frequencies=spark.read.parquet(a.public_af) if a.public_af else None,
    )
    out = a.output_dir.rstrip("/")
    result = result.write(f"{out}/sample_qc_stats")
    ids = result.passing_samples().table.select("s").orderBy("s").toPandas()
    write_text(spark, f"{out}/passing_sample_ids.tsv", ids.to_csv(sep="\t", index=False))
    return result


def main(argv: list[str] | None = None):
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if a.quiet else logging.INFO, filename=a.log_path or a.log, filemode="a" if a.append else "w", format="%(asctime)s %(message)s")
    spark = _session(a)
    if a.command == "sample-qc":
        return run_sample_qc(spark, a)
    shared = ("contigs", "n_samples", "n_variants", "downsample_samples", "downsample_variants", "join_type", "variant_conc", "sample_conc", "global_conc", "sample_list", "variant_list", "n_exome_partitions", "n_imp_partitions")
    return concordance(spark, exome_path=a.exome, imputation_path=a.imputation, out_dir=a.output_dir, options=set(a.options or ()) & {*GROUPS, *AGGS}, seed=a.global_seed, **{k: getattr(a, k) for k in shared})


if __name__ == "__main__":
    main(sys.argv[1:])
