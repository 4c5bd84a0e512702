"""The command line from files to files."""

import random

import pandas as pd
import pytest
from pyspark import SparkConf
from pyspark.sql import functions as F

from allelarium import cli
from allelarium.model import CallSet
from allelarium.operators import filters, packed
from allelarium.sources import call_sets, sinks


def stored(spark, path, seed, fields=True):
    rng = random.Random(seed)
    keys = [(c, p * 1_000, ["A", "CGT"[p % 3]]) for c in ("chr1", "chr2", "chrX") for p in range(3_000, 3_040)]
    cells = [(*k, f"s{j}", rng.choice([None, 0, 1, 1, 2]), rng.choice([10, 40, 60]), 30, [15, 15]) for k in keys for j in range(12)]
    schema = "contig string, position int, alleles array<string>"
    entries = spark.createDataFrame(cells, f"{schema}, s string, n_alt int, gq int, dp int, ad array<int>")
    samples = spark.createDataFrame([(f"s{j}", f"pop{j % 2}") for j in range(12)], "s string, ancestry_pop string")
    sinks.write_call_set(CallSet(spark.createDataFrame([(*k, 50, []) for k in keys], f"{schema}, qual_approx int, filters array<string>"), samples, entries), path)
    return path


def test_concordance_command(spark, tmp_path):
    a, b = stored(spark, f"file://{tmp_path}/a.cs", 1), sinks.write_vcf(call_sets.load(spark, stored(spark, f"file://{tmp_path}/b.cs", 2)), f"file://{tmp_path}/b.vcf.bgz")
    out = tmp_path / "out"
    made = cli.main(["--quiet", "--branching-factor", "3", "concordance", "--exome", a, "--imputation", b, "--output-dir", f"file://{out}", "--global-conc", "--sample-conc", "--GQ", "--EXOME-MAC", "--QUAL-APPROX", "--contig", "chr1"])
    assert set(made) == {"global", "sample"} and packed.FAN_IN == 3
    packed.FAN_IN = 64
    files = {p.name for p in (out / "global-results").iterdir() if p.suffix == ".tsv"}
    assert files == {f"{g}_{x}.tsv" for g in ("ALL", "exo_mac") for x in ("ALL", "GQ", "qual_approx")}
    frame = pd.read_csv(out / "global-results/ALL_ALL.tsv", sep="\t")
    assert list(frame["n_variants"]) == [40] and list(frame["n_samples"]) == [12] and 0 < float(frame["Concordance Rate"].iloc[0]) < 100
    whole = made["sample"].df.agg(F.sum("n_total")).first()[0]
    assert whole == frame["# Total Genotypes"].iloc[0] and len(pd.read_csv(out / "sample-results/ALL_ALL.tsv", sep="\t")) == 12
    with pytest.raises(SystemExit):
        cli.main(["concordance", "--exome", a])


def test_sample_qc_command(spark, tmp_path):
    a = stored(spark, f"file://{tmp_path}/a.cs", 3)
    (tmp_path / "e.bed").write_text("".join(f"{c}\t2999000\t3039000\n" for c in ("chr1", "chr2", "chrX")))
    (tmp_path / "l.bed").write_text("chr1\t3000500\t3002500\n")
    common = ["sample-qc", "--dataset", a, "--output-dir", f"file://{tmp_path}/out", "--exome-regions", f"file://{tmp_path}/e.bed", "--low-complexity-regions", f"file://{tmp_path}/l.bed"]
    call_sets.load(spark, a).variants.select("contig", "position", "alleles", F.lit(0.5).alias("AF")).write.parquet(f"{tmp_path}/af.parquet")
    result = cli.main(["--default-reference", "GRCh37", "--tmp-dir", f"file://{tmp_path}/shared", *common, "--dragen", "--call-rate-thresh", "0.2", "--mac-thresh", "2", "--pcs-k", "2", "--public-af", f"{tmp_path}/af.parquet", "--coverage-fraction-thresh", "0.1", "--contamination-charr-thresh", "2"])
    rows = result.table.collect()
    assert len(rows) == 12 and all(len(r["pcs"]["scores"]) == 2 and r["contamination"]["charr"] == pytest.approx(1.0) for r in rows)
    ids = pd.read_csv(tmp_path / "out/passing_sample_ids.tsv", sep="\t")
    assert list(ids.columns) == ["s"] and set(ids["s"]) == {r["s"] for r in result.passing_samples().table.collect()} and len(ids)
    with pytest.raises(SystemExit, match="exactly one"):
        cli.main(common)


def test_seeds_draw_other_samples(spark, tmp_path):
    cs = call_sets.load(spark, stored(spark, f"file://{tmp_path}/a.cs", 4))
    drawn = [{tuple(map(str, r)) for r in filters.apply_filters(cs, downsample_variants=0.5, seed=s)[0].variants.select("contig", "position").collect()} for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and 30 < len(drawn[2]) < 90


def test_session_settings(monkeypatch):
    class Builder:
        def config(self, map):
            self.map = map
            return self

        def getOrCreate(self):
            return self.map

    monkeypatch.setattr(cli.SparkSession, "builder", Builder())
    monkeypatch.setattr(cli, "SparkConf", lambda: SparkConf(loadDefaults=False))
    command = ["concordance", "--exome", "a", "--imputation", "b", "--output-dir", "c"]
    of = lambda *a: cli._session(cli.parser().parse_args([*a, *command]))
    assert of() == {"spark.app.name": "allelarium", "spark.master": "local[*]"}
    assert of("--master", "spark://x", "--tmp-dir", "hdfs:///t", "--local-tmpdir", "/d", "--min-block-size", "256") == {"spark.app.name": "allelarium", "spark.master": "spark://x", "spark.checkpoint.dir": "hdfs:///t", "spark.local.dir": "/d", "spark.sql.files.maxPartitionBytes": "256m"}
    assert of("--local", "local[2]", "--spark-conf", '{"spark.ui.enabled": "false"}')["spark.master"] == "local[2]"
    packed.FAN_IN = 64
