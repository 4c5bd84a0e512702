"""Files put together from the parts of many tasks, and the index of positions, against whole files."""

import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelarium.model import CallSet
from allelarium.sources import call_sets, one_file, ranges, sinks


@pytest.mark.parametrize("blocks", [False, True])
def test_parts_make_one_file(spark, tmp_path, blocks):
    rng = random.Random(1)
    pieces = [bytes(rng.choices(range(256), k=rng.choice([0, 5, 3_000, 70_000]))) for _ in range(90)]
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces)], "i int, data binary").repartitionByRange(7, "i").sortWithinPartitions("i").select("data")
    path = tmp_path / "x"
    one_file.write_one_file(rows, f"file://{path}", header=b"head" * 30_000, blocks=blocks)
    got = path.read_bytes()
    assert (gzip.decompress(got) if blocks else got) == b"head" * 30_000 + b"".join(pieces)
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and got.endswith(one_file.END_BLOCK) == blocks
    one_file.write_one_file(rows.where("false"), str(path), blocks=blocks)
    assert (gzip.decompress(path.read_bytes()) if blocks else path.read_bytes()) == b""


def test_other_file_systems_take_parts_in_order(spark, tmp_path, monkeypatch):
    """A store that neither concatenates nor is a shared folder."""
    inner = pa.fs.SubTreeFileSystem("/", pa.fs.LocalFileSystem())
    monkeypatch.setattr(one_file, "locate", lambda path: (inner, path))
    rows = spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id").select(F.col("id").cast("string").cast("binary"))
    parts = [str(tmp_path / f"p{i}") for i in range(3)]
    for i, name in enumerate(parts):
        open(name, "wb").write(b"part%d" % i)
    one_file._put_together(rows, str(tmp_path / "y"), b"<", [(n, 0, 5) for n in parts], b">", 0)
    assert (tmp_path / "y").read_bytes() == b"<part0part1part2>"


def test_bins():
    rng = random.Random(2)
    assert one_file.bin_of(0, 1) == 4681 and one_file.bin_of(0, 1 << 29) == 0 and one_file.bin_of((1 << 14) - 1, (1 << 14) + 1) == 585
    for _ in range(2_000):
        a, n = rng.randrange(1 << 22), rng.choice([1, 50, 20_000, 1 << 20])
        b, m = rng.randrange(1 << 22), rng.choice([1, 50, 20_000])
        if a < b + m and b < a + n:  # what overlaps is in one of the bins
            assert one_file.bin_of(b, b + m) in one_file.bins_over(a, a + n)


def cohort(spark, n=3_000, samples=5):
    rng = random.Random(9)
    keys = sorted({(rng.choice(["chr1", "chr2", "chr10", "chrX"]), rng.randrange(1, 2_000_000)) for _ in range(n)})
    rows = [(c, p, ["A" * rng.choice([1, 1, 1, 200]), "G"]) for c, p in keys]
    cells = [(*r, f"s{j}", rng.choice([None, 0, 1, 2])) for r in rows for j in range(samples) if rng.random() < 0.8]
    schema = "contig string, position int, alleles array<string>"
    names = spark.createDataFrame([(f"s{j}",) for j in range(samples)], "s string")
    return CallSet(spark.createDataFrame(rows, schema), names, spark.createDataFrame(cells, f"{schema}, s string, n_alt int")), rows


def test_one_indexed_vcf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(one_file, "BLOCK_TEXT", 4_000)  # many blocks
    cs, rows = cohort(spark)
    path = sinks.write_vcf(cs, f"file://{tmp_path}/c.vcf.bgz")
    text = gzip.decompress((tmp_path / "c.vcf.bgz").read_bytes()).decode().splitlines()
    assert sum(line.startswith("#CHROM") for line in text) == 1 and len([x for x in text if x[0] != "#"]) == len(rows)
    order = [x.split("\t")[:2] for x in text if x[0] != "#"]
    place = {c: k for k, c in enumerate(["chr1", "chr2", "chr10", "chrX"])}
    assert order == sorted(order, key=lambda x: (place[x[0]], int(x[1])))
    back = call_sets.read_vcf(spark, path, range_bytes=5_000)
    cells = lambda c: sorted((r["contig"], r["position"], r["s"], r["n_alt"]) for r in c.entries.where("n_alt is not null").collect())
    assert back.count() == (len(rows), 5) and cells(back) == cells(cs) and back.variants.rdd.getNumPartitions() > 3
    rng, size = random.Random(3), (tmp_path / "c.vcf.bgz").stat().st_size
    for contig, start, end in [("chr2", 0, 1 << 29), ("chrX", 0, 1), ("chr9", 5, 500)] + [(rng.choice(list(place)), a := rng.randrange(2_000_000), a + rng.choice([1, 300, 40_000])) for _ in range(5)]:
        want = sorted((c, p) for c, p, alleles in rows if c == contig and p - 1 < end and p - 1 + len(alleles[0]) > start)
        part = call_sets.read_vcf(spark, path, region=(contig, start, end))
        assert sorted((r["contig"], r["position"]) for r in part.variants.collect()) == want
        if end - start < 1_000:
            assert sum((hi >> 16) - (lo >> 16) for lo, hi in one_file.chunks_of(f"{path}.tbi", contig, start, end)) < size / 4
    none = CallSet(cs.variants.where("false"), cs.samples, cs.entries.where("false"))
    assert call_sets.read_vcf(spark, sinks.write_vcf(none, f"file://{tmp_path}/n.vcf.bgz")).count() == (0, 5)


@pytest.mark.parametrize("samples", [1, 4, 6])
def test_plink_file_of_many_tasks(spark, tmp_path, samples):
    cs, rows = cohort(spark, 400, samples)
    sinks.write_plink(cs, f"file://{tmp_path}/p")
    calls = {(r["contig"], r["position"], r["s"]): r["n_alt"] for r in cs.entries.collect()}
    place = {c: k for k, c in enumerate(["chr1", "chr2", "chr10", "chrX"])}
    code, want = {0: 3, 1: 2, 2: 0, None: 1}, b"\x6c\x1b\x01"
    ordered = sorted(rows, key=lambda r: (place[r[0]], r[1]))
    for c, p, _ in ordered:
        two = [code[calls.get((c, p, f"s{j}"))] for j in range(samples)] + [0] * (-samples % 4)
        want += bytes(two[k] | two[k + 1] << 2 | two[k + 2] << 4 | two[k + 3] << 6 for k in range(0, len(two), 4))
    assert (tmp_path / "p.bed").read_bytes() == want
    assert [x.split("\t")[0] + ":" + x.split("\t")[3] for x in (tmp_path / "p.bim").read_text().splitlines()] == [f"{c}:{p}" for c, p, _ in ordered]
    back = call_sets.load(spark, f"file://{tmp_path}/p")
    got = sorted((r["contig"], r["position"], r["s"], r["n_alt"]) for r in back.entries.where("n_alt is not null").collect())
    assert got == sorted((*k, v) for k, v in calls.items() if v is not None) and np.all([len(r["alleles"]) == 2 for r in back.variants.collect()])
    assert ranges.sample_fields(f"file://{tmp_path}/p.fam")[0][1] == "s0"
