"""Reading call sets: folders of Parquet, VCF, PLINK; lists and intervals.

`load` chooses by the path: .vcf, .vcf.gz and .vcf.bgz; .cs (a folder with
variants, samples and entries); .cs with a * for call sets split by rows; else
the root of a PLINK .bed, .bim and .fam.
"""

from __future__ import annotations

import json
import logging
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.functions.genome import CONTIGS, contig_index
from allelarium.model import VARIANT, CallSet
from allelarium.operators.variant_stats import calls_from_local, union_rows
from allelarium.sources.files import exists, list_folder, read_text
from allelarium.sources.one_file import chunks_of
from allelarium.sources.ranges import RANGE_BYTES, read_gzip_lines, read_plink_cells, sample_fields

PARTS = ("variants", "samples", "entries")
#: What says how a call set's files are dealt, and by what.
LAYOUT, BUCKET_KEY = "_layout.json", ("contig", "position")


def load(spark: SparkSession, path: str, **options) -> CallSet:
    if path.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        return read_vcf(spark, path, **options)
    if path.rstrip("/").endswith(".cs"):
        return read_split_rows(spark, path) if "*" in path else read_call_set(spark, path, **options)
    folder, name = posixpath.split(path)
    names = {posixpath.basename(p) for p in list_folder(spark, folder or ".")}
    if missing := [e for e in (".bed", ".bim", ".fam") if name + e not in names]:
        raise ValueError(f"{path} is no call set and has no {', '.join(missing)}")
    return read_plink(spark, path, **options)


def load_data(spark: SparkSession, path: str, descriptor: str, log: logging.Logger, n_partitions: int | None = None) -> CallSet:
    """Load and log the numbers of variants and samples."""
    cs = load(spark, path, **({"n_partitions": n_partitions} if path.rstrip("/").endswith(".cs") and "*" not in path else {}))
    variants, samples = cs.count()
    log.info("%s: %d variants and %d samples in %s", descriptor, variants, samples, path)
    return cs


def read_call_set(spark: SparkSession, path: str, n_partitions: int | None = None) -> CallSet:
    """A folder of Parquet; entries dealt by position into n_partitions, if given."""
    root = path.rstrip("/")
    buckets = json.loads(read_text(spark, f"{root}/{LAYOUT}"))["buckets"] if exists(spark, f"{root}/{LAYOUT}") else None
    frames = {p: _bucketed(spark, f"{root}/{p}", buckets) if buckets and p != "samples" else spark.read.parquet(f"{root}/{p}") for p in PARTS}
    if n_partitions:
        frames["entries"] = frames["entries"].repartitionByRange(n_partitions, "contig", "position")
    if "n_alt" not in frames["entries"].columns:
        frames["entries"] = calls_from_local(frames["entries"])
    return CallSet(**frames)


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Files dealt to buckets, read as such. Joins by more columns than the buckets' keep to the buckets too, for which a setting of the session is changed."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name, key = f"call_set_{uuid.uuid4().hex}", ", ".join(BUCKET_KEY)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame has its files already
    return df


def read_split_rows(spark: SparkSession, path: str) -> CallSet:
    """All call sets in the folder of the path, one after the other; samples are those of the first."""
    folder = posixpath.dirname(path.rstrip("/"))
    found = [p for p in list_folder(spark, folder) if p.rstrip("/").endswith(".cs")]
    return union_rows([read_call_set(spark, p) for p in found])


def _numbers(text: Column, kind: str) -> Column:
    """A comma-separated list; `.` is NULL, as an item and as a whole."""
    return F.when(text.isNotNull() & (text != "."), F.transform(F.split(text, ","), lambda x: F.when(x != ".", x.try_cast(kind))))


def _call(text: Column) -> Column:
    """Allele indices of a call; NULL with any of them missing."""
    alleles = F.transform(F.split(text, "[/|]"), lambda a: a.try_cast("int"))
    return F.when(text.isNotNull() & ~F.exists(alleles, lambda a: a.isNull()), alleles)


def read_vcf(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, region: tuple[str, int, int] | None = None) -> CallSet:
    """A VCF, plain or compressed; one of gzip blocks is read in tasks of about `range_bytes` each.

    region: (contig, start, end), zero-based and half open: only variants whose
    reference overlaps it, of which an index `path`.tbi names the blocks to read.

    Entries have gt (from GT, or LGT and LA), ad, dp, gq, gp and n_alt; a cell
    whose value is `.` throughout is an entry without a call. Variants have
    filters (PASS: none; `.`: unknown), qual, qual_approx and info.
    """
    lines = spark.read.text(path) if path.endswith(".vcf") else read_gzip_lines(spark, path, range_bytes=range_bytes)
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"{path} has no header line")
    names = head["value"].rstrip("\r\n").split("\t")[9:]
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "s string, col_idx int")
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    at = lambda i: F.get("f", F.lit(i))
    if region:
        contig, start, end = region
        if exists(spark, f"{path}.tbi"):
            lines = read_gzip_lines(spark, path, chunks=chunks_of(f"{path}.tbi", contig, start, end))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"))
    if region:
        rows = rows.where((at(0) == contig) & (at(1).cast("int") <= end) & (at(1).cast("int") - 1 + F.length(at(3)) > start))
    info = F.str_to_map(at(7), F.lit(";"), F.lit("="))
    alleles = F.when(at(4) == ".", F.array(at(3))).otherwise(F.concat(F.array(at(3)), F.split(at(4), ",")))
    key = [at(0).alias("contig"), at(1).cast("int").alias("position"), alleles.alias("alleles")]
    filters = F.when(at(6) == "PASS", F.array().cast("array<string>")).when(at(6) != ".", F.split(at(6), ";"))
    variants = rows.select(*key, filters.alias("filters"), at(5).try_cast("double").alias("qual"), info["QUALapprox"].try_cast("int").alias("qual_approx"), info["INFO"].try_cast("double").alias("info"), info["RAF"].try_cast("double").alias("raf"))
    known = F.split(F.lit("\t".join(names)), "\t") if names else F.array().cast("array<string>")  # folded to one literal
    cells = rows.select(*key, F.split(at(8), ":").alias("format"), F.explode(F.arrays_zip(known.alias("s"), F.slice("f", 10, max(1, len(names))).alias("text"))).alias("cell"))
    cells = cells.select(*VARIANT, F.col("cell.s").alias("s"), F.map_from_arrays("format", F.transform(F.sequence(F.lit(0), F.size("format") - 1), lambda i: F.get(F.split("cell.text", ":"), i))).alias("v"))
    v = lambda name: F.when(F.col("v")[name] != ".", F.col("v")[name])
    gt = F.coalesce(_call(v("GT")), F.when(_call(v("LGT")).isNotNull(), F.transform(_call(v("LGT")), lambda i: F.get(_numbers(v("LA"), "int"), i))))
    entries = cells.select(*VARIANT, "s", gt.alias("gt"), _numbers(v("AD"), "int").alias("ad"), v("DP").try_cast("int").alias("dp"), v("GQ").try_cast("int").alias("gq"), _numbers(v("GP"), "double").alias("gp"))
    return CallSet(variants, samples, calls_from_local(entries))


def read_plink(spark: SparkSession, root: str, *, range_bytes: int = RANGE_BYTES) -> CallSet:
    """PLINK .bed, .bim and .fam, in tasks of about `range_bytes` of the .bed."""
    fam = spark.createDataFrame([(x[1], i, x[4]) for i, x in enumerate(sample_fields(f"{root}.fam"))], "s string, col_idx int, sex string")
    part = F.split(F.trim("value"), r"\s+")
    bim = spark.read.text(f"{root}.bim").where(F.trim("value") != "").select(F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(3)).cast("int").alias("position"), F.array(F.get(part, F.lit(5)), F.get(part, F.lit(4))).alias("alleles"), F.get(part, F.lit(1)).alias("rsid"))
    return CallSet(bim, fam, read_plink_cells(spark, root, range_bytes=range_bytes))


def read_list(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """A tab-separated list: samples with a header, variants without one."""
    return spark.read.option("sep", "\t").option("header", header).csv(path)


def read_bed(spark: SparkSession, path: str, *, skip_invalid: bool = True) -> DataFrame:
    """(contig, start, end) of a BED file: zero-based start, half open. An interval of an unknown contig or with start after end is left out, or, unless skipped, is an error."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    rows = rows.select(F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).try_cast("int").alias("start"), F.get(part, F.lit(2)).try_cast("int").alias("end"), "value")
    good = F.coalesce((contig_index(F.col("contig")) > 0) & (F.col("start") <= F.col("end")), F.lit(False))
    if skip_invalid:
        return rows.where(good).drop("value")
    return rows.select(F.when(good, F.col("contig")).otherwise(F.raise_error(F.concat(F.lit("not an interval: "), "value"))).alias("contig"), "start", "end")


def known_contigs() -> list[str]:
    return list(CONTIGS)
