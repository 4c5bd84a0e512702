"""Writing call sets: folders of Parquet, VCF, PLINK."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from allelarium.functions.genome import contig_index
from allelarium.model import VARIANT, CallSet
from allelarium.operators.packed import MISSING, full_rows, pack, packed_rows, sample_names
from allelarium.sources.call_sets import BUCKET_KEY, LAYOUT, PARTS
from allelarium.sources.files import round_folder, write_bytes, write_text, written
from allelarium.sources.one_file import index_bytes, write_one_file


def write_call_set(cs: CallSet, path: str, *, overwrite: bool = False, buckets: int | None = None) -> None:
    """A folder of Parquet; variants and entries in order of position, so that a scan prunes by it.

    With `buckets` both are dealt by contig and position to as many files, and
    call sets with one number of buckets are joined without a shuffle of their
    entries. A bucket is what one task reads, so that number grows with the
    data: some 128 MB each.
    """
    root, mode = path.rstrip("/"), "overwrite" if overwrite else "error"
    for part in PARTS:
        df = getattr(cs, part)
        if buckets and part != "samples":
            name = f"call_set_{uuid.uuid4().hex}"
            dealt = df.repartition(buckets, *BUCKET_KEY)  # the hash of a bucket: a task writes one file
            dealt.write.mode(mode).bucketBy(buckets, *BUCKET_KEY).sortBy(*BUCKET_KEY).option("path", f"{root}/{part}").saveAsTable(name)
            df.sparkSession.sql(f"DROP TABLE {name}")  # the name alone: the files are not the catalogue's
        else:
            (df if part == "samples" else df.sortWithinPartitions("contig", "position")).write.mode(mode).parquet(f"{root}/{part}")
    write_text(cs.variants.sparkSession, f"{root}/{LAYOUT}", json.dumps({"buckets": buckets}))


def _sample_names(cs: CallSet) -> list[str]:
    order = ["col_idx"] if "col_idx" in cs.samples.columns else []
    return [r["s"] for r in cs.samples.orderBy(*order, "s").select("s").collect()]


def vcf_lines(cs: CallSet):
    """(header, DataFrame of contig, position, line) with GT and, where present, AD, DP and GQ."""
    names = _sample_names(cs)
    fields = [f for f in ("ad", "dp", "gq") if f in cs.entries.columns]
    if "gt" in cs.entries.columns:
        gt = F.array_join(F.transform("gt", lambda a: a.cast("string")), "/")
    else:
        gt = F.when(F.col("n_alt") == 0, "0/0").when(F.col("n_alt") == 1, "0/1").when(F.col("n_alt") == 2, "1/1")
    parts = [F.coalesce(gt, F.lit("./."))]
    for f in fields:
        value = F.array_join(F.transform("ad", lambda a: F.coalesce(a.cast("string"), F.lit("."))), ",") if f == "ad" else F.col(f).cast("string")
        parts.append(F.coalesce(value, F.lit(".")))
    cells = cs.entries.select(*VARIANT, "s", F.concat_ws(":", *parts).alias("cell"))
    packed = cells.groupBy(*VARIANT).agg(F.map_from_entries(F.collect_list(F.struct("s", "cell"))).alias("cells"))
    rows = cs.variants.join(packed, [*VARIANT], "left")
    empty = ":".join(["./.", *["."] * len(fields)])
    values = F.transform(F.split(F.lit("\t".join(names)), "\t"), lambda s: F.coalesce(F.try_element_at("cells", s), F.lit(empty))) if names else F.array().cast("array<string>")
    filters = F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";")) if "filters" in cs.variants.columns else F.lit(".")
    alt = F.coalesce(F.nullif(F.array_join(F.slice("alleles", 2, 1 << 20), ","), F.lit("")), F.lit("."))
    line = F.concat_ws("\t", "contig", F.col("position").cast("string"), F.lit("."), F.get("alleles", F.lit(0)), alt, F.lit("."), filters, F.lit("."), F.lit(":".join(["GT", *(f.upper() for f in fields)])), F.array_join(values, "\t"))
    header = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    header += [f'##FORMAT=<ID={f.upper()},Number={"R" if f == "ad" else 1},Type=Integer,Description="{f.upper()}">' for f in fields]
    header.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]))
    return header, rows.select("contig", "position", "alleles", line.alias("line"))


def write_vcf(cs: CallSet, path: str) -> str:
    """One VCF in genome order, in gzip blocks written by many tasks, with an index by position beside it (`.tbi`); the path."""
    header, rows = vcf_lines(cs)
    ordered = rows.withColumn("_at", contig_index(F.col("contig"))).repartitionByRange("_at", "contig", "position").sortWithinPartitions("_at", "contig", "position", "alleles")

    def place(line: bytes) -> tuple[str, int, int]:
        contig, position, _, ref = line.split(b"\t", 4)[:4]
        return contig.decode(), int(position) - 1, int(position) - 1 + len(ref)

    places = write_one_file(ordered.select(F.concat("line", F.lit("\n")).cast("binary").alias("line")), path, header=("\n".join(header) + "\n").encode(), blocks=True, place=place)
    first: dict[str, int] = {}
    for (contig, _), at in places.windows.items():
        first[contig] = min(at, first.get(contig, at))
    write_bytes(cs.variants.sparkSession, f"{path}.tbi", index_bytes(places, sorted(first, key=first.get)))
    return path


#: The .bed byte of a byte of packed codes: no alternate allele 11, one 10, two 00, not called 01.
_BED = np.array([sum((3, 2, 0, 1)[b >> s & 3] << s for s in (0, 2, 4, 6)) for b in range(256)], np.uint8)


def write_plink(cs: CallSet, root: str) -> None:
    """PLINK .bed, .bim and .fam of biallelic variants; the first two are written by many tasks."""
    names = sample_names(cs) if "col_idx" not in cs.samples.columns else _sample_names(cs)
    n, width = len(names), -(-len(names) // 4)
    rows = cs.variants.where(F.size("alleles") == 2).select(*VARIANT).join(packed_rows(cs, names, polymorphic=False).select(*VARIANT, "codes"), [*VARIANT], "left")
    rows = written(rows.withColumn("_at", contig_index(F.col("contig"))), f"{round_folder(cs.variants.sparkSession, 'plink')}/rows")
    # both files are in this one order, wherever the ranges are cut
    rows = rows.repartitionByRange("_at", "contig", "position").sortWithinPartitions("_at", "contig", "position", "alleles")
    missing = bytes(pack(np.full((1, n), MISSING, np.uint8))[0])
    tail = np.uint8((1 << 2 * (n - 4 * (width - 1))) - 1) if n else np.uint8(0)

    def encode(batch: pa.RecordBatch) -> Iterator[bytes]:
        for codes in full_rows(pc.fill_null(batch.column(0).cast(pa.large_binary()), missing), n) if width else ():
            data = _BED[codes]
            data[:, -1] &= tail
            yield data.tobytes()

    write_one_file(rows.select("codes"), f"{root}.bed", header=b"\x6c\x1b\x01", encode=encode)
    bim = F.concat_ws("\t", "contig", F.concat_ws(":", "contig", F.col("position").cast("string"), F.array_join("alleles", ":")), F.lit("0"), F.col("position").cast("string"), F.get("alleles", F.lit(1)), F.get("alleles", F.lit(0)))
    write_one_file(rows.select(F.concat(bim, F.lit("\n")).cast("binary").alias("line")), f"{root}.bim")
    write_text(cs.variants.sparkSession, f"{root}.fam", "".join(f"{s}\t{s}\t0\t0\t0\t-9\n" for s in names))
