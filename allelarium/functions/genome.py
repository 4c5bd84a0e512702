"""Positions on a genome: contig order, autosomes, the part of X outside the pseudo-autosomal regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTIGS = [*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY", "chrM"]
# Pseudo-autosomal regions of X, 1-based and closed, by genome build.
X_PAR = {
    "GRCh37": [(60_001, 2_699_520), (154_931_044, 155_260_560)],
    "GRCh38": [(10_001, 2_781_479), (155_701_383, 156_030_895)],
}


def _plain(contig: Column) -> Column:
    return F.regexp_replace(contig, "^chr", "")


def contig_index(contig: Column) -> Column:
    """Place of a contig in genome order, whether or not it is named with `chr`."""
    return F.array_position(F.array(*(F.lit(c[3:]) for c in CONTIGS)), _plain(contig)).cast("int")


def in_autosome(contig: Column) -> Column:
    return _plain(contig).isin([str(i) for i in range(1, 23)])


def in_x_nonpar(contig: Column, position: Column, build: str | None = "GRCh38") -> Column:
    """On X outside the pseudo-autosomal regions of a build; None: a genome without them, all of X."""
    par = F.lit(False)
    for start, end in X_PAR[build] if build else ():
        par = par | position.between(start, end)
    return (_plain(contig) == "X") & ~par


def parse_variant(text: Column) -> Column:
    """`chr:pos:ref:alt` as a struct of contig, position and alleles; NULL where it is malformed."""
    parts = F.split(text, ":")
    position = F.get(parts, F.lit(1)).try_cast("int")
    good = (F.size(parts) == 4) & position.isNotNull()
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("contig"), position.alias("position"), F.slice(parts, 3, 2).alias("alleles")))
