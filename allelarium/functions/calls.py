"""Genotype calls: allele indices as ARRAY<INT>, NULL for no call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_alt(gt: Column) -> Column:
    """Alternate alleles of a call; a call with a missing allele is no call."""
    return F.when(gt.isNotNull() & ~F.exists(gt, lambda a: a.isNull()), F.size(F.filter(gt, lambda a: a > 0)))


def local_to_global(lgt: Column, la: Column) -> Column:
    """The call whose local allele indices `lgt` point into `la`."""
    return F.when(lgt.isNotNull() & la.isNotNull(), F.transform(lgt, lambda i: F.get(la, i)))


def is_het(gt: Column) -> Column:
    return (F.size(gt) == 2) & (F.get(gt, F.lit(0)) != F.get(gt, F.lit(1)))


def haploid_to_diploid(gt: Column) -> Column:
    """A haploid call as the homozygous diploid one."""
    return F.when(F.size(gt) == 1, F.concat(gt, gt)).otherwise(gt)


def depth(ad: Column) -> Column:
    """Sum of allele depths without the missing ones; NULL for missing depths."""
    return F.when(ad.isNotNull(), F.aggregate(F.filter(ad, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x))


def allele_class(ref: Column, alt: Column) -> Column:
    """transition, transversion, insertion, deletion or other."""
    snp = (F.length(ref) == 1) & (F.length(alt) == 1)
    pair = F.concat(F.least(ref, alt), F.greatest(ref, alt))
    return (
        F.when(snp & pair.isin("AG", "CT"), "transition")
        .when(snp, "transversion")
        .when(F.length(alt) > F.length(ref), "insertion")
        .when(F.length(alt) < F.length(ref), "deletion")
        .otherwise("other")
    )


def min_rep(position: Column, ref: Column, alt: Column) -> Column:
    """Least representation as a struct of position, ref, alt: the common suffix goes first, then the common prefix; one base stays.

    A prefix or suffix length is the number of leading places of agreement, by whole-array functions.
    """
    shorter = F.least(F.length(ref), F.length(alt)) - 1
    places = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def agreeing(a: Column, b: Column, most: Column) -> Column:
        differ = F.filter(places(most), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
        return F.coalesce(F.array_min(differ) - 1, F.greatest(most, F.lit(0)))

    suffix = agreeing(F.reverse(ref), F.reverse(alt), shorter)
    ref_2, alt_2 = ref.substr(F.lit(1), F.length(ref) - suffix), alt.substr(F.lit(1), F.length(alt) - suffix)
    prefix = agreeing(ref_2, alt_2, F.least(F.length(ref_2), F.length(alt_2)) - 1)
    rest = lambda c: c.substr(prefix + 1, F.length(c))
    return F.struct((position + prefix).cast("int").alias("position"), rest(ref_2).alias("ref"), rest(alt_2).alias("alt"))
