"""5x5 confusion counts of genotype states, and what is derived from them.

States of a cell: 0 MISSING (no entry), 1 NOCALL, 2 HOMREF, 3 HET, 4 HOMALT.
Column `c_ij` counts cells with state i in the exome and j in the imputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("MISSING", "NOCALL", "HOMREF", "HET", "HOMALT")
CELLS = [(i, j) for i in range(5) for j in range(5)]
COUNTS = [f"c_{i}{j}" for i, j in CELLS]
RATES = ("concordance_rate", "nonref_concordance_rate", "f1_score")
FIELDS = [
    *RATES, "n_total", "n_concordant", "n_discordant", "n_hets", "n_hom_alts", "het_to_hom_alt", "hom_ref_to_het", "het_to_hom_ref",
    *(f"{STATES[i]}_{STATES[j]}" for i, j in CELLS),
]


def state(present: Column, n_alt: Column) -> Column:
    """State of an entry; NULL (not counted) for more than two alternate alleles."""
    return F.when(~present, 0).when(n_alt.isNull(), 1).when(n_alt.between(0, 2), n_alt.cast("int") + 2)


def count_cells(weight: Column, left: str = "l", right: str = "r") -> list[Column]:
    """Aggregates that add up `weight` in the 25 cells."""
    return [F.coalesce(F.sum(F.when((F.col(left) == i) & (F.col(right) == j), weight)), F.lit(0)).cast("long").alias(f"c_{i}{j}") for i, j in CELLS]


def _total(rows: range, columns: range) -> Column:
    out = F.lit(0).cast("long")
    for i in rows:
        for j in columns:
            out = out + F.col(f"c_{i}{j}")
    return out


def _text(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.format_string("%.2f", rate * 100))


def with_statistics(counts: DataFrame) -> DataFrame:
    """Counts by name, totals and rates: a rate as a number (`*_raw`) and as a percentage with two decimals; NULL where its denominator is 0."""
    concordant = F.col("c_22") + F.col("c_33") + F.col("c_44")
    total = _total(range(2, 5), range(1, 5))
    positive = F.col("c_33") + F.col("c_44")
    false_positive = F.col("c_23") + F.col("c_24") + F.col("c_34")
    false_negative = F.col("c_32") + F.col("c_42") + F.col("c_43")
    precision, recall = F.try_divide(positive, positive + false_positive), F.try_divide(positive, positive + false_negative)
    raw = {
        "concordance_rate": F.try_divide(concordant, total),
        "nonref_concordance_rate": F.try_divide(positive, _total(range(3, 5), range(1, 5))),
        "f1_score": F.try_divide(2 * precision * recall, precision + recall),
    }
    out = counts.select(
        *(c for c in counts.columns if c not in COUNTS),
        *(F.col(f"c_{i}{j}").alias(f"{STATES[i]}_{STATES[j]}") for i, j in CELLS),
        *(r.alias(f"{n}_raw") for n, r in raw.items()),
        total.alias("n_total"),
        concordant.alias("n_concordant"),
        (total - concordant).alias("n_discordant"),
        _total(range(3, 4), range(5)).alias("n_hets"),
        _total(range(4, 5), range(5)).alias("n_hom_alts"),
        F.col("c_34").alias("het_to_hom_alt"),
        F.col("c_23").alias("hom_ref_to_het"),
        F.col("c_32").alias("het_to_hom_ref"),
    )
    return out.select("*", *(_text(F.col(f"{n}_raw")).alias(n) for n in RATES))


def as_array() -> Column:
    """The 25 counts as ARRAY<ARRAY<BIGINT>>, indexed by exome state, then imputation state."""
    return F.array(*(F.array(*(F.col(f"c_{i}{j}") for j in range(5))) for i in range(5)))
