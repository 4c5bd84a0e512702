"""The data model: a call set is a family of DataFrames.

variants: contig, position, alleles (ref first), and any annotations.
samples: s, and any annotations.
entries: contig, position, alleles, s, n_alt (alternate alleles called; NULL: no
call), and any fields (ploidy, ad, dp, gq, gp, ...). A cell without a row is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANT = ("contig", "position", "alleles")


@dataclass(frozen=True)
class CallSet:
    variants: DataFrame
    samples: DataFrame
    entries: DataFrame
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, frame, needed in (("variants", self.variants, VARIANT), ("samples", self.samples, ("s",)), ("entries", self.entries, (*VARIANT, "s"))):
            if missing := [c for c in needed if c not in frame.columns]:
                raise ValueError(f"{name} has no column {', '.join(missing)}")
        if dict(self.samples.dtypes)["s"] != "string":
            raise ValueError("sample ids must be strings")

    def with_(self, **frames) -> CallSet:
        return replace(self, **frames)

    def only_variants(self, keys: DataFrame) -> CallSet:
        """The variants among `keys`, with their entries."""
        keys = keys.select(*VARIANT).distinct()
        return self.with_(variants=self.variants.join(keys, [*VARIANT], "left_semi"), entries=self.entries.join(keys, [*VARIANT], "left_semi"))

    def only_samples(self, keys: DataFrame) -> CallSet:
        keys = keys.select("s").distinct()
        return self.with_(samples=self.samples.join(keys, "s", "left_semi"), entries=self.entries.join(keys, "s", "left_semi"))

    def where_variants(self, predicate: Column) -> CallSet:
        kept = self.variants.where(predicate)
        return self.with_(variants=kept, entries=self.entries.join(kept.select(*VARIANT), [*VARIANT], "left_semi"))

    def count(self) -> tuple[int, int]:
        return self.variants.count(), self.samples.count()


@dataclass(frozen=True)
class Variable:
    """A group or aggregation variable: `expr` turns an accessor of the side's row, col or entry fields into a Column."""

    name: str
    side: str  # exome or imputation
    axis: str  # row, col or entry
    expr: Callable[[Callable[[str], Column]], Column]

    def column(self, struct: str) -> Column:
        return self.expr(lambda name: F.col(f"{struct}.{name}"))


def variables(side: str, axis: str, exprs: dict[str, Callable] | None) -> list[Variable]:
    return [Variable(name, side, axis, f) for name, f in (exprs or {}).items()]
