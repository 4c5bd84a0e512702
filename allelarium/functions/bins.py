"""Binned expressions. A missing value has a missing bin; NaN falls in the last bin.

Each takes an accessor of a row's or entry's fields, as `lambda name: column`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_case(value: Column, edges: Sequence[tuple[float, object]], default: object) -> Column:
    """The label of the first edge that the value does not exceed, else the default."""
    out = F.when(value.isNull(), None)
    for edge, label in edges:
        out = out.when(value <= edge, F.lit(label))
    return out.otherwise(F.lit(default))


def binned(field: str, edges: Sequence[tuple[float, object]], default: object) -> Callable[[Callable[[str], Column]], Column]:
    return lambda at: bin_case(at(field), edges, default)


def _steps(first: int, last: int, by: int, scale: float = 1.0) -> list[tuple[float, object]]:
    """Upper-closed steps labelled by their upper edge."""
    values = range(first, last + 1, by)
    return [(v, v) if scale == 1.0 else (v / scale, v / scale) for v in values]


# The edges and labels of the published binning scheme.
MAC_EDGES = [(1, "1"), (5, "2-5"), (10, "6-10")]
MAC_REST = "10+"
MAF_EDGES = [(0.01, "<1%"), (0.02, "1-2%"), (0.05, "2-5%")]
MAF_REST = ">5%"
GQ_EDGES, GQ_REST = _steps(10, 80, 10), 90
DP_EDGES, DP_REST = _steps(10, 90, 10), 100
GP_EDGES, GP_REST = [*_steps(1, 9, 1, 10.0), (0.95, 0.95)], 1.0

ORDERINGS = {
    "exo_mac": ["1", "2-5", "6-10", "10+"],
    "imp_mac": ["1", "2-5", "6-10", "10+"],
    "exo_maf": ["<1%", "1-2%", "2-5%", ">5%"],
    "imp_maf": ["<1%", "1-2%", "2-5%", ">5%"],
}

mac_bin = binned("AC", MAC_EDGES, MAC_REST)
maf_bin = binned("AF", MAF_EDGES, MAF_REST)
gq_bin = binned("gq", GQ_EDGES, GQ_REST)
dp_bin = binned("dp", DP_EDGES, DP_REST)
max_gp_bin = binned("max_gp", GP_EDGES, GP_REST)
qual_approx_bin = binned("qual_approx", GQ_EDGES, GQ_REST)
info_score_bin = binned("info", GP_EDGES, GP_REST)
