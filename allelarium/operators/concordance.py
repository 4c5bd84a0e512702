"""Concordance of two call sets: global, per variant and per sample, by group and aggregation variables.

The dense variant-by-sample grid is never built. Cells that a call set has are
joined and counted once by all variables together; this small table is then
expanded to every pair of a group and an aggregation variable. Where entries
define a variable, distinct loci and samples of its values are counted too: one
pass over the joined cells groups them by the variables and states, by the
variables and locus, and by the variables and sample (grouping sets), and the
three small tables serve all pairs of variables. Cells that both call sets lack are the size of the grid less the cells seen, which is arithmetic
on counts of variants and samples. They belong to the missing value of a
variable that entries define.

Result, a row for each pair of values: group_var_name, group_var, agg_var_name,
agg_var, n_variants (distinct loci of the exome), n_samples, and the fields of
`confusion.with_statistics`. Values are strings; a missing value is a row too,
which views leave out; where an entry variable is missing n_variants and
n_samples are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelarium.model import VARIANT, CallSet, Variable
from allelarium.operators.confusion import count_cells, state, with_statistics
from allelarium.operators.joint import JoinType, check_samples, joined_entries, joined_samples, joined_variants, of_samples
from allelarium.sources.files import round_folder, written

ALL = "ALL"
KEY = ("group_var_name", "group_var", "agg_var_name", "agg_var")
_STRUCT = {("exome", "row"): "left_row", ("imputation", "row"): "right_row", ("exome", "col"): "left_col", ("imputation", "col"): "right_col", ("exome", "entry"): "left_entry", ("imputation", "entry"): "right_entry"}


class _Joined:
    """The joined call sets with a column g0, g1, ... for each group variable and a0, a1, ... for each aggregation variable."""

    def __init__(self, exo: CallSet, imp: CallSet, groups: list[Variable], aggs: list[Variable], join_type: JoinType):
        for kind, names in (("group", [v.name for v in groups]), ("aggregation", [v.name for v in aggs])):
            if twice := sorted({n for n in names if names.count(n) > 1 or n == ALL}):
                raise ValueError(f"{kind} variables are named more than once: {', '.join(twice)}")
        if any(v.axis == "entry" for v in groups):
            raise ValueError("a group variable cannot depend on entries")
        check_samples(exo, imp)
        self.groups, self.aggs = groups, aggs
        self.named = [(f"g{i}", v) for i, v in enumerate(groups)] + [(f"a{i}", v) for i, v in enumerate(aggs)]
        of = lambda axis: [v.column(_STRUCT[v.side, axis]).alias(c) for c, v in self.named if v.axis == axis]
        locus = F.when(F.col("left_row").isNotNull(), F.struct("contig", "position"))
        self.samples = joined_samples(exo, imp).select("s", *of("col"))
        self.variants = joined_variants(exo, imp, join_type).select(*VARIANT, locus.alias("locus"), *of("row"))
        # what variants say is joined to each side, before the full join, of which no partitioning is known
        at = self.variants.select(*VARIANT, F.struct("locus", *self.columns("row")).alias("_at"))
        mine = lambda cs: cs.with_(entries=of_samples(cs.entries, self.samples.select("s")).join(at, [*VARIANT]))
        cells = joined_entries(mine(exo), mine(imp))
        side = lambda name: state(F.col(f"{name}.present").isNotNull(), F.col(f"{name}.n_alt"))
        cells = cells.withColumn("_at", F.coalesce("left_entry._at", "right_entry._at"))
        self.cells = cells.select(*VARIANT, "s", side("left_entry").alias("l"), side("right_entry").alias("r"), *of("entry"), "_at.*")
        if self.columns("col"):
            self.cells = of_samples(self.cells, self.samples, "inner")
        types = {**dict(self.cells.dtypes)}
        self.group_types = {ALL: "string", **{v.name: types[c] for c, v in self.named if c[0] == "g"}}
        self.agg_types = {ALL: "string", **{v.name: types[c] for c, v in self.named if c[0] == "a"}}

    def columns(self, *axes: str) -> list[str]:
        return [c for c, v in self.named if v.axis in axes]

    def facets(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Cells by all variables and states (with their number n), by group and entry variables and locus, and by these and sample: one pass over the cells, written."""
        every = self.columns("row", "col", "entry")
        shared = [c for c, v in self.named if c[0] == "g" or v.axis == "entry"]
        sets = [[F.col(c) for c in [*every, "l", "r"]], *([F.col(c) for c in [*shared, name]] for name in ("locus", "s"))]
        missing = [F.grouping(c).alias(f"no_{c}") for c in ("l", "locus", "s")]
        grouped = self.cells.groupingSets(sets, *every, "l", "r", "locus", "s").agg(F.count("*").alias("n"), *missing)
        told = F.coalesce(*(F.col(c).cast("string") for c in self.columns("entry"))).isNotNull()  # a locus or sample counts for values that are there
        root = round_folder(self.cells.sparkSession, "concordance")
        kept = written(grouped.where((F.col("no_l") == 0) | told), f"{root}/facets")
        return kept.where("no_l = 0").select(*every, "l", "r", "n"), kept.where("no_locus = 0").select(*shared, "locus"), kept.where("no_s = 0").select(*shared, "s")

    def pairs(self, frame: DataFrame, hide: tuple[str, ...] = ()) -> Column:
        """An array with the key of each pair of variables; a variable on an axis of `hide`, or absent from the frame, has the value NULL."""

        def value(column: str, v: Variable) -> Column:
            return F.lit(None).cast("string") if v.axis in hide or column not in frame.columns else F.col(column).cast("string")

        groups = [(ALL, F.lit(ALL)), *((v.name, value(f"g{i}", v)) for i, v in enumerate(self.groups))]
        aggs = [(ALL, F.lit(ALL)), *((v.name, value(f"a{i}", v)) for i, v in enumerate(self.aggs))]
        return F.array(*(F.struct(F.lit(g).alias(KEY[0]), gv.alias(KEY[1]), F.lit(a).alias(KEY[2]), av.alias(KEY[3])) for g, gv in groups for a, av in aggs))

    def expand(self, frame: DataFrame, *keep: str, hide: tuple[str, ...] = (), entries: bool = False) -> DataFrame:
        """A row for each pair of variables; entries: for those whose aggregation variable is one of entries and has a value."""
        pairs = self.pairs(frame, hide)
        if entries:
            names = [v.name for v in self.aggs if v.axis == "entry"]
            pairs = F.filter(pairs, lambda k: k[KEY[2]].isin(names) & k[KEY[3]].isNotNull())
        return frame.select(*keep, F.explode(pairs).alias("k")).select(*keep, *(f"k.{c}" for c in KEY))

    def counts(self, key: list[str], grid: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """The 25 counts for `key` and each pair; grid: key, row and col variables, and the number of `cells`; seen: the cells by key, variables and states, if they are counted already."""
        if seen is None:
            seen = self.cells.groupBy(*key, *self.columns("row", "col", "entry"), "l", "r").agg(F.count("*").alias("n"))
        observed = self.expand(seen, *key, "l", "r", "n")
        place = [F.lit(0).alias("l"), F.lit(0).alias("r")]
        lacking = self.expand(seen, *key, "n", hide=("entry",)).select(*key, *place, (-F.col("n")).alias("n"), *KEY)
        whole = self.expand(grid, *key, "cells").select(*key, *place, F.col("cells").alias("n"), *KEY)
        parts = observed.select(*key, "l", "r", "n", *KEY).unionByName(lacking).unionByName(whole)
        return parts.groupBy(*key, *KEY).agg(*count_cells(F.col("n")), F.sum("n").alias("n_cells"))

    def distinct(self, frame: DataFrame, column: str, name: str, hide: tuple[str, ...] = (), entries: bool = False) -> DataFrame:
        """Distinct values of a column for each pair."""
        return self.expand(frame, column, hide=hide, entries=entries).groupBy(*KEY).agg(F.count_distinct(column).cast("long").alias(name))


def _matched(j: _Joined, counts: DataFrame, numbers: DataFrame, name: str, hidden: tuple[str, ...]) -> DataFrame:
    """Join numbers that do not depend on the variables of the hidden axes."""
    shown = lambda kind, side, value: F.when(F.col(f"{side}{kind}_var_name").isin([v.name for v in (j.groups if kind == "group" else j.aggs) if v.axis in hidden] or [""]), F.lit(None)).otherwise(F.col(f"{side}{value}"))
    n = numbers.select(*(F.col(c).alias(f"_{c}") for c in KEY), name)
    on = (F.col(KEY[0]) == F.col(f"_{KEY[0]}")) & (F.col(KEY[2]) == F.col(f"_{KEY[2]}"))
    for kind, value in (("group", KEY[1]), ("agg", KEY[3])):
        on = on & shown(kind, "", value).eqNullSafe(F.col(f"_{value}"))
    return counts.join(n, on, "left").drop(*(f"_{c}" for c in KEY))


def global_concordance(exo: CallSet, imp: CallSet, groups: list[Variable] = (), aggs: list[Variable] = (), join_type: JoinType = JoinType.inner) -> ConcordanceTable:
    j = _Joined(exo, imp, list(groups), list(aggs), join_type)
    entry_aggs = [v.name for v in j.aggs if v.axis == "entry"]
    seen, loci, samples = j.facets() if entry_aggs else (None, None, None)
    rows = j.variants.groupBy(*j.columns("row")).agg(F.count("*").alias("nv"))
    cols = j.samples.groupBy(*j.columns("col")).agg(F.count("*").alias("ns"))
    grid = rows.crossJoin(F.broadcast(cols)).withColumn("cells", F.col("nv") * F.col("ns"))  # a row for each combination of bins
    counts = j.counts([], grid, seen)
    plain = counts.where(~F.col("agg_var_name").isin(entry_aggs or [""]))
    plain = _matched(j, plain, j.distinct(j.variants, "locus", "n_variants", ("col", "entry")), "n_variants", ("col", "entry"))
    plain = _matched(j, plain, j.distinct(j.samples, "s", "n_samples", ("row", "entry")), "n_samples", ("row", "entry"))
    out = plain
    if entry_aggs:
        part = counts.where(F.col("agg_var_name").isin(entry_aggs))
        part = _matched(j, part, j.distinct(loci, "locus", "n_variants", entries=True), "n_variants", ())
        part = _matched(j, part, j.distinct(samples, "s", "n_samples", entries=True), "n_samples", ())
        out = plain.unionByName(part)
    return ConcordanceTable(_ordered(out, []), j.group_types, j.agg_types, ())


def variant_concordance(exo: CallSet, imp: CallSet, groups: list[Variable] = (), aggs: list[Variable] = (), join_type: JoinType = JoinType.inner) -> ConcordanceTable:
    """As above for each variant; variables of rows are not allowed."""
    if any(v.axis == "row" for v in [*groups, *aggs]):
        raise ValueError("per variant, variables of rows have one value")
    j = _Joined(exo, imp, list(groups), list(aggs), join_type)
    cols = j.samples.groupBy(*j.columns("col")).agg(F.count("*").alias("cells"))
    counts = j.counts([*VARIANT], j.variants.select(*VARIANT).crossJoin(F.broadcast(cols)))
    counts = counts.join(j.variants.select(*VARIANT, F.col("locus").isNotNull().cast("long").alias("n_variants")), [*VARIANT])
    entry_aggs = [v.name for v in j.aggs if v.axis == "entry"]
    counts = _matched(j, counts, j.distinct(j.samples, "s", "all_samples", ("row", "entry")), "all_samples", ("row", "entry"))
    own = F.when(F.col("agg_var").isNotNull(), F.col("n_cells"))
    counts = counts.withColumn("n_samples", F.when(F.col("agg_var_name").isin(entry_aggs or [""]), own).otherwise(F.col("all_samples"))).drop("all_samples")
    key = ["contig", "position", "ref", "alt"]
    counts = counts.withColumn("ref", F.get("alleles", F.lit(0))).withColumn("alt", F.array_join(F.slice("alleles", 2, 1 << 20), ",")).drop("alleles")
    return ConcordanceTable(_ordered(counts, key), j.group_types, j.agg_types, tuple(key))


def sample_concordance(exo: CallSet, imp: CallSet, join_type: JoinType = JoinType.inner) -> ConcordanceTable:
    """Over all variants, for each sample."""
    j = _Joined(exo, imp, [], [], join_type)
    size = j.variants.agg(F.count("*").alias("cells"), F.count_distinct("locus").alias("n_variants"))
    counts = j.counts(["s"], j.samples.select("s").crossJoin(F.broadcast(size.select("cells"))))
    counts = counts.crossJoin(F.broadcast(size.select("n_variants"))).withColumn("n_samples", F.lit(1).cast("long"))
    return ConcordanceTable(_ordered(counts, ["s"]), j.group_types, j.agg_types, ("s",))


def _ordered(counts: DataFrame, key: list[str]) -> DataFrame:
    out = with_statistics(counts.drop("n_cells"))
    first = [*key, *KEY, "n_variants", "n_samples"]
    return out.select(*first, *(c for c in out.columns if c not in first))


# the table needs the operators above, and they return it
from allelarium.operators.views import ConcordanceTable  # noqa: E402
