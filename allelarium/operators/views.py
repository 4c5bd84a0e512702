"""Concordance results: stored tables, filtered and ordered views, exports, plot data."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.operators.confusion import FIELDS
from allelarium.sources.files import make_folder, read_text, write_text
from allelarium.sources.one_file import write_one_file

KEY = ("group_var_name", "group_var", "agg_var_name", "agg_var")
STATISTICS = ("nonref_concordance_rate", "concordance_rate", "f1_score")


class ConcordanceTable:
    """Long-form concordance with the types of its variables' values."""

    def __init__(self, df: DataFrame, group_types: dict[str, str], agg_types: dict[str, str], key: tuple[str, ...]):
        self.df, self._group_types, self._agg_types, self.key = df, dict(group_types), dict(agg_types), tuple(key)
        self._views: list[ConcordanceView] = []

    @property
    def group_vars(self) -> dict[str, str]:
        return dict(self._group_types)

    @property
    def agg_vars(self) -> dict[str, str]:
        return dict(self._agg_types)

    def write(self, path: str, overwrite: bool = True) -> ConcordanceTable:
        """Write and read back: the result does not depend on the inputs any more."""
        self.df.write.mode("overwrite" if overwrite else "error").parquet(path)
        write_text(self.df.sparkSession, f"{path}/_meta.json", json.dumps({"groups": self._group_types, "aggs": self._agg_types, "key": self.key}))
        return ConcordanceTable.load(self.df.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ConcordanceTable:
        meta = json.loads(read_text(spark, f"{path}/_meta.json"))
        return ConcordanceTable(spark.read.parquet(path), meta["groups"], meta["aggs"], tuple(meta["key"]))

    def get_view(self, key: dict | None = None, group_names: list[str] | None = None, agg_names: list[str] | None = None, ordering: dict[str, list] | None = None) -> ConcordanceView:
        """Rows with the given key and variables; no names mean all. A variant key may be given by locus and alleles."""
        df = self.df
        for name, value in _key_parts(key or {}).items():
            if name not in self.key:
                raise ValueError(f"{name} is no key of this table; keys: {', '.join(self.key) or 'none'}")
            df = df.where(F.col(name) == F.lit(value))
        for names, known, column in ((group_names, self._group_types, "group_var_name"), (agg_names, self._agg_types, "agg_var_name")):
            if unknown := [n for n in names or [] if n not in known]:
                raise ValueError(f"no such variable: {', '.join(unknown)}")
            if names:
                df = df.where(F.col(column).isin(list(names)))
        view = ConcordanceView(df.where(F.col("group_var").isNotNull() & F.col("agg_var").isNotNull()), self.key, self._group_types, self._agg_types, ordering or {})
        self._views.append(view)
        return view

    def close(self) -> None:
        for view in self._views:
            view.close()


def _key_parts(key: dict) -> dict:
    parts = dict(key)
    if "locus" in parts:
        locus = parts.pop("locus")
        contig, position = locus.split(":") if isinstance(locus, str) else locus
        parts |= {"contig": contig, "position": int(position)}
    if "alleles" in parts:
        alleles = parts.pop("alleles")
        parts |= {"ref": alleles[0], "alt": ",".join(alleles[1:])}
    return parts


class ConcordanceView:
    """A filtered table in order: by variable, then by the stated order of its values, else by value."""

    fields = list(FIELDS)

    def __init__(self, df: DataFrame, key: tuple[str, ...], group_types: dict[str, str], agg_types: dict[str, str], ordering: dict[str, list]):
        self.key, self._types, self._ordering = key, {"group": group_types, "agg": agg_types}, ordering
        self.df = df.orderBy(*key, "group_var_name", *self._places("group"), "agg_var_name", *self._places("agg")).persist()

    def _places(self, kind: str) -> list:
        value, name = F.col(f"{kind}_var"), F.col(f"{kind}_var_name")
        numeric = [n for n, t in self._types[kind].items() if t not in ("string", "boolean")]
        stated = F.lit(None).cast("int")
        for variable, order in self._ordering.items():
            at = F.array_position(F.array(*(F.lit(str(v)) for v in order)), value) if order else F.lit(0)
            stated = F.when((name == variable) & (at > 0), at).otherwise(stated)
        number = F.when(name.isin(numeric or [""]), value.try_cast("double"))
        return [stated.asc_nulls_last(), number.asc_nulls_last(), value]

    def result(self) -> pd.DataFrame:
        """The view as a pandas frame, values of variables in their own types where a view has one variable of a kind."""
        out = self.df.toPandas()
        for kind in ("group", "agg"):
            names = out[f"{kind}_var_name"].unique()
            if len(names) == 1:
                cast = {"int": int, "bigint": int, "tinyint": int, "smallint": int, "double": float, "float": float, "boolean": lambda v: v == "true"}.get(self._types[kind].get(names[0], "string"))
                if cast:
                    out[f"{kind}_var"] = out[f"{kind}_var"].map(cast)
        return out

    def _selected(self, fields: dict[str, str] | None) -> DataFrame:
        """Keys and the fields {old name: new name}; None: all of them."""
        chosen = {f: f for f in self.fields} if fields is None else fields
        if unknown := [f for f in chosen if f not in self.df.columns]:
            raise ValueError(f"no such field: {', '.join(unknown)}")
        return self.df.select(*self.key, *KEY, "n_variants", "n_samples", *(F.col(old).alias(new) for old, new in chosen.items()))

    def _write(self, rows: DataFrame, path: str, **to_csv) -> None:
        """The rows as one delimited file with a header, each partition made into text by its own task."""
        whole = {name: "Int64" for name, kind in rows.dtypes if kind in ("int", "bigint")}
        options = {"index": False} | to_csv
        head = pd.DataFrame(columns=rows.columns).to_csv(**options).encode() if options.get("header", True) is not False else b""

        def encode(batch) -> Iterator[bytes]:
            yield batch.to_pandas(integer_object_nulls=True).astype(whole).to_csv(**(options | {"header": False})).encode()

        write_one_file(rows, path, header=head, encode=encode)

    def export(self, path: str, fields: dict[str, str] | None = None, **to_csv) -> None:
        """One delimited file, by default with commas."""
        self._write(self._selected(fields), path, **to_csv)

    def export_all(self, folder: str, fields: dict[str, str] | None = None, **to_csv) -> list[str]:
        """A tab-delimited file GROUP_AGG.tsv for each pair of variables; the paths."""
        rows, paths = self._selected(fields), []
        make_folder(self.df.sparkSession, folder)
        for group, agg in sorted(tuple(r) for r in self.df.select("group_var_name", "agg_var_name").distinct().collect()):  # pairs of variables
            paths.append(f"{folder.rstrip('/')}/{group}_{agg}.tsv")
            mine = rows.where((F.col("group_var_name") == group) & (F.col("agg_var_name") == agg))
            self._write(mine, paths[-1], **(to_csv | {"sep": "\t"}))
        return paths

    def plot_data(self, statistic: str = "nonref_concordance_rate") -> DataFrame:
        """agg_var_name, x, group, statistic and size of the points, without those that have no statistic."""
        if statistic not in STATISTICS:
            raise ValueError(f"no such statistic: {statistic}")
        value = F.col(f"{statistic}_raw") * 100
        return self.df.where(value.isNotNull()).select("group_var_name", F.col("group_var").alias("group"), "agg_var_name", F.col("agg_var").alias("x"), value.alias("statistic"), F.col("n_total").alias("size"))

    def plot(self, path: str | None = None, statistic: str = "nonref_concordance_rate"):
        """Facets of the statistic by aggregation variable, for one group variable; needs plotnine."""
        frame = self.plot_data(statistic).toPandas()
        if frame["group_var_name"].nunique() > 1:
            raise NotImplementedError("a plot has one group variable; see plot_all")
        return _render(frame, statistic, path)

    def plot_all(self, folder: str, statistic: str = "nonref_concordance_rate") -> dict:
        frame = self.plot_data(statistic).toPandas()
        return {g: _render(part, statistic, f"{folder}/{g}.png") for g, part in frame.groupby("group_var_name")}

    def close(self) -> None:
        self.df.unpersist()


def _render(frame: pd.DataFrame, statistic: str, path: str | None):
    import plotnine as p

    out = p.ggplot(frame, p.aes(x="x", y="statistic", color="group", group="group")) + p.geom_line() + p.geom_point(p.aes(size="size")) + p.facet_wrap("agg_var_name", scales="free_x") + p.ylab(statistic)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        out.save(path)
    return out
