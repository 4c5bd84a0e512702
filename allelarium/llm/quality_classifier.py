"""Quality classifier: histogram gradient-boosted trees over document statistics.

The features are the ratios of `text_stats` alone: no label, language, source
or id enters a score. Features are cut into at most `bins` quantile bins; each
tree grows level by level from histograms of gradients and second derivatives
of the logistic loss. Trees are complete and lie in flat arrays in heap order,
so a slice of documents descends all of them by numpy indexing. The model is
fitted on the driver from at most `rows` labelled documents, none of them held
out.

Edge cases: a null or empty text has the statistics of an empty text and is
scored like any other; repeated rows get equal scores; with labels of one class
or none, every score is that class's share (0.5 where there is none); an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import held_out, read_table, text_slices
from allelarium.llm.labelled import SAMPLE_ROWS, labelled_sample
from allelarium.llm.text_stats import RATIOS, slice_stats

PREDICT_AT = 0.7


@dataclass
class BoostedTrees:
    """`feature` and `value`: trees x inner nodes; `leaf`: trees x leaves, in log-odds; `start`: the log-odds before any tree."""

    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray
    start: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least_rows: int = 10) -> BoostedTrees:
        n, m = x.shape
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        start = float(np.log(share / (1 - share)))
        inner, leaves = 2**depth - 1, 2**depth
        if n == 0 or y.min() == y.max():
            return cls(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
        feature, value, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        margin = np.full(n, start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)  # within the level
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-9)
                cut = np.full(width, bins)
                for j in range(m):
                    key = node * bins + binned[:, j]
                    gs, hs, cs = (np.bincount(key, weights=w, minlength=width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                    gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                    gain[(cs < least_rows) | (cs[:, -1:] - cs < least_rows)] = 0
                    gain[:, len(edges[j]) :] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[np.arange(width), at][better]
                    feature[t, first : first + width][better] = j
                    cut[better] = at[better]
                    value[t, first : first + width][better] = edges[j][at[better]]
                node = 2 * node + (binned[np.arange(n), feature[t, first + node]] > cut[node])
            leaf[t] = -rate * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + ridge)
            margin += leaf[t][node]
        return cls(feature, value, leaf, start)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        margin, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.feature.shape[1]
        for feature, value, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, **parameters) -> BoostedTrees:
    """Trees from at most `rows` labelled documents that are not held out."""
    names = [f"f{i}" for i in range(len(RATIOS))]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                ratios = slice_stats(part.column(1))[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(ratios[:, j]) for j in range(len(names)))], ["doc_id", "label", *names])

    sample = labelled_sample(docs, labels, "quality", rows, ~held_out())
    got = sample.mapInArrow(stats, ", ".join(["doc_id long", "label int", *(f"{c} double" for c in names)])).toPandas().sort_values(["doc_id", "label", *names])
    return BoostedTrees.fit(got[names].to_numpy(float), got["label"].to_numpy(float), **parameters)


def score_quality(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                score = model.score(slice_stats(part.column(1))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
