"""Quality rules: base rules, then an isolation forest over the rules' statistics.

The forest is fitted on the driver from a bounded sample of labelled rows that
pass the base rules. It reads the rules' statistics themselves (`RULES`). Every
tree splits a subsample at random features and random values, and the expected
path length of a document says how soon random splits set it apart. Anomalous
documents have short paths. So that many copies of junk don't pass for usual,
rows labelled bad are at most `BAD_SHARE` of a subsample; splits don't see the
labels. The threshold on the anomaly score is calibrated on the sample: a good
row lost weighs `weight` times a bad row caught. Trees are flattened into arrays, so a slice of
documents is scored by vectorised numpy traversal.

Edge cases: a null or empty text has no words, so it fails the base rules;
repeated rows are judged alike; without any labelled row the forest is not
fitted and the base rules alone decide; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import Words, read_table, text_slices
from allelarium.llm.labelled import SAMPLE_ROWS, labelled_sample
from allelarium.llm.text_stats import COUNTS, RATIOS, SHARES, slice_stats, symbol_shares

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: What the forest reads: symbols by four measures, and how uneven words and bytes are. Repeats have a base rule of their own.
RULES = ("symbols", *SHARES, "top_word", "distinct_words", "entropy")
#: Rows of a tree, and the share of them that rows labelled bad have at most.
TREE_ROWS, BAD_SHARE = 128, 0.05


def _harmonic_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.maximum(n, 2).astype(float)
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees in heap order: node i has the children 2i+1 and 2i+2; a leaf repeats its path length below."""

    feature: np.ndarray  # trees x inner nodes
    value: np.ndarray
    path: np.ndarray  # trees x nodes of the last level
    norm: float
    threshold: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, bad: np.ndarray | None = None, *, trees: int = 256, rows: int = TREE_ROWS, seed: int = 7) -> IsolationForest:
        """Trees over subsamples, of which rows marked bad are at most BAD_SHARE: what is anomalous has to be rare there."""
        bad = np.zeros(len(x), bool) if bad is None or bad.all() else bad
        rng = np.random.default_rng(seed)
        rest, odd = np.flatnonzero(~bad), np.flatnonzero(bad)
        rows = min(rows, len(x))
        few = min(len(odd), max(1, int(BAD_SHARE * rows)))
        rows = min(rows, len(rest) + few)
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        inner, last = 2**depth - 1, 2**depth
        feature, value, path = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, last))
        for t in range(trees):
            members = {0: np.concatenate((rng.choice(rest, rows - few, replace=False), rng.choice(odd, few, replace=False)))}
            for node in range(inner):
                at = members.get(node)
                if at is None or len(at) < 2:
                    continue
                low, high = x[at].min(0), x[at].max(0)
                if not (varied := np.flatnonzero(high > low)).size:
                    continue
                f = int(rng.choice(varied))
                v = rng.uniform(low[f], high[f])
                feature[t, node], value[t, node] = f, v
                right = x[at, f] > v
                members[2 * node + 1], members[2 * node + 2] = at[~right], at[right]
            for leaf in range(last):
                node, level = inner + leaf, depth
                while node not in members:
                    node, level = (node - 1) // 2, level - 1
                at = len(members[node])
                path[t, leaf] = level + (_harmonic_path(np.array([at]))[0] if at > 1 else 0.0)
        return cls(feature, value, path, float(_harmonic_path(np.array([rows]))[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path length over the expected one."""
        total, inner = np.zeros(len(x)), self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, value, path in zip(self.feature, self.value, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            total += path[node - inner]
        return 2.0 ** (-total / len(self.feature) / self.norm)

    def calibrate(self, x: np.ndarray, good: np.ndarray, weight: float) -> None:
        """Set the threshold where the share of bad rows caught less `weight` times the share of good rows lost is greatest, in the widest such gap."""
        s = self.score(x)
        if not good.any() or good.all():
            return
        cuts = np.append(np.unique(s), 1.0)
        middle = (cuts[:-1] + cuts[1:]) / 2
        beyond = lambda v: (len(v) - np.searchsorted(np.sort(v), middle, "right")) / len(v)
        balance = beyond(s[~good]) - weight * beyond(s[good])
        best = np.flatnonzero(balance >= balance.max() - 1e-12)
        self.threshold = float(middle[best[np.argmax(np.diff(cuts)[best])]])


def base_failed(counts: np.ndarray) -> np.ndarray:
    n = counts[:, COUNTS.index("n_words")]
    return (n < MIN_WORDS) | (100 * counts[:, COUNTS.index("n_repeat_words")] > MAX_REPEAT_PERCENT * n)


def _statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the counts named in COUNTS and the statistics named in RULES."""
    found = Words(column, lower=False)
    counts, ratios = slice_stats(column, found)
    known = dict(zip(RATIOS, ratios.T, strict=True)) | dict(zip(SHARES, symbol_shares(found, counts[:, COUNTS.index("word_chars")]).T, strict=True))
    return counts, np.stack([known[r] for r in RULES], axis=1)


def fit_forest(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, weight: float = 10.0, trees: int = 256, seed: int = 7) -> IsolationForest | None:
    """Forest and threshold from a bounded sample of labelled documents that pass the base rules."""
    schema = ", ".join(["doc_id long", "label int", "failed boolean", *(f"f{i} double" for i in range(len(RULES)))])

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                counts, x = _statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(base_failed(counts)), *(pa.array(x[:, j]) for j in range(len(RULES)))], ["doc_id", "label", "failed", *(f"f{i}" for i in range(len(RULES)))])

    got = labelled_sample(docs, labels, "quality", rows).mapInArrow(stats, schema).where("not failed").toPandas().sort_values(["doc_id", "label", *(f"f{i}" for i in range(len(RULES)))])
    if not len(got):
        return None
    x, good = got[[f"f{i}" for i in range(len(RULES))]].to_numpy(float), got["label"].to_numpy() == 1
    forest = IsolationForest.fit(x, ~good, trees=trees, seed=seed)
    forest.calibrate(x, good, weight)
    return forest


def _judge(forest: IsolationForest | None, id_first: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                counts, x = _statistics(part.column(1))
                failed = base_failed(counts)
                score = forest.score(x) if forest else np.zeros(len(counts))
                kept = ~failed & (score <= (forest.threshold if forest else 1.0))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(score)], [*part.schema.names, *COUNTS, "base_failed", "kept", "anomaly_score"])

    return run


_VERDICT = ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "anomaly_score double"])


def apply_rules(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept and the anomaly score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judge(forest), f"doc_id long, text string, {_VERDICT}").drop("text")


def keep_good_documents(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """The rows of a `documents` table that the rules keep, with its columns; judged in one pass, without a join."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    judged = rows.mapInArrow(_judge(forest), f"doc_id long, text string, lang string, source string, n_chars long, {_VERDICT}")
    return judged.where("kept").select(*rows.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly_score."""
    docs = read_table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_forest(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
