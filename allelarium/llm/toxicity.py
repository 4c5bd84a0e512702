"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

The windows of a text are its words, each between two marks, so that a word
that a dictionary knows is one match and a word of which it knows the stem is a
shorter one. The distance of a window is its compressed length with the
ordinary dictionary less that with the toxic one, in bytes. A text's statistic
is the number of its far windows, over the root of the number of all; from
which distance on a window is far, and the score that a statistic stands for,
are calibrated on the labelled rows. Dictionaries and calibration are fitted on
the driver from at most `rows` labelled documents, none of them held out.

Toxic texts are ordinary text but for a few words, so the windows that train a
dictionary are chosen by contrast: by the number of distinct preceding words in
each class (copies of a text add none), toxic ones must be `RATIO` times as
usual in toxic texts as in ordinary ones and have `LEAST` contexts. A sample of
the training holds `PACK` windows side by side: from samples of one short
window each, training drops the most telling ones. Toxic windows that the
trained dictionary still doesn't hold are added to its content, so more labels
never lose a window. At most `WINDOWS` windows train each dictionary. Only
words enter a score: no label, language, source or id.

A window is one word, so a passage that is toxic by its order of ordinary words
alone is not seen. Dictionaries over windows of two and four words were
measured and found less: README.md has the figures.

Every distinct word of a task is compressed once while the table has at most
`TABLE_WORDS` of them; memory is bounded by that and one slice of texts.

Edge cases: a null or empty text has no windows and the score of one without
any far window; repeated rows get equal scores; where labels of one class or
both are missing, or no window stands out, every distance is 0 and the score is
the share of toxic labels; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import MARKS, Scratch, Words, held_out, read_table, text_slices
from allelarium.llm.labelled import SAMPLE_ROWS, labelled_sample

PREDICT_AT = 0.3
LEAST, RATIO = 4, 8.0
WINDOWS = 20_000
DICTIONARY_BYTES = 256 << 10
LEVEL = 19
TABLE_WORDS = 1 << 20
#: Distances, in bytes, of which one becomes the threshold of a far window.
FAR = tuple(range(2, 13))
#: Windows in a sample of the training.
PACK = 8
_OPEN, _CLOSE = b"\x02\x1c\x1d\x1e", b"\x1f\x1c\x1d\x03"


def _window(word: bytes) -> bytes:
    return _OPEN + word + _CLOSE


def train(windows: list[tuple[bytes, int]], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from (word, contexts), in packs of PACK windows; frequent ones are given more often. Too little text for training is taken as it is."""
    given = [_window(w) for w, n in windows for _ in range(min(16, 2 + int(math.log2(max(1, n)))))]
    random.Random(0).shuffle(given)
    try:
        return zstandard.train_dictionary(size, [b"".join(given[i : i + PACK]) for i in range(0, len(given), PACK)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(_window(w) for w, _ in windows)[-size:]


def train_pair(toxic: list[tuple[bytes, int]], ordinary: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary. Toxic windows that come out no shorter with the toxic one are added to its content."""
    if not toxic or not ordinary:
        return b"", b""
    # the most usual windows last: matches at the end of a dictionary are the cheapest
    pair = train(toxic[::-1]), train(ordinary[::-1])
    lost = [w for w, _ in toxic[::-1] if Distances(*pair).of(w) <= 0]
    return pair[0] + b"".join(map(_window, lost)), pair[1]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distances:
    """Distances of the words of texts."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = (_compressor(ordinary), _compressor(toxic)) if toxic and ordinary else None
        self.table: dict[int, int] = {}

    def of(self, word: bytes) -> int:
        ordinary, toxic = self.pair
        return len(ordinary.compress(_window(word))) - len(toxic.compress(_window(word)))

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text its windows, and for each of FAR those at least so far."""
        words = Words(column, blank=MARKS)
        out = np.zeros((len(words), len(FAR)), np.int64)
        if self.pair is None or not len(words.hashes):
            return np.diff(words.bounds), out
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        far = np.empty(len(distinct), np.int64)
        for k, (h, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            d = self.table.get(h)
            if d is None:
                d = self.table[h] = self.of(words.word(at).lower())
            far[k] = d
        each = far[inverse]
        for j, f in enumerate(FAR):
            out[:, j] = np.diff(np.concatenate(([0], np.cumsum(each >= f)))[words.bounds])
        return np.diff(words.bounds), out


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    far: int  # from this distance on a window is far
    slope: float
    constant: float

    def score(self, windows: np.ndarray, far: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * far / np.sqrt(np.maximum(windows, 1)) + self.constant, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float, float]:
    """Slope (not negative), constant and mean loss of a logistic function of one statistic, by Newton's method."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, a = np.array([0.0, np.log(share / (1 - share))]), np.column_stack((x, np.ones(len(x))))
    loss = lambda w: float(np.mean(np.logaddexp(0, a @ w) - y * (a @ w))) + ridge * w[0] ** 2 / 2 / max(1, len(y)) if len(y) else 0.0
    if len(y) and 0 < y.sum() < len(y) and x.any():
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9]), a.T @ (p - y) + np.array([ridge * w[0], 0]))
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
    if w[0] <= 0:
        w = np.array([0.0, np.log(share / (1 - share))])
    return float(w[0]), float(w[1]), loss(w)


def calibrate(windows: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[int, float, float]:
    """The threshold of FAR whose statistic tells the labels best, with the slope and constant of its score."""
    fits = [_logistic(counts[:, j] / np.sqrt(np.maximum(windows, 1)), y) for j in range(len(FAR))]
    best = min(range(len(FAR)), key=lambda j: fits[j][2])
    return FAR[best], fits[best][0], fits[best][1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, before, label): the distinct pairs of a word and the one before it, of each label."""
    for batch in batches:
        for part in text_slices(batch, 1):
            words = Words(part.column(1), blank=MARKS)
            label = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(words.bounds))
            before = np.zeros(len(words.hashes), np.uint64)
            before[1:] = words.hashes[:-1]
            starts = words.bounds[:-1]
            before[starts[starts < len(before)]] = 0
            key = np.column_stack((words.hashes, before, label))
            _, at = np.unique(key, axis=0, return_index=True) if len(key) else (None, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([words.word(k).lower() for k in at.tolist()], pa.binary()), pa.array(before[at].view(np.int64)), pa.array(label[at].astype(np.int32))], ["word", "before", "label"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Dictionaries and score from at most `rows` labelled documents that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(labelled_sample(docs, labels, "toxic", rows, ~held_out()), "sample")
    counts = sample.mapInArrow(_contexts, "word binary, before long, label int").distinct()
    counts = scratch.write(counts.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary")).where("toxic + ordinary > 1"), "counts")
    total = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    n_toxic, n_ordinary = total[0] or 0, total[1] or 0
    toxic_words: list[tuple[bytes, int]] = []
    ordinary_words: list[tuple[bytes, int]] = []
    if n_toxic and n_ordinary:
        usual = (F.col("ordinary") + 0.5) / n_ordinary
        often = F.col("toxic") / n_toxic > RATIO * usual
        pick = lambda rows, c: [(bytes(r["word"]), r[c]) for r in rows.orderBy(F.desc(c), "word").limit(WINDOWS).collect()]
        toxic_words = pick(counts.where(often & (F.col("toxic") >= LEAST)), "toxic")
        ordinary_words = pick(counts.where(~often & (F.col("ordinary") > 1)), "ordinary")
    toxic, ordinary = train_pair(toxic_words, ordinary_words)
    names = [f"far_{f}" for f in FAR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(toxic, ordinary)
        for batch in batches:
            for part in text_slices(batch, 1):
                windows, counts = distances.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(windows), *(pa.array(counts[:, j]) for j in range(len(FAR)))], ["doc_id", "label", "windows", *names])

    got = sample.mapInArrow(run, ", ".join(["doc_id long", "label int", "windows long", *(f"{c} long" for c in names)])).toPandas().sort_values("doc_id")
    scratch.close()
    return ToxicityModel(toxic, ordinary, *calibrate(got["windows"].to_numpy(float), got[names].to_numpy(float), got["label"].to_numpy(float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    at = FAR.index(model.far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            for part in text_slices(batch, 1):
                windows, counts = distances.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(windows, counts[:, at]))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
