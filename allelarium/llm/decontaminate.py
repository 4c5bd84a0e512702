"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are sequences of words (runs of letters and digits, A-Z lower-cased). A
first pass over the corpus counts, for every n-gram of the test items, the
documents that have it. Of each `window` n-grams in a row of an item the one in
the fewest documents is a seed, so any `n` + `window` - 1 words of an item that
occur in a row hold one, however frequent all of them are; an item with fewer
words has all of its n-grams, or itself if it is shorter still, as seeds. A
second pass joins documents to items by their seeds, and aligns the words around
the diagonals of all n-grams that such a pair shares with the item: +2 for a
match, -1 for a mismatch or a gap. A pair is a leak where the best local
alignment reaches `threshold` of the item's own score. Only stretches that
cannot reach it are not aligned: a word that the other side lacks costs 1
whichever way it is passed, which bounds the score at little cost. With a window
of 1 every n-gram is a seed and nothing is counted: that is the exact form, the
default of the functions, which the recall of rare seeds is measured against.
The query and the pipeline take `WINDOW`.

Test items go to the executors in blocks of at most `BLOCK_CHARS` characters,
two passes over the corpus for each block; `find_leaks` holds a block at a time
in a task, `drop_leaks` all of them, one after another.

Edge cases: null and empty texts, and items without a word, match nothing;
repeated documents or items each give their own rows, whatever their ids; a null
doc_id or item_id is carried along; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import MARKS, Words, read_table, shingle_hashes, text_slices

SEED_WORDS = 3
WINDOW = 4
THRESHOLD = 0.5
BLOCK_CHARS = 16 << 20
_LEAKS = "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long"


def alignment(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of the item in the words, and where it starts and ends there."""
    score, end = _best(item, words)
    _, back = _best(item[::-1], words[:end][::-1])
    return score, end - back, end


def _best(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    n = len(words)
    places = np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = row[:-1] + np.where(words == word, 2, -1)
        new = np.maximum(np.maximum(new, row - 1), 0)
        new = np.maximum.accumulate(new + places) - places  # gaps along the words cost 1 each
        at = int(new.argmax())
        if new[at] > best:
            best, end = int(new[at]), at
        row = new
    return best, end


def most(item: np.ndarray, words: np.ndarray) -> int:
    """A score that no local alignment of the item in the words exceeds: the best stretch of either, at 2 for a word that the other has and -1 for one it lacks."""
    bounds = []
    for a, b in ((item, words), (words, item)):
        total = np.concatenate(([0], np.cumsum(np.where(np.isin(a, b), 2, -1))))
        bounds.append(int((total - np.minimum.accumulate(total)).max()))
    return min(bounds)


class Items:
    """Word hashes of a block of test items, their n-grams sorted by hash, and which of those are seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None], n: int = SEED_WORDS):
        words = Words(pa.array(texts, pa.string()), blank=MARKS)
        self.ids, self.n = ids, n
        self.words = [words.of(i) for i in range(len(ids))]
        seeds = [shingle_hashes(w, n) for w in self.words]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if ids else np.zeros(0, np.int64)
        every = np.concatenate(seeds) if ids else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner, self.place = every[order], owner[order], place[order]
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < n})
        self.rare = np.ones(len(self.seeds), bool)
        self.distinct = np.unique(self.seeds)
        self.first = self.distinct

    def choose(self, counts: np.ndarray, window: int) -> None:
        """Keep as seeds, of each `window` in a row, the one in the fewest documents (of equal ones the first); counts: by distinct n-gram."""
        count = counts[np.searchsorted(self.distinct, self.seeds)]
        at = np.lexsort((self.place, self.owner))
        starts = np.searchsorted(self.owner[at], np.arange(len(self.ids) + 1))
        self.rare = np.zeros(len(self.seeds), bool)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            here = at[lo:hi]
            if len(here) <= window:
                self.rare[here] = True
            else:
                near = np.lib.stride_tricks.sliding_window_view(count[here], window)
                self.rare[here[np.unique(near.argmin(1) + np.arange(len(near)))]] = True
        self.first = np.unique(self.seeds[self.rare])

    def grams(self, words: np.ndarray) -> np.ndarray:
        """The n-grams of the words, and all of the lengths of shorter items."""
        return np.concatenate([shingle_hashes(words, k) for k in (*self.short, self.n) if len(words) >= k] or [np.zeros(0, np.uint64)])

    def among(self, known: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The places in `known`, in order, of those that occur in the words."""
        grams = self.grams(words)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.unique(at[known[at] == grams])

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the words, index of an n-gram) for every n-gram of every item that has a seed in them."""
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.among(self.first, words)):
            return empty
        at, seed = self._all(words)
        joined = np.zeros(len(self.ids), bool)
        joined[self.owner[seed[self.rare[seed]]]] = True
        keep = joined[self.owner[seed]]
        return at[keep], seed[keep]

    def _all(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for k in (*self.short, self.n):
            if len(words) < k:
                continue
            grams = shingle_hashes(words, k)
            lo = np.searchsorted(self.seeds, grams, "left")
            inside = np.minimum(lo, len(self.seeds) - 1)
            at = np.flatnonzero(self.seeds[inside] == grams)
            if len(at):
                many = np.searchsorted(self.seeds, grams[at], "right") - lo[at]
                start = np.repeat(lo[at], many)
                step = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
                found.append((np.repeat(at, many), start + step))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])


def _leaks_of(items: Items, threshold: float, mine: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
    """For each item that the words leak: its index, score, distinct seeds and the best stretch, of equal ones the first."""
    at, seed = items.hits(mine)
    owner = items.owner[seed]
    for item in np.unique(owner):
        here = owner == item
        own = items.words[item]
        size = len(own)
        start = np.sort(at[here] - items.place[seed[here]])
        lo, hi = start - size // 2 - 1, start + size + size // 2 + 1
        cut = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1
        best, place = 0, (0, 0)
        for a, b in zip([0, *cut], [*cut, len(lo)], strict=True):
            first, last = max(0, int(lo[a])), min(len(mine), int(hi[a:b].max()))
            bound = most(own, mine[first:last])
            if bound <= best or bound < threshold * 2 * size:
                continue
            score, begin, end = alignment(own, mine[first:last])
            if score > best:
                best, place = score, (first + begin, first + end)
            if best == 2 * size:
                break
        if best and best >= threshold * 2 * size:
            yield int(item), best / (2 * size), len(np.unique(items.seeds[seed[here]])), *place


def _leaks(items: Items, threshold: float):
    """Rows of _LEAKS for texts in the second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                words = Words(part.column(1), blank=MARKS)
                out = [(doc_id, items.ids[item], *rest) for i, doc_id in enumerate(part.column(0).to_pylist()) for item, *rest in _leaks_of(items, threshold, words.of(i))]
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"])

    return run


def _clean(items: Items, threshold: float, text: int):
    """The rows whose text, in the column numbered `text`, leaks no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                words = Words(part.column(text), blank=MARKS)
                yield part.filter(pa.array([next(_leaks_of(items, threshold, words.of(i)), None) is None for i in range(len(words))], pa.bool_()))

    return run


def document_counts(texts: DataFrame, items: Items) -> np.ndarray:
    """For each distinct n-gram of a block the rows of `texts` (text) that have it; as many numbers as the block has n-grams come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.distinct), np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                words = Words(part.column(0), blank=MARKS)
                for i in range(len(words)):
                    counts[items.among(items.distinct, words.of(i))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    found = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.distinct), np.int64)
    counts[found["at"]] = found["n"]
    return counts


def _blocks(docs: DataFrame, benchmark: DataFrame, n: int, window: int, block_chars: int) -> Iterator[Items]:
    """The test items in blocks of a bounded size, those without seeds left out, with their seeds chosen."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_chars // 2)))  # half full on average
    for k in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = Items([r[0] for r in mine], [r[1] for r in mine], n)
        if len(items.seeds):
            if window > 1:
                items.choose(document_counts(texts, items), window)
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = SEED_WORDS, window: int = 1, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, start_word, end_word): the best stretch of each document that leaks an item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [texts.mapInArrow(_leaks(items, threshold), _LEAKS) for items in _blocks(docs, benchmark, n, window, block_chars)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = SEED_WORDS, window: int = 1, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text leaks no test item, with their columns; judged row by row, so ids don't matter."""
    left = docs.withColumn("text", F.col("text").cast("string"))
    for items in _blocks(docs, benchmark, n, window, block_chars):
        left = left.mapInArrow(_clean(items, threshold, left.columns.index("text")), left.schema)
    return left


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it leaks, with the alignment's score and place."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=WINDOW)


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
