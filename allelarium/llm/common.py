"""Helpers that every operator of this subpackage shares: tables, scratch space, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.sources.files import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Scratch:
    """Intermediate tables of one query, as Parquet files in the shared folder.

    A written table cuts lineage and outlives a lost executor. `drop` removes a
    table that nothing reads any more; what the lazy result still reads goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        out = f"{self.root}/{name}"
        writer = df.write.mode("error").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
        return self.spark.read.schema(df.schema).parquet(out) if not partition_by else self.spark.read.parquet(out)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = _path(self.spark, f"{self.root}/{name}")
            fs.delete(path, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            fs, path = _path(self.spark, self.root)
            fs.delete(path, True)


#: Rows that a broadcast list of frequent keys has at most.
FREQUENT_KEYS = 100_000


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Left join to groups (key, n: rows of the key, more), one for a key, without gathering a frequent key's rows in a task.

    Of `total` rows at most FREQUENT_KEYS keys have more than total / FREQUENT_KEYS
    each: those are broadcast, and only rows of other keys are shuffled.
    """
    most = max(1_000, total // FREQUENT_KEYS)
    hot = groups.where(F.col("n") > most).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left").drop("n")
    rest = marked.where("_hot is null").select(*rows.columns)
    cold = rest.join(groups.where(F.col("n") <= most).drop("n"), key, "left")
    return marked.where("_hot").drop("_hot").unionByName(cold)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of ids that no label is learnt from: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words; different `^ seed` inputs give independent orders."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes; of the whole sequence where there are fewer; of nothing: empty."""
    if not len(words):
        return words
    k = min(n, len(words))
    m = len(words) - k + 1
    out = np.full(m, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m])
    return out


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character but letters and digits.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column of texts, found and hashed by array operations alone.

    `hashes` has a 64-bit hash for each word (a polynomial over random byte
    codes, then scrambled with the length), `starts` and `ends` its place in
    `data`, the UTF-8 of all texts; text i has the words bounds[i]:bounds[i+1]
    and the bytes offsets[i]:offsets[i+1]. A null counts as an empty text.
    `blank` says for each byte whether it parts words.
    """

    def __init__(self, column: pa.Array, lower: bool = True, blank: np.ndarray = BLANK):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        base, end = (self.offsets[0], self.offsets[-1]) if len(column) else (0, 0)
        self.data = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
        self.offsets = self.offsets - base if len(column) else np.zeros(1, np.int64)
        codes = LOWER[self.data] if lower else self.data
        word = ~blank[codes]
        first, last = word.copy(), word.copy()
        if len(word):
            cut = self.offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(word))]
            first[1:] &= ~word[:-1]
            first[cut] = word[cut]
            last[:-1] &= ~word[1:]
            last[cut - 1] = word[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.lengths = self.ends - self.starts
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.hashes = np.zeros(0, np.uint64)
        if len(self.starts):
            places = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
            powers = np.full(int(self.lengths.max()), _BASE, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            within = np.arange(int(self.lengths.sum())) - np.repeat(places, self.lengths)
            terms = _BYTE[codes[word]] * powers[within]
            self.hashes = mix64(np.add.reduceat(terms, places) ^ (self.lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def text_slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows, cut sooner where the texts reach `size` bytes: memory stays bounded."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop
