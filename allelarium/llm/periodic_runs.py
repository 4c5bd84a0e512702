"""Periodic run detection with a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words with smallest period q - words q apart are equal -
that no neighbouring word extends, with at least `min_words` words and
`min_exponent` periods. The suffix automaton of a text groups its substrings by
the set of their ends; going from long states to short ones, each state's set
is merged into that of its suffix link, the smaller into the larger. Where two
ends become neighbours in a state and lie no farther apart than the length of
the state, a square ends there: it is extended both ways to its run, once for
each run. A run of exponent 2 or more has such neighbours one period apart, as
its root occurs at no smaller distance inside it.

Before that, the text is cut where no run can pass: every short gram inside a
run recurs in it (its length is chosen from the least run, so that this holds),
so a gram that occurs once in a piece ends it. Ordinary prose is gone after
that, and the automaton is built for what repeats.

Texts are independent, so there is no shuffle: a task maps Arrow batches, a
bounded number of bytes at a time. Memory grows with the repeating piece of a
single text, some 500 bytes a word.

Edge cases: a null text has no words; an empty one likewise; words are compared
as bytes, whole and case-sensitive; repeated rows are rows of their own; a null
id stays; an empty table gives an empty table; other columns are carried
along, `runs` and `collapsed` among them replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from allelarium.llm.common import mix64, read_table, shingle_hashes, text_slices

MIN_EXPONENT, MIN_WORDS = 4, 6
RUNS = ArrayType(StructType([StructField(name, LongType()) for name in ("start", "length", "period")]))
#: Items of one list of an ordered set.
CHUNK = 1024


class Ends:
    """An ordered set of end positions, in lists of bounded length."""

    __slots__ = ("lists", "first", "size")

    def __init__(self, end: int):
        self.lists, self.first, self.size = [[end]], [end], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for x in self.lists:
            yield from x

    def add(self, end: int) -> tuple[int, int]:
        """Put an end in; its neighbours, -1 where there is none."""
        k = max(0, bisect_right(self.first, end) - 1)
        here = self.lists[k]
        at = bisect_left(here, end)
        before = here[at - 1] if at else -1
        after = here[at] if at < len(here) else self.first[k + 1] if k + 1 < len(self.first) else -1
        here.insert(at, end)
        self.first[k] = here[0]
        self.size += 1
        if len(here) > CHUNK:
            half = len(here) // 2
            self.lists.insert(k + 1, here[half:])
            self.first.insert(k + 1, here[half])
            del here[half:]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link, length and end (-1 for a clone) of the states of the suffix automaton; state 0 is the root."""
    follow, link, length, end, last = [{}], [-1], [0], [-1], 0
    for i, w in enumerate(words):
        state = len(follow)
        follow.append({})
        link.append(0)
        length.append(i + 1)
        end.append(i)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = state
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            if length[q] != length[p] + 1:
                clone = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(-1)
                link[q] = clone
                while p >= 0 and follow[p].get(w) == q:
                    follow[p][w] = clone
                    p = link[p]
                q = clone
            link[state] = q
        last = state
    return link, length, end


def _equal_stretch(a: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The longest range lo:hi around i in which a[k] == a[k + d], given that this holds at i."""
    last, lo, hi, step = len(a) - d, i, i + 1, 64
    while hi < last:
        stop = min(last, hi + step)
        other = np.flatnonzero(a[hi:stop] != a[hi + d : stop + d])
        hi, step = (hi + int(other[0]) if len(other) else stop), 2 * step
        if len(other):
            break
    step = 64
    while lo > 0:
        stop = max(0, lo - step)
        other = np.flatnonzero(a[stop:lo] != a[stop + d : lo + d])
        lo, step = (stop + int(other[-1]) + 1 if len(other) else stop), 2 * step
        if len(other):
            break
    return lo, hi


def _primitive(root: np.ndarray) -> bool:
    """No shorter stretch repeated makes this one."""
    n, left, r = len(root), len(root), 2
    while left > 1:
        if r * r > left:
            r = left
        if left % r == 0:
            if np.array_equal(root[: n - n // r], root[n // r :]):
                return False
            while left % r == 0:
                left //= r
        r += 1
    return True


def _runs_of_piece(piece: np.ndarray, min_exponent: int, min_words: int) -> Iterator[tuple[int, int, int]]:
    link, length, end = automaton(piece.tolist())
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    seen: dict[int, list[tuple[int, int]]] = {}  # for a distance, the stretches of equal words found so far, in order
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        up = link[state]
        if up <= 0:
            continue
        small, large, reach = sets[state], sets[up], length[up]
        sets[state] = None
        if large is None:
            sets[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        sets[up] = large
        for e in small:
            before, after = large.add(e)
            for left, right in ((before, e), (e, after)):
                d = right - left
                if left < 0 or right < 0 or d > reach:
                    continue
                found = seen.setdefault(d, [])
                k = bisect_right(found, (left, len(piece)))
                if k and left < found[k - 1][1]:
                    continue
                lo, hi = _equal_stretch(piece, left, d)
                insort(found, (lo, hi))
                if hi - lo + d >= max(min_words, min_exponent * d) and _primitive(piece[lo : lo + d]):
                    yield lo, hi - lo + d, d


def pieces(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Ranges of words outside which no gram recurs in its range."""
    todo, out = [(0, len(ids))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= gram:
            continue
        grams = shingle_hashes(ids[lo:hi], gram)
        _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], count[which] > 1, [False])).astype(np.int8)))
        ranges = [(lo + int(a), lo + int(b) - 1 + gram) for a, b in edges.reshape(-1, 2)]
        (out if ranges == [(lo, hi)] else todo).extend(ranges)
    return out


def runs_of(words: list[bytes], *, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; min_exponent is 2 or more."""
    least = max(min_words, min_exponent)
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # a gram recurs one period on as long as a run has two periods of its starts
    gram = max(1, min(max(min_words, min_exponent * q) - 2 * q + 1 for q in range(1, least + 1)))
    return sorted(((lo + start, n, q) for lo, hi in pieces(mix64(ids.astype(np.uint64) + np.uint64(1)), gram) for start, n, q in _runs_of_piece(ids[lo:hi], min_exponent, min_words)), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single spaces, without what follows the first period of a run."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, n, q in runs:
        keep[start + q : start + n] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep))


def find_periodic_runs(docs: DataFrame, *, text: str = "text", min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The other columns of each row, `runs` (start, length, period; by start, then period) and `collapsed`, the words without repeats."""
    others = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    rows, at = docs.select(*others, text), len(others)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at):
                found, kept = [], []
                for content in part.column(at).cast(pa.large_binary()).to_pylist():
                    words = (content or b"").split()  # of bytes: at the six ASCII blanks alone
                    runs = runs_of(words, min_exponent=min_exponent, min_words=min_words)
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    kept.append(collapse(words, runs))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(found, kind), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], [*others, "runs", "collapsed"])

    schema = rows.drop(text).schema.add("runs", RUNS).add("collapsed", "string")
    return rows.mapInArrow(run, schema)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text; of each tenth id, by crc32, one whose words repeat from a place on with a period, both derived from that hash."""
    # each step takes the one before as the item of a list, so that it is computed once
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.slice(words, a + 1, p)
        again = F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), let(words, planted)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_periodic_runs(docs)
    # a run is first if length / period is greater; products, so that it is exact
    longer = lambda a, b: (a["length"] * b["period"]) > (b["length"] * a["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda s, r: F.when(longer(r, s), r).otherwise(s))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL = {
    "op12_periodic_runs": r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT FOR x IN range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
coded AS (
  SELECT doc_id, text, row_number() OVER () AS k,
    xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]))) AS h
  FROM documents, crc_table),
split AS (
  SELECT k, doc_id, coalesce(h % 10, 1) = 0 AS planted, CAST(h // 10 AS BIGINT) AS g,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM coded),
placed AS (
  SELECT k, doc_id, len(words) AS n, planted AND len(words) > 0 AS planted, words, g,
    CASE WHEN len(words) > 0 THEN g % len(words) END AS a FROM split),
periods AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM placed),
each AS (
  SELECT k, i, CASE WHEN planted AND i >= a THEN words[a + (i - a) % p + 1] ELSE words[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM periods)),
numbered AS (SELECT k, i, w, hash(w) AS x FROM each),
grams AS (
  SELECT k, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o] AS four, lead(x, 3) OVER o IS NOT NULL AS whole
  FROM numbered WINDOW o AS (PARTITION BY k ORDER BY i)),
repeated AS (SELECT k, i, hash(four) AS four, max(i) OVER (PARTITION BY k) + 4 AS n FROM grams WHERE whole),
matches AS (SELECT a.k, a.i, b.i - a.i AS q FROM repeated a JOIN repeated b ON a.k = b.k AND a.four = b.four AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM matches),
stretches AS (SELECT k, q, min(i) AS start, count(*) + 3 + q AS length FROM islands GROUP BY k, q, island),
runs AS (SELECT k, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length),
dropped AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT e.k, string_agg(e.w, ' ' ORDER BY e.i) AS collapsed FROM each e ANTI JOIN dropped d ON e.k = d.k AND e.i = d.i GROUP BY e.k),
listed AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY k),
best AS (SELECT k, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length::DOUBLE / period DESC, start, period) = 1)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM split s LEFT JOIN listed USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""
}
