"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is a sequence of line ids (numbers of the distinct lines, by 128 bits
of hash, of its lines that have a word). Suffixes are ranked by their first 1, 2, 4, ... lines: rank 2k of a
suffix is the rank of the pair (rank k here, rank k of the suffix k lines on),
found by a range-partitioned sort of the distinct pairs. A suffix whose rank is
unique drops out, so only repeated text takes part in a round, and doubling ends
when no rank is shared.

All suffixes that share their first d lines are an interval of the suffix array
whose longest common prefix is d or more. It is named by the earliest of them
and d. From the longest ranks down to single lines, each suffix moves to the
interval that is deeper by 2^k lines where that still holds an earlier suffix:
so each line gets the longest run that starts there and has an equal run
earlier, in the order of (doc_id, line). Runs may overlap and lie in one
document. Runs of at least `min_chars` characters are deleted.

Everything is DataFrame code, with one plan at any size: only numbers and
hashes are shuffled in the rounds, texts once at the end, and the tables of a
round are dropped after it. Counts are aggregated before the shuffle, and a
line or run that is more frequent than a bounded list can hold is joined from
that list by broadcast, so no task gets all its copies. A place is one long: the
number of the document among those with repeated lines (at most 2^36) and the
number of the line among those with a word (at most 2^27; beyond is an error).

Edge cases: a null text has no lines and stays null; an empty text has one
blank line; blank lines belong to no run and are kept; a text whose lines all
go becomes empty; rows with equal doc_id and text are one document and get the
same result; a null doc_id comes first in the order; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelarium.llm.common import FREQUENT_KEYS, Scratch, left_join_groups, read_table

MIN_CHARS = 50
#: Bits of a place that number the line in its document.
LINE_BITS = 27
_WORD = r"[^\x20\x09-\x0D]"
_DOC = ("doc_id", "digest")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & a[name].eqNullSafe(b[name])
    return on


def _with_group(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """Rows joined to the groups of two or more that they belong to; groups: key, n, more.

    Keys with over total / FREQUENT_KEYS rows are at most FREQUENT_KEYS: those
    are broadcast, and only the others are shuffled.
    """
    most = max(1_000, total // FREQUENT_KEYS)
    hot = groups.where(F.col("n") > most)
    cold = groups.where((F.col("n") > 1) & (F.col("n") <= most))
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, seq, pos, line, line_2, chars): the lines with a word, numbered among these and, from 0, among all of their document."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("content")))
    worded = F.filter(numbered, lambda x: x["content"].rlike(_WORD))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.posexplode(worded).alias("seq", "at"))
    ids = F.xxhash64("at.content").alias("line"), F.xxhash64(F.lit(1), "at.content").alias("line_2")
    return each.select(*_DOC, F.col("seq").cast("long").alias("seq"), "at.pos", *ids, F.length("at.content").cast("long").alias("chars"))


def _numbered(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows numbered (`rank`) in the order of their key, over a range-partitioned sort without a single-task window."""
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = scratch.write(ordered.select(*rows.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), name)
    parts = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"))


def _least_length(min_chars: int) -> Column:
    """Lines that a run from here takes to reach min_chars; null where a line that occurs once comes sooner."""
    near = Window.partitionBy("doc").orderBy("at").rangeBetween(0, min_chars - 1)
    ahead = F.collect_list(F.struct("at", "chars")).over(near)
    # state: lines so far, characters so far; a gap in the numbers ends the run for good
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("open"))
    done = F.aggregate(
        ahead,
        start,
        lambda s, x: F.when(~s["open"] | (s["c"] >= min_chars), s).otherwise(
            F.when(x["at"] == F.col("at") + s["n"], F.struct((s["n"] + 1).alias("n"), (s["c"] + x["chars"]).alias("c"), F.lit(True).alias("open"))).otherwise(
                F.struct(s["n"].alias("n"), s["c"].alias("c"), F.lit(False).alias("open"))
            )
        ),
    )
    return F.when(done["c"] >= min_chars, done["n"])


def _repeated_lines(docs: DataFrame, min_chars: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc, at, pos, rank, least): the lines that occur more than once; (doc_id, digest, rank): the numbers of their documents."""
    lines = scratch.write(_lines(docs), "lines")
    key = ["line", "line_2"]
    ids = _numbered(lines.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key, scratch, "ids")
    found = _with_group(lines, ids, key, lines.count()).select(*_DOC, "seq", "pos", "chars", "rank").dropDuplicates([*_DOC, "seq"])
    found = scratch.write(found, "found")
    numbers = scratch.write(_numbered(found.select(*_DOC).distinct(), list(_DOC), scratch, "documents"), "numbers")
    seq = F.when(F.col("seq") < 1 << LINE_BITS, F.col("seq")).otherwise(F.raise_error(F.lit(f"a document has over 2^{LINE_BITS} lines")).cast("long"))
    doc = numbers["rank"]
    placed = found.join(numbers.hint("merge"), _same(found, numbers, *_DOC)).select(doc.alias("doc"), (F.shiftleft(doc, LINE_BITS) + seq).alias("at"), "pos", "chars", found["rank"])
    active = scratch.write(placed.select("doc", "at", "pos", "rank", _least_length(min_chars).alias("least")), "active")
    scratch.drop("lines", "ids", "found", "documents")
    return active, numbers


def _levels(active: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(at, least, rank, first) for 1, 2, 4, ... lines: the suffixes that share so many with another one, and the earliest that does."""
    names = active.groupBy("rank").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    level = scratch.write(_with_group(active, names, ["rank"], active.count()).select("at", "least", "rank", "first"), "level-0")
    levels, key = [level], ["rank_1", "rank_2"]
    while True:
        width = 1 << (len(levels) - 1)
        beside = Window.partitionBy(F.shiftright("at", LINE_BITS)).orderBy("at").rangeBetween(width, width)
        pairs = level.select("at", "least", F.col("rank").alias("rank_1"), F.first("rank").over(beside).alias("rank_2"))
        pairs = scratch.write(pairs.where("rank_2 is not null"), f"pairs-{width}")
        ranks = _numbered(pairs.groupBy(*key).agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1"), key, scratch, f"ranks-{width}")
        more = bool(ranks.take(1))
        if more:
            level = scratch.write(_with_group(pairs, ranks, key, pairs.count()).select("at", "least", "rank", "first"), f"level-{len(levels)}")
            levels.append(level)
        scratch.drop(f"pairs-{width}", f"ranks-{width}")
        if not more:
            return levels


def _longest_runs(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(at, least, length, first): for each suffix that starts a long enough run and shares lines with an earlier one, how many, and the earliest that shares them."""
    reach, key = None, ["first", "length", "rank"]
    for k in reversed(range(len(levels))):
        step = 1 << k
        now = levels[k].where("at <> first and least is not null")
        if k + 1 < len(levels):  # the others entered at a longer rank
            now = now.join(levels[k + 1].where("at <> first").select("at").hint("merge"), "at", "left_anti")
        now = now.select("at", "least", F.lit(step).cast("long").alias("length"), "first")
        if reach is not None:
            # each interval's earliest suffix asks too, so that the others see it
            earliest = reach.select(F.col("first").alias("at"), F.lit(None).cast("long").alias("least"), "length", "first").distinct()
            asked = reach.unionByName(earliest).withColumn("next", F.col("at") + F.col("length"))
            asked = asked.join(levels[k].select(F.col("at").alias("next"), "rank").hint("merge"), "next", "left").drop("next")
            asked = scratch.write(asked, f"asked-{k}")
            some = asked.where("rank is not null")
            groups = some.groupBy(*key).agg(F.count("*").alias("n"), F.min("at").alias("to")).where("n > 1")
            met = left_join_groups(some, groups, key, asked.count()).where("least is not null")
            moves = F.coalesce(F.col("to") < F.col("at"), F.lit(False))
            met = met.select("at", "least", F.when(moves, F.col("length") + step).otherwise(F.col("length")).alias("length"), F.when(moves, F.col("to")).otherwise(F.col("first")).alias("first"))
            now = now.unionByName(met).unionByName(asked.where("rank is null and least is not null").drop("rank"))
        reach = scratch.write(now, f"reach-{k}")
        scratch.drop(f"asked-{k}", f"reach-{k + 1}", f"level-{k + 1}")
    return reach


def repeated_runs(docs: DataFrame, *, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(at, length): for each line the longest run from it that has an equal run earlier, where that has min_chars; the repeated lines; the numbers of their documents."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    active, numbers = _repeated_lines(docs, min_chars, scratch)
    runs = _longest_runs(_levels(active, scratch), scratch).where("length >= least")
    return runs.select("at", "length"), active, numbers


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs with `text` as it is after deletion, and n_lines and n_removed."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    runs, active, numbers = repeated_runs(docs, min_chars=min_chars, scratch=scratch)
    # a line goes where a run that starts at it or before reaches beyond it
    ends = active.select("doc", "at", "pos").join(runs.hint("merge"), "at", "left")
    so_far = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = ends.select("doc", "at", "pos", F.max(F.col("at") + F.col("length")).over(so_far).alias("end")).where("end > at")
    gone = gone.groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    # written, so that what a lambda below reads is a stored column and not computed anew for each line
    gone = scratch.write(numbers.join(gone.hint("merge"), numbers["rank"] == gone["doc"]).select(*_DOC, "gone"), "gone")
    gaps = F.transform("gone", lambda p, k: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1), F.lit("1")))
    marks = scratch.write(gone.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.size("gone").cast("long").alias("_n"), F.split(F.array_join(gaps, ""), "").alias("_marks")), "marks")
    scratch.drop("active", "numbers", "level-0", "reach-0", "gone")
    # the one shuffle of texts, at any size
    joined = docs.join(marks.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(marks["_doc"]) & (F.xxhash64(docs["text"]) == marks["_digest"]), "left")
    lines = F.split(docs["text"], "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get("_marks", i), F.lit("0")) != "1"), "\n")
    return joined.select(
        *(docs[c] if c != "text" else F.when(F.col("_n").isNull(), docs["text"]).otherwise(kept).alias("text") for c in docs.columns),
        F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the text without later copies of runs of lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {
    "op7_line_dedup": rf"""
WITH split AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
each AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
worded AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM each WHERE regexp_matches(line, '{_WORD}')),
matches AS (
  SELECT a.doc_id, a.seq, b.doc_id AS other, a.seq - b.seq AS shift, length(a.line) AS chars
  FROM worded a JOIN worded b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))),
islands AS (
  SELECT *, seq - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY seq) AS island FROM matches),
runs AS (
  SELECT doc_id, min(seq) AS lo, max(seq) AS hi FROM islands
  GROUP BY doc_id, other, shift, island HAVING sum(chars) >= {MIN_CHARS}),
gone AS (
  SELECT DISTINCT w.doc_id, w.pos FROM runs r JOIN worded w ON w.doc_id = r.doc_id AND w.seq BETWEEN r.lo AND r.hi),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.lines) AS BIGINT) AS n_lines, coalesce(l.n, 0) AS n_removed,
       CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id LEFT JOIN lost l ON l.doc_id = s.doc_id
"""
}
