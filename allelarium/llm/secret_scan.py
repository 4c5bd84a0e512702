r"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

Base spans are the leftmost matches, not overlapping within a kind, of three
patterns (`BASE`), of which those too short are dropped. Labelled samples come
from the corpus itself: what the patterns `RANDOM` match are random strings,
stretches of letters and underscores are ordinary identifiers; each counts once
in a document, in pieces of at most 64 characters. One scan counts the pairs of
neighbouring characters of both classes. From the counts come two first-order
Markov models over `ALPHABET` with one added to every count - that of random
strings averaged with even odds, as the samples may show few of its characters
- and a table of log-likelihood ratios in whole thousandths, so that sums are
exact in any order. The threshold, for the mean of a string's steps, is the
middle of the two classes' own means.

A second scan scores every stretch of `CANDIDATE`, whole, unless it has no
letter or is covered by a base pattern; those over the threshold are added as
kind `markov`. Places are counted in code points, end exclusive. Everything is
DataFrame functions on a row by itself: the one shuffle is that of the counts,
at most two rows for each pair of characters and task.

Edge cases: null and empty texts have no spans; without samples of one of the
classes nothing is added; repeated rows are rows of their own; a null id stays;
an empty table gives an empty table; other columns are carried along, `spans`
among them replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import read_table

#: kind -> pattern, group whose length counts, least length; in the order that settles equal starts.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
KINDS = (*BASE, "markov")
RANDOM = r"[0-9a-f]{24,64}|AKIA[A-Z0-9]{16,60}"
ORDINARY = r"[A-Za-z_]{8,64}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = 66
#: A base pattern inside a candidate, and an assignment that is long enough.
_COVERED = r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}|^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Numbers of one list that are added up one by one.
BLOCK = 256


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of the numbers up to each place: within blocks, then over the blocks, so that a list of any length grows by short steps."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))

    def sums(block: Column) -> Column:
        return F.aggregate(block, none, lambda s, x: F.concat(s, F.array(last(s) + x)))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda s, b: F.concat(s, F.array(last(s) + last(b))))
        return _let(before, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.get(at, i)))))

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"))
        return _let(F.transform(starts, lambda i: sums(F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))), joined)

    return _let(numbers, lambda n: F.when(F.size(n) > 0, cut(n)).otherwise(none))


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """(start, end, value) of the leftmost matches, not overlapping, of a pattern with groups; `value` is a group of it."""
    # \G: each match starts where the last one ended, so a text is gone through once
    gapped = rf"\G([\s\S]*?)({pattern})"
    part = lambda g: F.regexp_extract_all(text, F.lit(gapped), F.lit(g))
    found = F.arrays_zip(F.transform(part(0), lambda x: F.length(x).cast("bigint")).alias("step"), F.transform(part(2), lambda x: F.length(x).cast("bigint")).alias("length"), part(2 + group).alias("value"))

    def placed(m: Column) -> Column:
        ends = running_sums(F.transform(m, lambda x: x["step"]))
        return _let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - x["length"]).alias("start"), F.get(e, i).alias("end"), x["value"].alias("value"))))

    return F.when(text.rlike(pattern), _let(found, placed))


def _span(kind: str, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))


def _spans_of(kind: str, text: Column) -> Column:
    pattern, group, least = BASE[kind]
    if kind != "assign":  # a match is a whole stretch, or its end: only one that is long enough can be found
        pattern = pattern.replace("+", f"{{{least - (4 if kind == 'access' else 0)},}}")
    return F.transform(F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least), lambda m: _span(kind, m))


@dataclass(frozen=True)
class MarkovRatio:
    """steps[128 * a + b]: thousandths of log P(b | a, random) - log P(b | a, ordinary); `threshold` for their mean, None without samples."""

    steps: tuple[int, ...]
    threshold: int | None


def sample_pairs(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(random, pair, n): how often each pair of characters occurs in the labelled samples of each class."""
    sample = lambda pattern, label: F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))), lambda s: F.struct(s.alias("s"), F.lit(label).alias("random")))
    each = docs.select(F.explode(F.concat(sample(RANDOM, True), sample(ORDINARY, False))).alias("at"))
    pairs = each.select("at.random", F.explode(F.transform(F.sequence(F.lit(1), F.length("at.s") - 1), lambda i: F.substr("at.s", i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("random", "pair").agg(F.count("*").alias("n"))


def fit_ratio(docs: DataFrame, *, text: str = "text") -> MarkovRatio:
    counts: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in sample_pairs(docs, text=text).collect():  # at most a row for each class and pair of the 63 characters
        counts[r["random"]][tuple(map(ord, r["pair"]))] = r["n"]
    after = {c: {} for c in counts}
    for c, pairs in counts.items():
        for (a, _), n in pairs.items():
            after[c][a] = after[c].get(a, 0) + n
    steps = [0] * (128 * 128)
    for a in range(128):
        for b in range(128):
            p = {c: (counts[c].get((a, b), 0) + 1) / (after[c].get(a, 0) + ALPHABET) for c in counts}
            steps[128 * a + b] = math.floor(1000 * (math.log((p[True] + 1 / ALPHABET) / 2) - math.log(p[False])) + 0.5)
    if not all(counts.values()):
        return MarkovRatio(tuple(steps), None)
    mean = {c: sum(n * steps[128 * a + b] for (a, b), n in pairs.items()) / sum(pairs.values()) for c, pairs in counts.items()}
    return MarkovRatio(tuple(steps), math.floor((mean[True] + mean[False]) / 2))


def log_ratio(value: Column, ratio: MarkovRatio) -> Column:
    """Sum of a string's steps."""
    table = F.split(F.lit(",".join(map(str, ratio.steps))), ",").cast("array<int>")  # folded to one literal
    state = lambda prev, total: F.struct(prev.alias("prev"), total.alias("total"))
    return F.aggregate(
        F.split(value, ""),
        state(F.lit(-1), F.lit(0).cast("bigint")),
        lambda s, c: state(F.ascii(c), F.when(s["prev"] < 0, s["total"]).otherwise(s["total"] + F.get(table, s["prev"] * 128 + F.ascii(c)))),
        lambda s: s["total"],
    )


def scan_secrets(docs: DataFrame, ratio: MarkovRatio, *, text: str = "text") -> DataFrame:
    """The other columns of each row and `spans` (start, kind as a place in KINDS, end), by start, then kind."""
    others = [c for c in docs.columns if c not in (text, "spans")]
    content = F.col(text)
    found = [_spans_of(kind, content) for kind in BASE]
    if ratio.threshold is not None:
        # an assignment is taken whole, so its value is no candidate of its own
        assign = BASE["assign"][0]
        unknown = F.filter(
            matches(content, f"(?:{assign}|({CANDIDATE}))", 3),
            lambda m: (F.length(m["value"]) > 0) & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(_COVERED) & (log_ratio(m["value"], ratio) > ratio.threshold * (F.length(m["value"]) - 1)),
        )
        found.append(F.when(content.rlike(CANDIDATE), F.transform(unknown, lambda m: _span("markov", m))))
    spans = F.array_sort(F.concat(*(F.coalesce(f, F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")) for f in found)))
    return docs.select(*others, spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit_ratio(docs))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    def matched(name: str, pattern: str, group: int, keep: str, kind: str) -> str:
        whole = f"(?s)(.*?)({pattern})".replace("'", "''")
        part = lambda g: f"regexp_extract_all(text, '{whole}', {g})"
        each = f"SELECT k, unnest({part(0)}) AS whole, unnest({part(2)}) AS hit, unnest({part(2 + group)}) AS v, unnest(range(len({part(0)}))) AS i FROM docs"
        ends = f"SELECT k, hit, v, sum(length(whole)) OVER (PARTITION BY k ORDER BY i) AS e FROM ({each})"
        return f"{name} AS (SELECT k, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, {kind} AS kind, v FROM ({ends}) WHERE {keep})"

    sample = lambda pattern, label: f"SELECT unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS s, {label} AS random FROM docs"
    parts = ["docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents)"]
    parts += [matched(kind, pattern, group, f"length(v) >= {least}", str(k)) for k, (kind, (pattern, group, least)) in enumerate(BASE.items())]
    parts += [
        f"samples AS MATERIALIZED (SELECT s, random FROM ({sample(RANDOM, 'true')} UNION ALL {sample(ORDINARY, 'false')}))",
        "pairs AS MATERIALIZED (SELECT random, a, b, count(*) AS n FROM (SELECT random, ascii(s[i]) AS a, ascii(s[i + 1]) AS b FROM (SELECT random, s, unnest(range(1, length(s))) AS i FROM samples)) GROUP BY ALL)",
        "sums AS (SELECT random, a, sum(n) AS n FROM pairs GROUP BY ALL)",
        f"chars AS (SELECT unnest(range(128)) AS a), steps AS MATERIALIZED (SELECT c.a, d.a AS b, floor(1000 * (ln(((coalesce(pr.n, 0) + 1) / (coalesce(sr.n, 0) + {ALPHABET}) + 1 / {ALPHABET}) / 2) - ln((coalesce(po.n, 0) + 1) / (coalesce(so.n, 0) + {ALPHABET}))) + 0.5) AS step"
        " FROM chars c CROSS JOIN chars d LEFT JOIN pairs pr ON pr.random AND pr.a = c.a AND pr.b = d.a LEFT JOIN pairs po ON NOT po.random AND po.a = c.a AND po.b = d.a"
        " LEFT JOIN sums sr ON sr.random AND sr.a = c.a LEFT JOIN sums so ON NOT so.random AND so.a = c.a)",
        "limits AS (SELECT floor((sum(n * step) FILTER (random) / sum(n) FILTER (random) + sum(n * step) FILTER (NOT random) / sum(n) FILTER (NOT random)) / 2) AS least FROM pairs JOIN steps USING (a, b))",
        matched("unknown", f"(?:{BASE['assign'][0]}|({CANDIDATE}))", 3, "v <> '' AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{}')".format(_COVERED.replace("'", "''")), "3"),
        "scored AS (SELECT u.k, u.s, u.e, u.kind, u.v, sum(step) AS score FROM (SELECT *, unnest(range(1, length(v))) AS i FROM unknown) u JOIN steps ON a = ascii(u.v[i]) AND b = ascii(u.v[i + 1]) GROUP BY ALL)",
        "markov AS (SELECT k, s, e, kind, v FROM scored, limits WHERE score > least * (length(v) - 1))",
        "spans AS (" + " UNION ALL ".join(f"SELECT k, s, e, kind FROM {name}" for name in KINDS) + ")",
    ]
    text = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][kind + 1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind}" for k, kind in enumerate(BASE))
    parts.append(f"lists AS (SELECT k, {counts}, string_agg({text}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({text}, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY k)")
    out = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {out}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN lists USING (k)"


QUERIES = {"op11_secret_scan": op11_secret_scan}
SQL = {"op11_secret_scan": _sql()}
