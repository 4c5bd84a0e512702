"""Vector code compression: integer codebooks for the parts of vectors, trained and applied exactly.

A component x counts as the integer floor(scale * x), a vector is cut into
equal consecutive parts, and each part is stored as the index of the nearest
entry of its position's codebook. The codebooks start as the parts of the
vectors with the least ids; a round assigns every part to the nearest entry
(ties to the lower index) and replaces each entry by the floor of its parts'
mean.

A round is one scan: the codebooks, whose size is that of a fixed number of
entries, go to the tasks with the closure; a task computes all distances of an
Arrow batch at once from |x|^2 - 2 x.c + |c|^2 with int64 matrix products, so
they are exact, adds its parts up for each entry, and the sums of the tasks are
merged by a grouped shuffle. What comes to the driver is a sum for each
component of an entry. Nothing is drawn at random and every sum is one of
integers, so a lost task repeats with the same result.

Edge cases: a null vector, and one with a null or non-finite component, is
dropped. Vectors of another length than the first one's, and all of a length
that the parts do not divide, take no part in training and get a null code and
error. Repeated ids are rows of their own, ordered by their vectors; a null id
comes last. With fewer vectors than entries the codebooks are as short. Empty
vectors have empty parts at distance 0. Components are held to 2^25 after
scaling, within which int64 sums cannot overflow for parts of up to 4,096
components; a larger one is an error. An empty table gives no codebooks and no
rows. Other columns are carried along; `code` and `error` among them are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import Scratch, left_join_groups, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 25
#: Cells of the arrays that a task holds at a time.
CELLS = 1 << 21


def usable(vector: str) -> Column:
    """The vector is not null and all of its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def to_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"a component is over {LARGEST} after scaling")
    return scaled.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the entries, in int64."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def _blocks(batches: Iterator[pa.RecordBatch], at: int, width: int, books: list[np.ndarray], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, which of their rows have a vector of the trained length, and the integers of those."""
    rows = max(1, CELLS // max(1, width, len(books[0])))
    for batch in batches:
        for lo in range(0, len(batch), rows):
            part = batch.slice(lo, rows)
            column = part.column(at)
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
            values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
            yield part, fits, to_integers(values.reshape(int(fits.sum()), width), scale)


def _initial(kept: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The codebooks of the first `entries` vectors by id; none where no vector can be cut into the parts."""
    order = (F.col(key).asc_nulls_last(), F.col(vector).asc())
    cut = kept.where(F.size(vector) % parts == 0).select(key, vector)
    first = cut.orderBy(*order).limit(entries).collect()
    if not first:
        return []
    width = len(first[0][1])
    if any(len(r[1]) != width for r in first):
        first = cut.where(F.size(vector) == width).orderBy(*order).limit(entries).collect()
    whole = to_integers(np.array([r[1] for r in first], np.float64).reshape(len(first), width), scale)
    return np.split(whole, parts, axis=1)


def train_codebooks(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """A codebook (entries x components, int64) for each part position; at most 256 entries, as a code has two hex digits for each."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = vectors.where(usable(vector)).select(key, vector)
    books = _initial(kept, key, vector, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = _round(kept.select(vector), books, scale)
    return books


def _round(kept: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    parts, (size, each) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, each), np.int64), np.zeros((parts, size), np.int64)
        for _, _, x in _blocks(batches, 0, parts * each, books, scale):
            for p, book in enumerate(books):
                here = x[:, p * each : (p + 1) * each]
                entry = distances(here, book).argmin(1)
                np.add.at(sums[p], entry, here)
                counts[p] += np.bincount(entry, minlength=size)
        p, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[p, entry]), pa.array(list(sums[p, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    merged = kept.mapInArrow(run, "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode("sums").alias("pos", "v"))
    found = merged.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # a row for each component of an entry
    new = np.stack(books)
    new[found["part"], found["entry"], found["pos"]] = found["v"].to_numpy() // found["n"].to_numpy()
    return list(new)


def encode_vectors(vectors: DataFrame, books: list[np.ndarray], *, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The other columns of each usable vector, its `code` (two hex digits a part, in order) and `error` (squared distances, summed)."""
    others = [c for c in vectors.columns if c not in (vector, "code", "error")]
    kept = vectors.where(usable(vector)).select(*others, vector)
    if not books:
        return kept.select(*others, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    each, at = books[0].shape[1], len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, fits, x in _blocks(batches, at, each * len(books), books, scale):
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                d = distances(x[:, p * each : (p + 1) * each], book)
                best = d.argmin(1)
                codes[:, p], error = best, error + d[np.arange(len(d)), best]
            step = 2 * len(books)
            digits = codes.tobytes().hex()
            code, of_row = np.full(len(part), None, object), np.zeros(len(part), np.int64)
            code[fits], of_row[fits] = [digits[k : k + step] for k in range(0, len(digits), step)], error
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(code, pa.string()), pa.array(of_row, mask=~fits)], [*others, "code", "error"])

    schema = kept.drop(vector).schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, schema)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of `embeddings`."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train_codebooks(rows)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()
    # labels of text, so that nulls meet; written, as it is read twice
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = Scratch(spark, "vector-codes").write(encode_vectors(rows, books).select("vec_id", "code", "error", label.alias("label")), "coded")
    totals = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    joined = left_join_groups(coded, totals, "label", coded.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled; integers as doubles, which hold them and their products exactly."""
    distance = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"
    parts = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS (SELECT r, part, list_slice(x, (part * len(x)) // 4 + 1, ((part + 1) * len(x)) // 4) AS x FROM kept, (SELECT unnest(range(4)) AS part))",
        "c0 AS (SELECT part, r AS entry, x FROM v WHERE r < 256)",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, v.part, arg_min(c.entry, ({distance}) * 256 + c.entry) AS entry, min({distance}) AS d FROM v JOIN c{k} c ON v.part = c.part GROUP BY r, v.part)")
        if k < ROUNDS:
            sums = f"SELECT part, entry, pos, floor(sum(y) / count(*)) AS y FROM (SELECT a.part, a.entry, generate_subscripts(v.x, 1) AS pos, unnest(v.x) AS y FROM a{k} a JOIN v ON a.r = v.r AND a.part = v.part) GROUP BY ALL"
            parts.append(f"m{k} AS (SELECT part, entry, list(y ORDER BY pos) AS x FROM ({sums}) GROUP BY ALL)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)")
    parts.append(f"coded AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    parts.append(f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})")
    body = "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (r), digest"
    return "WITH " + ",\n".join(parts) + "\n" + body


QUERIES = {"op13_vector_codes": op13_vector_codes}
SQL = {"op13_vector_codes": _sql()}
