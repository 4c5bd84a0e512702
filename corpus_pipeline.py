"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

Every stage works on all that its predecessor kept; all but the last return the
columns of `documents`.

Edge cases: null and empty texts and those without words fail the base rules of
the first stage and go; a null id, language or source stays as it is; rows with
one id (or none) and one text are one document, of which a single row stays;
texts may be of any length; an empty table gives an empty table; extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import Scratch, read_table
from allelarium.llm.decontaminate import WINDOW, drop_leaks
from allelarium.llm.line_dedup import drop_repeated_lines
from allelarium.llm.ngram_jaccard import keep_representatives
from allelarium.llm.quality_rules import fit_forest, keep_good_documents
from allelarium.llm.sentencepiece_codec import encode_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the isolation forest rejects go."""
    return keep_good_documents(docs, fit_forest(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go from the texts; a document of which nothing is left goes too."""
    left = drop_repeated_lines(docs.select(*COLUMNS))
    left = left.where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, by five-word shingles with Jaccard 0.8 or more, the one with the least doc_id stays."""
    return keep_representatives(docs.select(*COLUMNS), n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"), window=WINDOW)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return encode_decode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express the isolation forest or the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
