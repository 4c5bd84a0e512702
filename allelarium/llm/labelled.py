"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, keep=None) -> DataFrame:
    """At most `rows` documents with a label 0 or 1, as (doc_id, text, label), chosen by a hash of their id.

    Only ids are sorted, and at most `rows` of them are sent to the executors,
    so the sample costs one scan of the texts at any scale. `keep` is a
    predicate on doc_id. Null ids and labels other than 0 and 1 are passed
    over; where an id has several labels the least counts; of several documents
    with one id the least text is taken. The sample's texts are shuffled by id,
    so they come in as many tasks as the cluster gives, not in one.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if keep is not None:
        ids = ids.where(keep)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
