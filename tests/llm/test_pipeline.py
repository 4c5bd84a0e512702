"""The pipeline's stages on a small corpus, each against what it must keep."""

import importlib.util
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("no pipeline", allow_module_level=True)

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        assert (set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}) == (k < len(pipeline.STAGES) - 1), name
    counts = [d.count() for d in kept]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 100
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    bad = whole.join(labels.where("quality = 0"), "doc_id").select("doc_id")
    assert kept[0].join(bad, "doc_id").count() <= 0.1 * bad.count()
    good = whole.where("n_chars > 300").join(labels.where("quality = 1"), "doc_id").select("doc_id")
    assert kept[0].join(good, "doc_id").count() >= 0.95 * good.count()
    assert kept[1].where(F.length("text") != F.col("n_chars")).count() == 0
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r["doc_id"] for r in kept[3].collect() if any(b in r["text"] for b in benchmark)]


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(10_000)}" for _ in range(100)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:  # one, two and three separate changes: 0.90, 0.81 and 0.73 of the five-word shingles
        for places in ((50,), (30, 70), (20, 50, 80)):
            texts.append(" ".join(f"changed{len(places)}" if k in places else w for k, w in enumerate(b)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, c in enumerate(comp) if i == c} and len(kept) == 12


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and an extra column; then no rows at all."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))
    rows = [(k, words(60), "en", "s") for k in range(20)]
    long, twice, nameless = (30, words(50_000), "en", "s"), (31, words(60), "en", "s"), (None, words(60), None, None)
    rows += [long, twice, twice, nameless, (32, None, "en", "s"), (33, "", None, "s"), (34, " \n\t\n", "en", None), (35, rows[0][1], "en", "s")]
    docs = spark.createDataFrame([(i, t, a, b, None if t is None else len(t), 1) for i, t, a, b in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    left = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, left, SF).write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        # texts without words fail the base rules; the copy of document 0 and the second of the equal rows go as near duplicates at the latest
        if k == 0:
            assert not {r["doc_id"] for r in left.collect()} & {32, 33, 34}, name
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids, key=lambda i: -1 if i is None else i) == [None, *range(20), 30, 31]
    none = docs.where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
