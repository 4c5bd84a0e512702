"""The ten corpus operators against brute force, and on null, empty, repeated and clashing inputs."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelarium.llm import chat_format, decontaminate, line_dedup, ngram_jaccard, quality_classifier, quality_rules, sentencepiece_codec, sharding, text_stats, token_counts, toxicity
from allelarium.llm.common import MARKS, Words, left_join_groups, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "one", "two words", " lead", "trail ", "a  b", "tab\tx\x0bv", "É ß ▁ x", "x" * 5000, "nul\x00 byte", "no break em", "end\n"]


def docs_frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


def words(text):
    return WORD.findall((text or "").encode())


# op2


def test_codec_agrees_with_the_library():
    codec = sentencepiece_codec.ChunkCodec(sentencepiece_codec.model_bytes(), table_chunks=5)
    assert codec.chunked
    rng = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab é\n\t .▁") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for k in range(0, len(texts), 50):
        codec.learn(texts[k : k + 50])
        for t in texts[k : k + 50]:
            ids = codec.sp.encode(t)
            assert codec.encode(t) == (len(ids), ",".join(map(str, ids)), codec.sp.decode(ids))
    assert codec.encode(None) == codec.encode("") == (0, "", "")


def test_codec_bounds_its_table():
    """Texts without blanks, long ones among them, agree with the library and don't fill the table."""
    codec = sentencepiece_codec.ChunkCodec(sentencepiece_codec.model_bytes(), table_chars=20_000)
    counter = sentencepiece_codec.ChunkCodec(sentencepiece_codec.model_bytes(), decode=False)
    rng = random.Random(9)
    for _ in range(40):
        texts = ["".join(rng.choice("abcdefé中文字") for _ in range(rng.choice((3, 250, 256, 257, 3_000, 200_000 if rng.random() < 0.02 else 900)))) + rng.choice(("", " ", "  x", " \x01 y" * 3)) for _ in range(6)]
        codec.learn(texts)
        for t in texts:
            ids = codec.sp.encode(t)
            assert codec.encode(t) == (len(ids), ",".join(map(str, ids)), codec.sp.decode(ids))
            assert counter.encode(t) == (len(ids), ",".join(map(str, ids)), "")
        assert max(map(len, codec.ids)) <= 256 and codec.chars < 40_000
    assert not counter.odd


def test_encode_decode_rows(spark):
    docs = docs_frame(spark, ODD).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_decode(docs, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    sp = sentencepiece_codec.ChunkCodec(sentencepiece_codec.model_bytes()).sp
    for i, t in enumerate(ODD):
        ids = sp.encode(t or "")
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == sp.decode(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_decode(docs.limit(0)).count() == 0


# op3


def test_token_counts(spark):
    docs = docs_frame(spark, ODD * 2)
    lengths = sorted(r[0] for r in sentencepiece_codec.encode_decode(docs, ("n_tokens",)).select("n_tokens").collect())
    histogram = token_counts.length_histogram(docs)
    sums = token_counts.suffix_sums(histogram)
    for r in sums.collect():
        c = r["context_limit"]
        assert r["n_docs"] == lengths.count(c) and r["n_longer"] == sum(n > c for n in lengths)
        assert r["truncated_tokens"] == sum(min(n, c) for n in lengths) and r["total_tokens"] == sum(lengths)
        assert r["truncated_tokens"] + r["cut_tokens"] == sum(lengths)
        assert r["quantile"] == pytest.approx(sum(n <= c for n in lengths) / len(lengths))
    assert token_counts.quantiles(sums, [0.5]).first()["n_tokens"] == lengths[(len(lengths) - 1) // 2]
    other = {r["context_limit"]: r for r in token_counts.limits(histogram, [3, 10**6]).collect()}
    assert other[3]["truncated_tokens"] == sum(min(n, 3) for n in lengths) and other[10**6]["n_longer"] == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(docs.limit(0))).count() == 0


# words


def test_words_of_a_column():
    texts = ODD + ["Ab c", "ab", "C ab"]
    column = pa.array(["skip", *texts]).slice(1)
    found = Words(column)
    for i, t in enumerate(texts):
        assert [found.word(k).lower() for k in range(found.bounds[i], found.bounds[i + 1])] == [w.lower() for w in words(t)]
    assert found.of(len(texts) - 3)[0] == found.of(len(texts) - 2)[0] == found.of(len(texts) - 1)[1]
    assert len(Words(pa.array([], pa.string()))) == 0 and len(Words(pa.array([None], pa.string()), blank=MARKS).of(0)) == 0


# op9


def brute_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_counts_by_brute_force():
    rng = random.Random(2)
    texts = ODD + ["\n".join(" ".join(rng.choice(["a", "b", "cd", "#x", "é|"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    counts, ratios = text_stats.slice_stats(pa.array(texts))
    assert [tuple(map(int, c)) for c in counts] == [brute_counts(t) for t in texts]
    assert np.isfinite(ratios).all()


GOOD = ["The quiet river bends past fields where the old mill stood, and in spring people walk there slowly number %d with %d." % (i, i * 7) for i in range(60)]
BAD = ["buy*** now### %d$$$ cheap&&& deals%%%% for*** all### of$$$ you&&& here%%%% today*** only###" % i for i in range(40)]


def labelled(spark):
    docs = docs_frame(spark, GOOD + BAD + ODD)
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(100)] + [(None, 1, 1), (3, None, 5)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_symbol_shares_like_plain_python():
    texts = ["a# b\n\n c\td% e", None, "", " \n ", "#\n#\n", "\nx&&", "é<ü\n\nz", "plain words"]
    column = pa.array(texts)
    words = text_stats.Words(column, lower=False)
    got = text_stats.symbol_shares(words, text_stats.slice_stats(column, words)[0][:, 1])
    for i, t in enumerate(texts):
        w, symbols = re.findall(r"[^\x20\x09-\x0D]+", t or ""), re.compile(r"[#*$%&|<>]")
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        assert got[i].tolist() == [len(symbols.findall(t or "")) / max(1, sum(map(len, w))), sum(bool(symbols.search(x)) for x in w) / max(1, len(w)), sum(bool(symbols.search(x)) for x in lines) / max(1, len(lines))]


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs.withColumn("kept", F.lit("clash")), quality_rules.fit_forest(docs, labels)).collect()}
    assert len(got) == len(GOOD + BAD + ODD)
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 100))
    for i, t in enumerate(GOOD + BAD + ODD):
        n, *_, repeats = brute_counts(t)
        assert got[i]["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
    forest = quality_rules.fit_forest(docs, labels.limit(0))
    assert forest is None
    kept = {r["doc_id"] for r in quality_rules.keep_good_documents(docs, forest).collect()}
    assert kept == {i for i in got if not got[i]["base_failed"]}


def test_forest_walks_like_plain_python():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(6, 1, size=(8, 3))])
    forest = quality_rules.IsolationForest.fit(x, trees=12, rows=len(x))  # each tree has every row

    def expected(n: int) -> float:
        """Mean path of an unsuccessful search, by its harmonic sum."""
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    lengths = np.zeros(len(x))
    for feature, value in zip(forest.feature, forest.value, strict=True):
        for i in range(len(x)):
            members, node, level = list(range(len(x))), 0, 0
            while node < len(feature) and len(members) > 1 and np.isfinite(value[node]):
                right = x[i, feature[node]] > value[node]
                members = [k for k in members if (x[k, feature[node]] > value[node]) == right]
                node, level = 2 * node + 1 + int(right), level + 1
            assert i in members
            lengths[i] += level + expected(len(members))
    plain = 2.0 ** (-lengths / len(forest.feature) / expected(len(x)))
    assert forest.score(x) == pytest.approx(plain)
    assert forest.score(x[120:]).min() > np.median(forest.score(x[:120]))


# op8


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.fit_quality(docs, labels, least_rows=2)
    got = {r["doc_id"]: r for r in quality_classifier.score_quality(docs.union(docs.limit(3)), model).distinct().collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}
    assert {i: r["held_out"] for i, r in got.items()} == held and any(held.values())
    assert all(got[i]["predicted"] == int(i < 60) for i in range(100))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert quality_classifier.score_quality(docs.limit(0), quality_classifier.fit_quality(docs, labels.limit(0))).count() == 0


def test_trees_walk_like_plain_python():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    model = quality_classifier.BoostedTrees.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=5)
    for row in x[:50]:
        margin = model.start
        for f, v, leaf in zip(model.feature, model.value, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > v[node])
            margin += leaf[node - len(f)]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


# op10


def test_toxicity(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    bad = ["vilescum", "trashbag", "lowlife", "maggotface"]
    text = lambda toxic: " ".join(rng.choice(plain) if not toxic or rng.random() > 0.08 else rng.choice(bad) for _ in range(80))
    texts = [text(i % 4 == 0) for i in range(320)]
    docs = docs_frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(320)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    truth = {i: any(b in texts[i] for b in bad) for i in range(320)}
    held = [i for i in range(320) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(got[320 + k]["predicted"] == 0 for k in range(5)) and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(5), nothing).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), nothing).count() == 0
    assert toxicity.fit_toxicity(docs.limit(0), labels).toxic == b""


def test_trained_dictionaries_keep_every_toxic_window():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))).encode()
    toxic, ordinary = [(b"vile" + word(), rng.randint(4, 200)) for _ in range(300)], [(word(), rng.randint(2, 400)) for _ in range(4000)]
    pair = toxicity.train_pair(toxic, ordinary)
    distances = toxicity.Distances(*pair)
    assert min(distances.of(w) for w, _ in toxic) > 0
    assert np.mean([distances.of(w) <= 0 for w, _ in ordinary]) > 0.9
    # far windows are counted as a plain loop over words counts them
    text = b" ".join(w for w, _ in toxic[:20] + ordinary[:50]).decode()
    windows, counts = distances.counts(pa.array([text, None, ""]))
    each = [distances.of(w.encode()) for w in text.split()]
    assert windows.tolist() == [70, 0, 0] and counts[0].tolist() == [sum(d >= f for d in each) for f in toxicity.FAR] and not counts[1:].any()


def test_toxicity_of_held_out_documents_rises_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    caught = []
    for rows in (600, 20_000):
        got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, rows=rows)).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
        toxic = got[got["toxic"] == 1]
        caught.append(toxic["predicted"].mean())
    assert got[got["toxic"] == 0]["predicted"].mean() <= 0.02
    assert caught[1] > caught[0] and toxic.groupby("lang")["predicted"].mean().min() >= 0.9


# op1


def brute_components(texts, n=4, percent=85):
    sets = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    shared = [rng.choice(vocabulary) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c + shared * (rng.random() < 0.4)))
    long = [rng.choice(vocabulary) + str(i) for i in range(400)]
    for k in range(40):  # a chain: neighbours are alike, the ends are not
        texts.append(" ".join(long[k : k + 330]))
    return texts + [t.upper() for t in texts[:3]] + ODD


@pytest.mark.parametrize("heavy", [64, 3])
def test_jaccard_components(spark, monkeypatch, heavy):
    texts = near_copies()
    monkeypatch.setattr(ngram_jaccard, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(ngram_jaccard, "PIECE_LEAST", 2)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 8 if heavy == 3 else 20_000)
    docs = docs_frame(spark, texts).withColumn("node", F.lit(1)).withColumn("component_id", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect())
    assert got == brute_components(texts)


def test_jaccard_of_no_rows_and_null_ids(spark):
    empty = docs_frame(spark, [])
    assert ngram_jaccard.jaccard_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e", "", "", 1), (7, "A b c d e", "", "", 1), (9, None, "", "", 0)], SCHEMA)
    assert sorted((r["component_id"] for r in ngram_jaccard.jaccard_components(rows).collect())) == [7, 7, 9]
    assert {r["doc_id"] for r in ngram_jaccard.keep_representatives(rows).collect()} == {None, 7, 9}


def test_filters_lose_no_link():
    rng = random.Random(6)
    for _ in range(300):
        x = {rng.getrandbits(60) for _ in range(rng.randint(1, 80))}
        y = set(rng.sample(sorted(x), max(1, int(len(x) * rng.uniform(0.8, 1))))) | {rng.getrandbits(60) for _ in range(rng.randint(0, 6))}
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        if 100 * len(x & y) >= 85 * len(x | y):
            size = min(len(ngram_jaccard.parity_bitmap(a)), len(ngram_jaccard.parity_bitmap(b)))
            differ = np.bitwise_count(ngram_jaccard._folded(ngram_jaccard.parity_bitmap(a), size) ^ ngram_jaccard._folded(ngram_jaccard.parity_bitmap(b), size)).sum()
            assert differ <= ngram_jaccard.max_difference(len(x) + len(y), 85)
            for order in ngram_jaccard._ORDERS:
                first = lambda s: set(np.sort(ngram_jaccard.mix64(s ^ order))[: ngram_jaccard.prefix_length(len(s), 85)].tolist())  # noqa: E731, B023
                assert first(a) & first(b)


def index_lists(texts, buckets=3, heavy=()):
    """The prefix postings of the texts and what the buckets make of them, without Spark."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    packed = pa.Table.from_batches(ngram_jaccard._postings(4, 85, np.array(sorted(heavy), np.uint64), buckets)(iter([batch])))
    dealt = [packed.filter(pa.compute.equal(packed["bucket"], b)) for b in range(buckets)]
    return [row for table in dealt if len(table) for made in ngram_jaccard._lists(85)(iter(table.to_batches())) for row in made.to_pylist()]


def test_jaccard_lists_of_unlike_sets_are_few_pairs():
    """Many texts that share short passages by chance, of like sizes and unlike ones, leave few pairs and hardly a list."""
    rng = random.Random(11)
    passages = [[f"p{i}_{k}" for k in range(5)] for i in range(400)]
    texts = []
    for d in range(600):
        w = [f"d{d}_{k}" for k in range(rng.choice((40, 60, 90, 130)))]
        for _ in range(3):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages)
        texts.append(" ".join(w))
    rows = index_lists(texts)
    shared = sum(len(x) for x in rare_lists(texts).values() if len(x) > 1)
    assert shared > 400 and len(rows) < shared / 3
    assert sum(r["token"] is not None for r in rows) < shared / 20


def rare_lists(texts):
    lists = {}
    for d, (_, tokens) in enumerate(ngram_jaccard._sets(pa.array(texts), 4)):
        for key in np.sort(ngram_jaccard.mix64(tokens ^ ngram_jaccard._ORDERS[0]))[: ngram_jaccard.prefix_length(len(tokens), 85)].tolist():
            lists.setdefault(key, set()).add(d)
    return lists


@pytest.mark.parametrize("list_rows", [1024, 3])
def test_jaccard_lists_lose_no_link(monkeypatch, list_rows):
    """Every pair that links is a pair of the lists or together in a list that is kept whole; a group of near copies is kept as a list."""
    monkeypatch.setattr(ngram_jaccard, "LIST_ROWS", list_rows)
    rng = random.Random(12)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randint(5, 90))] for _ in range(60)]
    texts = []
    for b in base:
        for _ in range(rng.choice((1, 2, 3, 3, 9))):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = "x%d" % rng.randrange(1000)
            texts.append(" ".join(c[: len(c) - rng.randint(0, len(c) // 9)]))
    sets = dict(ngram_jaccard._sets(pa.array(texts), 4))
    for heavy in ((), [t for s in list(sets.values())[:9] for t in s.tolist()]):
        rows = index_lists(texts, heavy=heavy)
        pairs = {(r["node"], r["pivot"]) for r in rows if r["token"] is None}
        whole = {}
        for r in rows:
            if r["token"] is not None:
                whole.setdefault(r["node"], set()).add(r["token"])
        assert pairs and whole
        for a, x in sets.items():
            for b, y in sets.items():
                common = len(np.intersect1d(x, y))
                if a < b and 100 * common >= 85 * (len(x) + len(y) - common):
                    assert (a, b) in pairs or whole.get(a, set()) & whole.get(b, set())


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_jaccard_rows_repeated_in_many_tasks(spark, monkeypatch, ids):
    """One id and text in many tasks gives its set once to the pairs, whether ids are broadcast or not."""
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", ids)
    texts, made = near_copies(), []
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs).unionByName(docs).repartition(5)
    drop = ngram_jaccard.Scratch.drop

    def counted(self, *names):
        for name in names:
            if name.startswith("filtered-"):
                pairs = spark.read.parquet(f"{self.root}/{name}")
                made.append((pairs.count(), pairs.distinct().count()))
        drop(self, *names)

    monkeypatch.setattr(ngram_jaccard.Scratch, "drop", counted)
    got = sorted({(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()})
    assert got == brute_components(texts)
    assert made and made[0][0] > 0 and all(rows == once for rows, once in made)


# op7


def brute_line_dedup(rows, least=line_dedup.MIN_CHARS):
    """Delete every run of worded lines with `least` characters that starts earlier too."""
    seq = [(d, [(k, x) for k, x in enumerate((t or "").split("\n")) if words(x)]) for d, t in rows]
    at = {}
    for d, lines in seq:
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[s:e])
                if sum(map(len, run)) >= least:
                    at.setdefault(run, []).append((d, s))
    gone = {d: set() for d, _ in rows}
    for d, lines in seq:
        for run, places in at.items():
            for p, s in places:
                if p == d and (p, s) != min(places):
                    gone[d] |= {lines[k][0] for k in range(s, s + len(run))}
    return {d: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), len(gone[d])) for d, t in rows}


def test_line_dedup(spark):
    rng = random.Random(7)
    lines = ["line %d %s" % (i, "x" * rng.choice([1, 10, 60])) for i in range(14)] + ["", "  "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["\n".join(["ab"] * 60), "\n".join(["ab"] * 60)] + ODD
    rows = list(enumerate(texts))
    docs = docs_frame(spark, texts).withColumn("seq", F.lit(1)).withColumn("digest", F.lit(2))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == brute_line_dedup(rows)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_hot_groups_keep_all_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = left_join_groups(rows, groups, "k", 3000)
    assert got.count() == 3000 and got.where("least is null").count() == 0


# op5


def edited(text, rng, every):
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [make(30) for _ in range(10)] + [None, "", "??", "Two words"]
    clean = [make(120) for _ in range(30)]
    leaked = [make(40) + " " + items[k] + ". " + make(40) for k in range(10)] + [make(30) + " " + edited(items[k], rng, 5) + " " + make(10) for k in range(10)] + ["So: TWO, words!"]
    docs = docs_frame(spark, clean + leaked + ODD[:7])
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, benchmark, block_chars=400).collect()}
    assert set(got) == {(30 + k, k) for k in range(10)} | {(40 + k, k) for k in range(10)} | {(50, 13), (56, 13)} - ({(56, 13)} if ODD[5] != "two words" else set())
    assert all(got[30 + k, k]["score"] == 1 and got[30 + k, k]["start_word"] == 40 for k in range(10))
    left = {r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect()}
    assert left == set(range(30)) | set(range(51, 58)) - {56}
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


def test_frequent_leaks_are_found(spark):
    rng = random.Random(18)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = make(12).split()
    thirds = " ".join("changed" if k in (1, 5, 8, 11) else w for k, w in enumerate(item))  # one 3-gram is left: 8 * 2 - 4 of 24
    assert sum(thirds.split()[k : k + 3] == item[k : k + 3] for k in range(10)) == 1
    texts = [make(20) + " Three short words, " + make(20) for _ in range(30)] + [make(20) + " " + thirds + " " + make(20) for _ in range(30)] + [make(40) for _ in range(30)]
    benchmark = spark.createDataFrame([(0, "three short words"), (1, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_frame(spark, texts), benchmark).collect()}
    assert got == {(k, 0) for k in range(30)} | {(30 + k, 1) for k in range(30)}


def test_most_is_a_bound():
    rng = np.random.default_rng(19)
    for _ in range(300):
        a, b = (rng.integers(0, 9, rng.integers(1, n)).astype(np.uint64) for n in (9, 14))
        assert decontaminate.alignment(a, b)[0] <= decontaminate.most(a, b)


def test_alignment_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(0, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, start, end = decontaminate.alignment(a.astype(np.uint64), b.astype(np.uint64))
        assert score == h.max() and start <= end


# op4


def test_sharding(spark, tmp_path):
    texts = ["x" * (40 + i % 7) for i in range(400)] + ODD
    docs = docs_frame(spark, texts)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read() is None
    assert store.append(docs, arrival_ids=10) == 1
    first = {s.number: s for s in store.manifest(1)}
    assert sum(s.rows for s in first.values()) == len(texts)
    assert store.append(docs.limit(30).withColumn("extra", F.lit(1)).drop("extra"), arrival_ids=10) == 2
    version = store.compact(target=4000, base=500, factor=4, fan_in=3)
    assert version == 3
    rows = store.read()
    assert rows.count() == len(texts) + 30 and store.read(1).count() == len(texts)
    for s in store.manifest():
        assert s.size <= 4000 + max(x.size for x in store.manifest(2)) and s.rows == rows.where(F.col("shard") == s.number).count()
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == dict(enumerate(texts))
    with pytest.raises(FileExistsError):
        store.commit([], 2)
    with pytest.raises(ValueError):
        store.append(docs.withColumn("shard", F.lit(1)))
    store.clean()
    assert store.read().count() == len(texts) + 30
    with pytest.raises(ValueError):
        store.commit([sharding.Shard(1, 1, 1, "a", 0), sharding.Shard(1, 1, 1, "b", 0)], store.version())
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/empty")
    assert empty.append(docs.limit(0)) == 1 and empty.manifest() == [] and empty.compact() == 1
    assert empty.read().columns == [*docs.columns, "shard"] and empty.read().count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sharding_query_compacts(spark, monkeypatch, sf):
    """The registered query on given tables: several tiers are merged, no row is lost, and the version before is still readable."""
    stores = []
    compact = sharding.ShardStore.compact
    monkeypatch.setattr(sharding.ShardStore, "compact", lambda self: (stores.append(self), compact(self))[1])
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sharding.op4_sharding(spark, f"/root/testdata/{sf}")
    want = {(r["doc_id"], len(r["text"].encode())) for r in docs.collect()}
    got = rows.collect()
    assert {(r["doc_id"], r["n_bytes"]) for r in got} == want and len(got) == docs.count()
    store, (appended, version) = stores[-1], {(r["appended_version"], r["version"]) for r in got}.pop()
    assert (len(stores), appended, version) == (3, 5, 6) and version == store.version()
    for v in (1, 3, 5):
        before, after = store.manifest(v), store.manifest(v + 1)
        assert len(before) >= sharding.FAN_IN and len(after) < len(before)
        assert Counter(map(tuple, store.read(v).select("doc_id", "text").collect())) == Counter(map(tuple, store.read(v + 1).select("doc_id", "text").collect()))
    assert len({sharding.tier_of(s.size) for v in (1, 3, 5) for s in store.manifest(v)}) >= 3
    sizes = Counter(r["shard"] for r in got)
    assert all(r["shard_rows"] == sizes[r["shard"]] for r in got)


def test_queries_without_a_configured_folder(tmp_path):
    """A process whose Spark has no setting at all."""
    code = "import sys; sys.path.insert(0, sys.argv[1])\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\nassert s.conf.get('spark.checkpoint.dir', None) is None\nfrom allelarium.llm.registry import queries\nfor q in ('op1_ngram_jaccard_join', 'op3_token_counts', 'op4_sharding', 'op7_line_dedup', 'op10_toxicity', 'op13_vector_codes'):\n    print(q, queries()[q](s, sys.argv[2]).count())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, root, "/root/testdata/sf0.001"], cwd=tmp_path, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.splitlines()) == 6 and not any(line.endswith(" 0") for line in done.stdout.splitlines())


def test_leaks_of_rows_without_or_with_one_id(spark):
    item = " ".join(f"word{k}" for k in range(20))
    rows = [(None, f"a {item} b"), (None, "nothing of it here at all"), (4, f"{item}"), (4, "clean words only"), (4, item), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(9, item), (None, "x y"), (8, None)], "item_id long, text string")
    assert sorted(r["item_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect()) == [1, 3, 5, 6]
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["score"]) for r in found) == [(0, 9, 1.0), (4, 9, 1.0), (4, 9, 1.0)]
    assert decontaminate.drop_leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == 7


def test_leaks_agree_with_aligning_every_pair(spark):
    """Every document against every item by a plain alignment of whole texts: no pair at the threshold with a seed is missed."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    texts = []
    for _ in range(80):
        words_ = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            copy = [w if rng.random() > 0.2 else rng.choice(vocabulary) for w in rng.choice(items) if rng.random() > 0.1]
            at = rng.randint(0, len(words_))
            words_[at:at] = copy
        texts.append(words_)

    def score(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(max(0, row[k] + (2 if x == y else -1), row[k + 1] - 1, new[k] - 1))
            row, best = new, max(best, *new)
        return best

    grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    want = {(i, j): score(x, t) / (2 * len(x)) for i, t in enumerate(texts) for j, x in enumerate(items) if grams(x, min(3, len(x))) & grams(t, min(3, len(x)))}
    want = {k: v for k, v in want.items() if v >= 0.5}
    docs = docs_frame(spark, [" ".join(t) for t in texts])
    benchmark = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(docs, benchmark).collect()} == pytest.approx(want) and len(want) > 40
    left = {r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark, block_chars=100).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


def test_rare_seeds(spark):
    """Counts by brute force; of each window the n-gram in the fewest documents; and any words in a row that hold a window are found."""
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 5, 6, 7, 20, 40)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 300))] for _ in range(60)] + [items[6]] * 3
    block = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items])
    docs = docs_frame(spark, [" ".join(t) for t in texts])
    counts = decontaminate.document_counts(docs.select("text"), block)
    gram = {int(h): tuple(x[k : k + min(3, len(x))]) for x, w in zip(items, block.words, strict=True) for k, h in enumerate(shingle_hashes(w, 3))}
    for h, n in zip(block.distinct, counts, strict=True):
        g = gram[int(h)]
        assert n == sum(any(tuple(t[k : k + len(g)]) == g for k in range(len(t))) for t in texts)
    block.choose(counts, 4)
    count = dict(zip(block.distinct.tolist(), counts.tolist(), strict=True))
    for i, w in enumerate(block.words):
        hashes = shingle_hashes(w, 3).tolist()
        mine = sorted(block.place[block.rare & (block.owner == i)].tolist())
        want = range(len(hashes)) if len(hashes) <= 4 else sorted({min(range(k, k + 4), key=lambda p: (count[hashes[p]], p)) for k in range(len(hashes) - 3)})
        assert mine == list(want)
    benchmark = spark.createDataFrame([(7, " ".join(items[7]))], "item_id long, text string")
    pieces = docs_frame(spark, [" ".join(items[7][k : k + 6]) for k in range(35)])
    assert decontaminate.find_leaks(pieces, benchmark, window=4, threshold=0.15).count() == 35


def test_rare_seeds_lose_no_leak_of_the_given_tables(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "benchmark"))
    exact = {tuple(r) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert {tuple(r) for r in decontaminate.op5_decontamination(spark, "/root/testdata/sf0.01").collect()} == exact and exact


def test_one_row_of_equal_ones_stays(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text), (3, "other words"), (3, "quite another text"), (None, "alone"), (None, "alone"), (None, "apart"), (4, None), (4, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in ngram_jaccard.keep_representatives(docs).collect())
    assert got == sorted([(1, text), (3, "other words"), (3, "quite another text"), (0, "alone"), (0, "apart"), (4, "")])


def test_sharding_keeps_every_row_of_odd_ids_and_after_crashes(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string"
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    batches = [
        [(i, f"a{i}") for i in range(40)],
        [(i, f"b{i}") for i in range(-25, 5)],
        [(2**53 + i, f"c{i}") for i in range(30)] + [(2**63 - 1, "max"), (-(2**63), "min")],
        [(None, None), (None, "null"), (None, "null"), (3, ""), (3, "")],
    ]
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        commit = sharding.ShardStore.commit
        monkeypatch.setattr(sharding.ShardStore, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.append(frame, arrival_ids=7)
        monkeypatch.setattr(sharding.ShardStore, "commit", commit)
        assert store.append(frame, arrival_ids=7) == k + 1
    # each shard holds consecutive ids of one arrival, by floor division
    shards = store.manifest()
    assert len(shards) == len({s.number for s in shards}) == sum(len({None if i is None else i // 7 for i, _ in rows}) for rows in batches)
    store.compact(target=60, base=5, factor=4, fan_in=3)
    want = Counter(row for rows in batches for row in rows)
    assert Counter(map(tuple, store.read().select("doc_id", "text").collect())) == want
    assert {s.number: s.rows for s in store.manifest()} == dict(map(tuple, store.read().groupBy("shard").count().collect()))
    before = sum(1 for f in (tmp_path / "store").iterdir())
    store.clean()
    assert sum(1 for f in (tmp_path / "store").iterdir()) < before - 3
    assert Counter(map(tuple, store.read().select("doc_id", "text").collect())) == want
    # of two writers that read one version, one commits
    other, now = sharding.ShardStore(spark, store.root), store.version()
    monkeypatch.setattr(other, "version", lambda: now)
    assert store.append(spark.createDataFrame(batches[0], schema)) == now + 1
    with pytest.raises(FileExistsError):
        other.append(spark.createDataFrame(batches[1], schema))
    assert store.read().count() == sum(want.values()) + 40


def test_plan_agrees_with_merging_one_run_at_a_time():
    """A plain model: runs of the lowest due tier are merged one after another, in order."""
    rng = random.Random(12)
    for _ in range(100):
        sizes = {n: rng.choice([0, 10, 60, 300, 900, 2500]) for n in range(rng.randint(0, 40))}
        now = {n: [n] for n in sizes}
        size = lambda n: sum(sizes[m] for m in now[n])
        tier = lambda n: sum(size(n) >= 50 * 4**t for t in range(1, 9))
        while True:
            small = [n for n in now if size(n) < 2000]
            due = min((t for t in map(tier, small) if sum(tier(n) == t for n in small) >= 4), default=None)
            if due is None:
                break
            members, done, runs = sorted(n for n in small if tier(n) == due), 0, {}
            for n in members:
                runs.setdefault(done // 2000, []).append(n)
                done += size(n)
            if all(len(run) == 1 for run in runs.values()):
                break
            for first, *rest in runs.values():
                for n in rest:
                    now[first] += now.pop(n)
        want = {m: n for n, members in now.items() for m in members}
        assert sharding.plan_compaction(sizes, target=2000, fan_in=4, base=50, factor=4) == want


def test_plan_merges_until_no_tier_is_due():
    rng = random.Random(10)
    for _ in range(50):
        sizes = {n: rng.choice([0, 10, 100, 1000, 5000]) for n in range(rng.randint(0, 60))}
        plan = sharding.plan_compaction(sizes, target=2000, fan_in=4, base=50)
        total = Counter()
        for n, m in plan.items():
            total[m] += sizes[n]
        assert set(plan) == set(sizes) and sum(total.values()) == sum(sizes.values())
        assert all(plan[n] == n for n in sizes if sizes[n] >= 2000)
        assert all(t < 2000 + max(sizes.values()) for t in total.values())


# op6


def test_chat_format(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "cem", None), (1, 3, "cem", None), (2, 0, "system", "only"), (None, None, None, "n"), (3, 2000, "a", "late"), (3, -5, "b", ""), (3, 2000, "a", "also")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    segments = chat_format.rotate_perspectives(frame)
    got = {}
    for r in segments.collect():
        got.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cem"), (None, "unknown"), (3, "a"), (3, "b")}
    for (conv, who), rows in got.items():
        rows.sort(key=lambda r: r["seq"])
        mine = sorted(((t, r or "unknown", x or "") for c, t, r, x in turns if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        whole = ""
        for k, ((_, role, text), row) in enumerate(zip(mine, rows, strict=True)):
            head = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
            assert row["segment"] == f"<|im_start|>{head}\n{text}<|im_end|>\n" and row["seq"] == k and row["is_target"] == (role == who)
            assert row["start_char"] == len(whole)
            whole += row["segment"]
            assert row["end_char"] == len(whole)
    joined = {(r["conv_id"], r["perspective"]): r for r in chat_format.whole_dialogues(segments).collect()}
    text = joined[1, "bob"]["text"]
    assert [text[s["start"] : s["end"]] for s in joined[1, "bob"]["target_spans"]] == ["<|im_start|>assistant\nyo<|im_end|>\n"]
    assert chat_format.rotate_perspectives(frame.limit(0)).count() == 0


def test_shingles():
    w = np.arange(6, dtype=np.uint64)
    assert len(shingle_hashes(w, 4)) == 3 and len(shingle_hashes(w[:2], 4)) == 1 and len(shingle_hashes(w[:0], 4)) == 0


def test_blocks_of_a_long_list_meet_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 5)
    of = {i: 100 if i % 2 else i for i in range(37)}
    at = spark.createDataFrame([(1, i, 9, c) for i, c in of.items()], "token long, node long, n long, comp long")
    long = spark.createDataFrame([(1, 8)], "_token long, blocks int")
    blocks: dict[int, list] = {}
    for r in ngram_jaccard._dealt(at, long).collect():
        blocks.setdefault(r["salt"], []).append((r["node"], r["side"]))
    met = Counter()
    for rows in blocks.values():
        met.update((a, b) for a, sa in rows for b, sb in rows if a < b and (sa == 0 or sa != sb))
    wanted = {(a, b) for a in of for b in of if a < b and of[a] != of[b]}
    assert {p: met[p] for p in wanted} == dict.fromkeys(wanted, 1)
    assert max(map(len, blocks.values())) <= 4 * 5


def test_prefixes_of_further_orders_keep_every_link():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 40, 300):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        changed = rng.integers(0, 1 << 63, len(x)).astype(np.uint64)
        for k in range(len(x) + 1):
            y = np.unique(np.concatenate([x[k:], changed[:k]]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 85 * (len(x) + len(y) - common):
                batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), *(pa.array([ngram_jaccard.further_prefixes(t, 85)], pa.list_(pa.binary())) for t in (x, y))], ["a", "b", "pa", "pb"])
                assert sum(len(b) for b in ngram_jaccard._pass_orders(iter([batch]))) == 1
    unlike = [ngram_jaccard.further_prefixes(np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64)), 85) for _ in "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), *(pa.array([u], pa.list_(pa.binary())) for u in unlike)], ["a", "b", "pa", "pb"])
    assert sum(len(b) for b in ngram_jaccard._pass_orders(iter([batch]))) == 0


def plain_trees(x, y, trees, depth, bins, rate, ridge, least_rows):
    """Margins after boosting by a search over every cut of every node, row by row."""
    n, m = len(x), len(x[0])
    edges = [sorted({sorted(r[j] for r in x)[math.floor(q * (n - 1) + 1e-9)] for q in (k / bins for k in range(1, bins))}) for j in range(m)]
    share = (sum(y) + 0.5) / (n + 1)
    margin = [math.log(share / (1 - share))] * n
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        groups = [list(range(n))]
        for _ in range(depth):
            after = []
            for rows in groups:
                best, cut = 1e-9, None
                for j in range(m):
                    for e in edges[j]:
                        left, right = [i for i in rows if x[i][j] <= e], [i for i in rows if x[i][j] > e]
                        if len(left) < least_rows or len(right) < least_rows:
                            continue
                        part = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + ridge)
                        gain = part(left) + part(right) - part(rows)
                        if gain > best + 1e-12:
                            best, cut = gain, (left, right)
                after += cut if cut else (rows, [])
            groups = after
        for rows in groups:
            step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                margin[i] += step
    return margin


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_are_those_of_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(61, 3)), 2)
    # labels between 0 and 1, so that no two cuts have the same gain
    y = 1 / (1 + np.exp(-4 * (x[:, 0] + x[:, 1] * x[:, 2]) + rng.normal(size=61)))
    parameters = {"trees": 4, "depth": 3, "bins": 8, "rate": 0.3, "ridge": 1.0, "least_rows": 4}
    got = quality_classifier.BoostedTrees.fit(x, y, **parameters).score(x)
    want = [1 / (1 + math.exp(-v)) for v in plain_trees(x.tolist(), y.tolist(), **parameters)]
    assert np.allclose(got, want, atol=1e-9) and got.std() > 0.1


def test_toxicity_scores_by_compressing_every_window(spark):
    """The scores of a fitted model against compressing each word of each text anew."""
    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    some = docs.where("length(text) < 3000").limit(60).unionByName(docs_frame(spark, ODD, docs.schema))
    lengths = []
    for dictionary in (model.ordinary, model.toxic):
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=toxicity.LEVEL)
        plain = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        lengths.append(lambda w, z=plain: len(z.compress(toxicity._window(w))))
    known = {}

    def far(word):
        if word not in known:
            known[word] = lengths[0](word) - lengths[1](word) >= model.far
        return known[word]

    got = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(some, model).collect()}
    want = set()
    for r in some.collect():
        found = re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (r["text"] or "").encode())
        n = sum(far(w.lower()) for w in found)
        want.add((r["doc_id"], 1 / (1 + math.exp(-min(30, max(-30, model.slope * n / math.sqrt(max(1, len(found))) + model.constant))))))
    assert {(i, round(s, 9)) for i, s in got} == {(i, round(s, 9)) for i, s in want} and len({s for _, s in want}) > 3
