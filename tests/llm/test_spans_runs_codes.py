"""Secret scans, periodic runs and vector codes against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from allelarium.llm import periodic_runs, secret_scan, vector_codes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op12


def plain_runs(words, min_exponent=4, min_words=6):
    """Every pair of places and distance by trial."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= 2 * q:
                found.setdefault((i, j - i + q), q)  # the least period comes first
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(min_words, min_exponent * q)), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        root = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        n = rng.randint(1, 7 * len(root))
        out += (root * 8)[:n] if rng.random() < 0.7 else [rng.choice("ab") for _ in range(n)]
    return out


@pytest.mark.parametrize("min_exponent,min_words", [(4, 6), (2, 2), (3, 9), (4, 1)])
def test_runs_by_brute_force(min_exponent, min_words):
    rng = random.Random(min_exponent * 100 + min_words)
    for _ in range(250):
        words = [w.encode() for w in periodic_words(rng)]
        assert periodic_runs.runs_of(words, min_exponent=min_exponent, min_words=min_words) == plain_runs(words, min_exponent, min_words)
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    words = [bytes([c]) for c in fibonacci[-1]]
    assert periodic_runs.runs_of(words, min_exponent=2, min_words=2) == plain_runs(words, 2, 2)


def test_ends_keep_their_order(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 5)
    rng = random.Random(3)
    order = rng.sample(range(1_000), 300)
    ends, plain = periodic_runs.Ends(order[0]), [order[0]]
    for e in order[1:]:
        before, after = max((x for x in plain if x < e), default=-1), min((x for x in plain if x > e), default=-1)
        assert ends.add(e) == (before, after)
        plain.append(e)
    assert list(ends) == sorted(plain) and len(ends) == 300


def test_long_runs():
    """Of one word, and of two that alternate now and then: no square of the length in time or sets."""
    assert periodic_runs.runs_of([b"x"] * 60_000) == [(0, 60_000, 1)]
    rng = random.Random(8)
    root = [str(rng.randrange(50)).encode() for _ in range(5_000)]
    assert periodic_runs.runs_of(root * 5 + root[:100]) == [(0, 25_100, 5_000)]


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_run_query(spark, tmp_path):
    rng = random.Random(17)
    texts = [None, "", " \n\t", "one", "é é é é é é\x0bé", "a b " * 9, "x y z", "Word word " * 7, "lone " * 3 + "end"]
    texts += [" ".join(periodic_words(rng)) + rng.choice(["", " \x0c ", "\n"]) for _ in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "k " * 8, "en"), (7, texts[7], None), (-20, "q r " * 40, "en"), (1 << 60, "w " * 20_000, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, _ in rows:
        words = planted(doc_id, WORD.findall((text or "").encode()))
        runs = plain_runs(words) if len(words) < 5_000 else [(0, len(words), 1)]
        keep = [True] * len(words)
        for s, n, q in runs:
            keep[s + q : s + n] = [False] * (n - q)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        collapsed = hashlib.sha256(b" ".join(w for w, k in zip(words, keep, strict=True) if k)).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), collapsed))
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert dict(got.dtypes)["exponent_milli"] == dict(got.dtypes)["n_runs"] == "bigint"
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(w[1] > 0 for w in want) > 100


def test_periodic_runs_of_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, runs int, collapsed string, more int")
    found = periodic_runs.find_periodic_runs(docs)
    assert found.columns == ["doc_id", "more", "runs", "collapsed"] and found.count() == 0


# op11

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PIECES = ["token=", "Token: ", "API_KEY = '", "apikey=\"", "my_secret_token:", "password :", "PASSWD=", "secret==", "token=token:", "AKIA", "AKIAAKIA", "XAKIA", "é", "😀", "\n", " ", "  ", "ordinary_identifier", "some words here", ".", "'", "==", "-/+", "0" * 23, "0" * 24, "deadbeef" * 4, "AKIA" + "Z9" * 8, "{20,}"]


def odd_text(rng):
    def piece():
        k = rng.random()
        if k < 0.6:
            return rng.choice(PIECES)
        charset, n = rng.choice([("0123456789abcdef", 40), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 33), ("etaoinsr", 12)])
        return "".join(rng.choice(charset) for _ in range(rng.randint(1, n)))

    return "".join(piece() for _ in range(rng.randint(0, 30)))


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def plain_ratio(texts):
    counts = {True: Counter(), False: Counter()}
    for text in texts:
        for label, pattern in ((True, secret_scan.RANDOM), (False, secret_scan.ORDINARY)):
            for s in set(re.findall(pattern, text)):
                counts[label].update(zip(s, s[1:]))
    after = {c: Counter() for c in counts}
    for c in counts:
        for (a, _), n in counts[c].items():
            after[c][a] += n

    def step(a, b):
        p = {c: (counts[c][a, b] + 1) / (after[c][a] + 66) for c in counts}
        return math.floor(1000 * (math.log((p[True] + 1 / 66) / 2) - math.log(p[False])) + 0.5)

    mean = {c: sum(n * step(*ab) for ab, n in counts[c].items()) / sum(counts[c].values()) for c in counts}
    return step, math.floor((mean[True] + mean[False]) / 2)


def plain_spans(text, step, threshold):
    spans = plain_base(text)
    for m in re.finditer(f"{ASSIGN.pattern}|({secret_scan.CANDIDATE})", text):
        v = m[3]
        if v and re.search("[A-Za-z]", v) and not re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", v) and sum(step(a, b) for a, b in zip(v, v[1:])) > threshold * (len(v) - 1):
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_secret_scan_by_brute_force(spark, tmp_path):
    rng = random.Random(23)
    texts = [None, "", "\n", "no secrets", "token=" + "a" * 5, "x" * 3_000 + " token = 'abcdef'", "ab " * 30_000 + "AKIA" + "Q" * 16, ("0123456789abcdef" * 2 + " ") * 3_000] + [odd_text(rng) for _ in range(400)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "secret:abcdefg", None), (9, texts[9], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    step, threshold = plain_ratio([t or "" for _, t, _ in rows])
    want, added = [], 0
    for doc_id, text, _ in rows:
        base, spans = plain_base(text or ""), plain_spans(text or "", step, threshold)
        added += len(spans) - len(base)
        want.append((doc_id, *(sum(k == x for _, k, _ in base) for x in range(3)), sha(joined(base)), joined(spans)))
    got = secret_scan.op11_secret_scan(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert added > 20 and all(sum(w[k] for w in want) > 20 for k in (1, 2, 3))


def test_random_strings_without_a_pattern_are_added(spark):
    """Strings of letters and digits in either case, which no sample shows, and none of the identifiers."""
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["configuration", "implementation", "responsibility", "understanding", "international", "characteristics"]
    plain = [" ".join(rng.choice(words) for _ in range(30)) + " key " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    hidden = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(plain, hidden, strict=True))], "doc_id long, a string, h string")
    docs = docs.select("doc_id", F.concat("a", F.lit(" "), F.lit("_".join(words)), F.lit(" "), "h").alias("text"))
    found = secret_scan.scan_secrets(docs, secret_scan.fit_ratio(docs))
    added = found.select("doc_id", F.explode("spans").alias("s")).where("s.kind = 3").join(docs, "doc_id").select(F.expr("substring(text, int(s.start + 1), int(s.end - s.start))")).collect()
    assert sorted(r[0] for r in added) == sorted(hidden)


def test_secret_scan_without_samples(spark):
    docs = spark.createDataFrame([(1, "a" * 30 + " Zz9" * 9)], "doc_id long, text string")
    ratio = secret_scan.fit_ratio(docs.where("false"))
    assert ratio.threshold is None and secret_scan.scan_secrets(docs.where("false"), ratio).count() == 0
    assert [tuple(s) for s in secret_scan.scan_secrets(docs, ratio).first()["spans"]] == [(0, 2, 30)]


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 3_000):
        values = [(7 * k) % 11 for k in range(n)]
        row = spark.createDataFrame([(values,)], "v array<bigint>").select(secret_scan.running_sums(F.col("v"))).first()[0]
        assert row == [sum(values[: k + 1]) for k in range(n)]


# op13


def plain_codes(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(part(v, p), book)[0], []).append(part(v, p))
            books[p] = [[sum(col) // len(members[e]) for col in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(book)]
    coded = [(i, [nearest(part(v, p), books[p]) for p in range(4)], label) for i, v, label in kept]
    total = Counter()
    for _, near, label in coded:
        total[label] += sum(d for _, d in near)
    digest = sha(",".join(str(x) for book in books for c in book for x in c))
    return [(i, "".join(f"{e:02x}" for e, _ in near), sum(d for _, d in near), total[label], digest) for i, near, label in coded]


def vector_rows(n):
    rng = random.Random(n)
    rows = [(i * 3, [float(F32(rng.gauss(0, 0.3))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(1, None, 1), (2, [None] * 8, 1), (4, [math.nan] + [0.0] * 7, 2), (5, [math.inf] + [0.0] * 7, None)]
    if n:
        rows += [rows[0], (rows[0][0], [0.5] * 8, 1), (None, [0.25] * 8, None), (100_000, rows[1][1] if n > 1 else [0.0] * 8, 7)]
    return rows


def F32(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("n", [1, 40, 400])
def test_vector_codes_by_brute_force(spark, tmp_path, n):
    rows = vector_rows(n)
    spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, error int, more string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_codes(rows))


def test_vector_codes_of_odd_rows(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op13_vector_codes(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 8, 0), (2, [1.0] * 7, 0), (3, [2.0] * 4, 0), (4, [], 0), (5, [3.0] * 8, 0)], schema)
    books = vector_codes.train_codebooks(odd)
    assert [b.tolist() for b in books] == [[[1024, 1024], [3072, 3072]]] * 4
    assert {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.encode_vectors(odd, books).collect()} == {1: ("00000000", 0), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("01010101", 0)}
    empty = odd.where("vec_id = 4")
    assert [tuple(r) for r in vector_codes.encode_vectors(empty, vector_codes.train_codebooks(empty)).collect()] == [(4, 0, "00000000", 0)]
    with pytest.raises(ValueError):
        vector_codes.train_codebooks(odd, entries=257)
    with pytest.raises(ArithmeticError):
        vector_codes.train_codebooks(spark.createDataFrame([(1, [1e6] * 4, 0)], schema))
