"""Operators on small literal inputs, with values worked out by hand or by numpy."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelarium.functions import bins, calls
from allelarium.functions.genome import in_autosome, in_x_nonpar
from allelarium.model import VARIANT, CallSet, variables
from allelarium.operators import filters, joint, linear, packed, sample_stats, variant_stats
from allelarium.operators.concordance import _Joined, global_concordance, sample_concordance, variant_concordance
from allelarium.operators.confusion import STATES
from allelarium.operators.joint_call_set import JointCallSet
from allelarium.operators.views import ConcordanceTable
from allelarium.plans.concordance import compare
from allelarium.plans.sample_qc import calculate_sample_qc_stats
from allelarium.sources import call_sets, sinks
from allelarium.streaming import incremental

ENTRY = "contig string, position int, alleles array<string>, s string, n_alt int, gq int, dp int, ad array<int>"


def call_set(spark, cells, samples=None, rows=None):
    """cells: (position, s, n_alt[, gq[, dp[, ad]]]) on chr1, alleles A and G."""
    full = [("chr1", c[0], ["A", "G"], *c[1:3], *(list(c[3:]) + [30, 20, [10, 10]][len(c) - 3 :])) for c in cells]
    rows = rows or sorted({(c[0],) for c in cells})
    variants = spark.createDataFrame([("chr1", r[0], ["A", "G"]) for r in rows], "contig string, position int, alleles array<string>")
    names = samples or sorted({c[1] for c in cells})
    return CallSet(variants, spark.createDataFrame([(s, f"pop{i % 2}") for i, s in enumerate(names)], "s string, pop string"), spark.createDataFrame(full, ENTRY))


def test_bins_at_their_edges(spark):
    at = lambda v: spark.createDataFrame([(v,)], "x double").select(bins.bin_case(F.col("x"), bins.MAF_EDGES, bins.MAF_REST)).first()[0]
    assert [at(v) for v in (0.0, 0.01, 0.0101, 0.02, 0.05, 0.051, None, math.nan)] == ["<1%", "<1%", "1-2%", "1-2%", "2-5%", ">5%", None, ">5%"]
    row = spark.createDataFrame([(1, 80, 91, 0.95, 10)], "AC int, gq int, dp int, max_gp double, qual_approx int")
    get = lambda f: row.select(f(F.col)).first()[0]
    assert (get(bins.mac_bin), get(bins.gq_bin), get(bins.dp_bin), get(bins.max_gp_bin), get(bins.qual_approx_bin)) == ("1", 80, 100, 0.95, 10)


CELLS = dict(
    exo=[(1, "a", 0), (1, "b", 1), (2, "a", 2), (2, "b", None), (3, "a", 1)],
    imp=[(1, "a", 0), (1, "b", 2), (2, "a", 2), (2, "b", 1), (3, "b", None)],
)


def test_confusion_counts(spark):
    exo, imp = call_set(spark, CELLS["exo"]), call_set(spark, CELLS["imp"], samples=["a", "b", "c"])
    r = global_concordance(exo, imp).df.first()
    seen = {(i, j): r[f"{STATES[i]}_{STATES[j]}"] for i in range(5) for j in range(5)}
    assert {k: v for k, v in seen.items() if v} == {(2, 2): 1, (3, 4): 1, (4, 4): 1, (1, 3): 1, (3, 0): 1, (0, 1): 1}
    assert (r["n_variants"], r["n_samples"], r["n_total"], r["n_concordant"], r["n_hets"]) == (3, 2, 3, 2, 2)
    assert r["concordance_rate"] == "66.67" and r["f1_score_raw"] == pytest.approx(2 / 3)
    by_variant = variant_concordance(exo, imp).df
    by_sample = sample_concordance(exo, imp).df
    for parts in (by_variant, by_sample):
        total = parts.agg(*(F.sum(f"{STATES[i]}_{STATES[j]}").alias(f"{i}{j}") for i in range(5) for j in range(5))).first()
        assert {(i, j): total[f"{i}{j}"] for i in range(5) for j in range(5)} == seen
    flipped = global_concordance(imp, exo).df.first()
    assert all(flipped[f"{STATES[j]}_{STATES[i]}"] == n for (i, j), n in seen.items())


def test_rates_without_cells_are_missing(spark):
    one = call_set(spark, [(1, "a", None)])
    r = global_concordance(one, one).df.first()
    assert r["concordance_rate"] is None and r["f1_score"] is None and r["n_total"] == 0 and r["NOCALL_NOCALL"] == 1


def test_outer_join_counts_right_only_variants(spark):
    exo, imp = call_set(spark, [(1, "a", 1)]), call_set(spark, [(1, "a", 1), (9, "a", 2)])
    r = global_concordance(exo, imp, join_type=joint.JoinType.outer).df.first()
    assert (r["n_variants"], r["MISSING_HOMALT"], r["HET_HET"]) == (1, 1, 1)


def test_names_and_ids_are_checked(spark):
    cs = call_set(spark, [(1, "a", 1)])
    v = variables("exome", "col", {"pop": lambda at: at("pop")})
    with pytest.raises(ValueError, match="more than once"):
        global_concordance(cs, cs, [*v, *v])
    with pytest.raises(ValueError, match="entries"):
        global_concordance(cs, cs, variables("exome", "entry", {"GQ": bins.gq_bin}))
    twice = cs.with_(samples=cs.samples.union(cs.samples))
    with pytest.raises(ValueError, match="duplicate sample ids.*a"):
        joint.check_samples(twice, cs)
    with pytest.raises(ValueError, match="no column"):
        CallSet(cs.variants.drop("alleles"), cs.samples, cs.entries)


def test_views_and_exports(spark, tmp_path):
    exo, imp = call_set(spark, CELLS["exo"]), call_set(spark, CELLS["imp"])
    table = global_concordance(exo, imp, variables("exome", "col", {"pop": lambda at: at("pop")}), variables("exome", "entry", {"GQ": bins.gq_bin}))
    table = table.write(f"file://{tmp_path}/conc")
    assert table.group_vars == {"ALL": "string", "pop": "string"} and table.agg_vars["GQ"] == "int"
    view = table.get_view(group_names=["pop"], agg_names=["ALL"], ordering={"pop": ["pop1", "pop0"]})
    frame = view.result()
    assert list(frame["group_var"]) == ["pop1", "pop0"]
    assert list(table.get_view(agg_names=["GQ"], group_names=["ALL"]).result()["agg_var"]) == [30]
    assert len(table.get_view(group_names=[], agg_names=[]).result()) == 6
    assert "n_discordant" in view.fields
    view.export(f"file://{tmp_path}/v.csv", {"n_total": "Total"})
    assert (tmp_path / "v.csv").read_text().splitlines()[0].endswith("Total")
    paths = table.get_view().export_all(f"file://{tmp_path}/all")
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["ALL_ALL.tsv", "ALL_GQ.tsv", "pop_ALL.tsv", "pop_GQ.tsv"]
    whole = table.get_view(group_names=["pop"], agg_names=["ALL"])
    kept = whole._selected(None)
    text = (tmp_path / "all" / "pop_ALL.tsv").read_text()
    frame = kept.toPandas()
    frame = frame.astype({c: "Int64" for c, t in kept.dtypes if t == "bigint"})
    assert text == frame.to_csv(index=False, sep="\t") and len(text.splitlines()) == 1 + kept.count()
    whole._write(kept.where("false"), f"file://{tmp_path}/none.csv")
    assert (tmp_path / "none.csv").read_text().strip() == ",".join(kept.columns)
    with pytest.raises(ValueError):
        table.get_view(group_names=["nothing"])
    with pytest.raises(NotImplementedError):
        table.get_view().plot()
    variant = variant_concordance(exo, imp)
    assert len(variant.get_view(key={"locus": "chr1:2", "alleles": ["A", "G"]}).result()) == 1
    assert ConcordanceTable.load(spark, f"file://{tmp_path}/conc").df.count() == table.df.count()


def test_split_and_least_representation(spark):
    least = lambda p, r, a: tuple(spark.createDataFrame([(p, r, a)], "p int, r string, a string").select(calls.min_rep(F.col("p"), F.col("r"), F.col("a")).alias("m")).first()["m"])
    assert least(10, "AT", "GT") == (10, "A", "G") and least(10, "CAT", "CGT") == (11, "A", "G")
    assert least(10, "CTT", "CT") == (10, "CT", "C") and least(10, "A", "AT") == (10, "A", "AT") and least(5, "G", "G") == (5, "G", "G")
    rows = spark.createDataFrame([("chr1", 10, ["A", "G", "AT"]), ("chr1", 20, ["C"])], "contig string, position int, alleles array<string>")
    entries = spark.createDataFrame([("chr1", 10, ["A", "G", "AT"], "a", [1, 2], 2, [3, 4, 5]), ("chr1", 10, ["A", "G", "AT"], "b", None, None, None)], "contig string, position int, alleles array<string>, s string, gt array<int>, n_alt int, ad array<int>")
    out = variant_stats.split_multi(CallSet(rows, spark.createDataFrame([("a",), ("b",)], "s string"), entries))
    got = {(tuple(r["alleles"]), r["s"]): (r["gt"], r["n_alt"], r["ad"]) for r in out.entries.collect()}
    assert got[("A", "G"), "a"] == ([1, 0], 1, [8, 4]) and got[("A", "AT"), "a"] == ([0, 1], 1, [7, 5]) and got[("A", "G"), "b"] == (None, None, None)
    assert out.variants.count() == 2


def test_intervals_at_their_borders(spark):
    rows = spark.createDataFrame([("chr1", p) for p in (9, 10, 11, 20, 21, 1 << 20, (1 << 20) + 5)], "contig string, position int")
    spans = spark.createDataFrame([("chr1", 10, 15), ("chr1", 12, 20), ("chr1", (1 << 20) - 3, (1 << 20) + 4), ("chr2", 0, 99), ("chr1", 30, 30)], "contig string, start int, end int")
    assert sorted(r["position"] for r in filters.in_intervals(rows, spans).collect()) == [11, 20, 1 << 20]
    assert sorted(r["position"] for r in filters.in_intervals(rows, spans, keep=False).collect()) == [9, 10, 21, (1 << 20) + 5]
    x = spark.createDataFrame([("chrX", 2_781_479), ("chrX", 2_781_480), ("X", 10_000), ("chr1", 5)], "c string, p int")
    assert [r[0] for r in x.select(in_x_nonpar(F.col("c"), F.col("p"))).collect()] == [False, True, True, False]
    assert [r[0] for r in x.select(in_autosome(F.col("c"))).collect()] == [False, False, False, True]


def test_genotype_filter(spark):
    cells = [(1, "a", 1, 20, 10, [8, 2]), (1, "b", 1, 20, 10, [9, 1]), (1, "c", 0, 20, 9, [9, 0]), (1, "d", 2, 19, 30, [0, 30]), (1, "e", None), (1, "f", 1, 20, 10, [2, 8]), (1, "g", 2, 99, 9, [0, 9])]
    cs = call_set(spark, cells)
    kept = lambda gatk: {r["s"] for r in filters.filter_genotypes(cs, is_gatk=gatk).entries.collect()}
    assert kept(True) == {"a", "f"} and kept(False) == {"a", "f", "c"}


def test_lists_and_samples(spark):
    cs = call_set(spark, [(p, s, 1) for p in range(1, 41) for s in "abc"])
    out, down = filters.apply_filters(cs, sample_list=spark.createDataFrame([("a",), ("z",)], "s string"))
    assert out.count() == (40, 1) and not down
    out, down = filters.apply_filters(cs, variant_list=spark.createDataFrame([("chr1:7:A:G",), ("chr1:8:A:T",)], "v string"), n_samples=2)
    assert out.count() == (1, 2) and down and out.entries.count() == 2
    again = lambda n: {r["position"] for r in filters.hash_sample(cs.variants.repartition(n), 0.5, *VARIANT).collect()}
    assert again(1) == again(5) and 5 < len(again(1)) < 35
    with pytest.raises(Exception, match="not a variant"):
        filters.variant_keys(spark.createDataFrame([("chr1-7",)], "v string")).collect()


def test_sample_statistics(spark):
    cs = call_set(spark, [(1, "a", 2, 30, 20, [1, 19]), (1, "b", 0), (2, "a", 1, 10), (2, "b", 1, 30), (3, "b", 1, None)], samples=["a", "b", "c"])
    q = {r["s"]: r for r in sample_stats.sample_qc(cs).collect()}
    assert (q["a"]["n_het"], q["a"]["n_hom_var"], q["a"]["n_transition"], q["b"]["n_singleton"], q["c"]["n_snp"]) == (1, 1, 3, 1, 0)
    assert q["a"]["r_ti_tv"] is None
    g = {r["s"]: r["gq_fraction"] for r in sample_stats.gq_fraction(cs).collect()}
    assert g["a"]["gq_fraction"] == 0.5 and g["b"]["gq_fraction"] == pytest.approx(2 / 3) and g["c"]["is_passing"] is None
    c = {r["s"]: r["contamination"] for r in sample_stats.contamination(cs).collect()}
    assert c["a"]["charr"] == pytest.approx(0.05 / 0.5) and c["a"]["is_passing"] is False and c["b"]["charr"] is None
    metrics = spark.createDataFrame([(str(i), v, p) for i, (v, p) in enumerate([(10, "x"), (11, "x"), (12, "x"), (99, "x"), (5, None), (5, None), (6, "y")])], "s string, m int, ancestry_pop string")
    out = {r["s"]: r["qc_metrics"]["fail_m"] for r in sample_stats.outliers(metrics.select("s", "m"), metrics.select("s", "ancestry_pop"), columns=("m",)).collect()}
    assert out == {"0": False, "1": False, "2": False, "3": True, "4": False, "5": False, "6": False}


def test_result_and_passing(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = [(p, f"s{k}", int(rng.integers(0, 3)), int(rng.integers(10, 60)), 20, [10, 10]) for p in range(1, 31) for k in range(12)]
    cs = call_set(spark, cells)
    result = calculate_sample_qc_stats(cs, cs.variants, pre_pruned_variants=cs.variants.where("position < 20"), pcs_k=3)
    saved = result.write(f"file://{tmp_path}/qc")
    assert saved.table.count() == 12 and len(saved.table.first()["pcs"]["scores"]) == 3
    every = saved.passing_samples(F.lit(True)).table.count()
    assert every == 12 and saved.passing_samples().table.count() <= 12
    saved.export(f"file://{tmp_path}/qc.tsv")
    assert {"contamination.charr", "sex_info.f_stat", "ancestry.ancestry_pop"} <= set(saved.flat().columns)
    assert saved.plot_qc_metric_data().count() == 12 * len(sample_stats.OUTLIER_METRICS) and saved.plot_pcs_data(1, 2).count() == 12


def test_components_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (40, 9))
    x[x.min(1) == x.max(1), 0] = (x[x.min(1) == x.max(1), 0] + 1) % 3
    cs = call_set(spark, [(i + 1, f"s{j}", int(x[i, j])) for i in range(40) for j in range(9)])
    p = x.mean(1) / 2
    keep = (p > 0) & (p < 1)
    z = ((x - 2 * p[:, None]) / np.sqrt(2 * p * (1 - p))[:, None])[keep] / np.sqrt(keep.sum())
    _, sigma, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["pcs"]["scores"] for r in linear.compute_pcs(cs, k=3).orderBy("s").collect()])
    want = (vt[:3].T * sigma[:3])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_related_samples_go(spark):
    rng = np.random.default_rng(3)
    x = rng.binomial(2, rng.uniform(0.2, 0.8, 400)[:, None], (400, 8))
    x[:, 7] = x[:, 6]
    cs = call_set(spark, [(i + 1, f"s{j}", int(x[i, j])) for i in range(400) for j in range(8)])
    scores = cs.samples.select("s", F.array(F.lit(0.0)).alias("scores"))
    out = {r["s"]: r["relatedness"]["is_passing"] for r in linear.relatedness(cs, scores=scores, min_kinship=0.3).collect()}
    assert sorted(s for s, ok in out.items() if not ok) == ["s7"]
    with pytest.raises(ValueError):
        linear.relatedness(cs)


def test_dropped_vertices_are_those_of_one_name_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for n, m in ((2, 1), (12, 20), (30, 45), (40, 25)):
        edges = {tuple(sorted((f"s{a:02}", f"s{b:02}"))) for a, b in rng.integers(0, n, (m, 2)) if a != b}
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        gone = set()
        while any(near.values()):
            worst = max(near, key=lambda s: (len(near[s]), s))
            for other in near.pop(worst):
                near[other].discard(worst)
            gone.add(worst)
        frame = spark.createDataFrame(sorted(edges), "s_1 string, s_2 string")
        for most in (10, 1_000_000):  # in rounds down to ten edges, and in one task
            monkeypatch.setattr(linear, "GRAPH_EDGES", most)
            assert {r["s"] for r in linear.vertices_to_drop(frame).collect()} == gone
    assert linear.vertices_to_drop(frame.where("false")).count() == 0


@pytest.mark.parametrize("n,k", [(3, 5), (40, 4), (300, 6)])
def test_leading_eigenvectors(n, k, monkeypatch):
    """Against the dense decomposition, for a flat spectrum too, and with a basis so small that it starts anew."""
    rng = np.random.default_rng(n)
    z = rng.standard_normal((2 * n, n))
    a = z.T @ z / n
    want = np.linalg.eigvalsh(a)[::-1][:k]
    for limit in (1 << 30, 1):
        monkeypatch.setattr(linear, "BASIS_BYTES", limit)
        values, vectors = linear.leading_eigenvectors(lambda q: a @ q, n, k)
        assert np.allclose(values, want, rtol=1e-9) and np.linalg.norm(a @ vectors - vectors * values) < 1e-7 * want[0]
    low = z[:2].T @ z[:2]
    values, vectors = linear.leading_eigenvectors(lambda q: low @ q, n, min(k, n))
    assert np.allclose(values[:2], np.linalg.eigvalsh(low)[::-1][:2]) and np.allclose(values[2:], 0, atol=1e-8)


def genotypes(spark, x, contig="chr1", step=100):
    """A call set of an array of variants x samples; -1: an entry without a call, -2: no entry."""
    cells = [(contig, (i + 1) * step, ["A", "G"], f"s{j:04}", None if x[i, j] < 0 else int(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j] > -2]
    entries = spark.createDataFrame(cells, "contig string, position int, alleles array<string>, s string, n_alt int")
    variants = spark.createDataFrame([(contig, (i + 1) * step, ["A", "G"]) for i in range(len(x))], "contig string, position int, alleles array<string>")
    return CallSet(variants, spark.createDataFrame([(f"s{j:04}",) for j in range(x.shape[1])], "s string"), entries)


@pytest.mark.parametrize("size", [512, 4])
def test_ld_pairs_by_brute_force(spark, monkeypatch, size):
    """Blocks of any size, columns in any strips, missing calls and variants of one genotype."""
    monkeypatch.setattr(linear, "LD_VARIANTS", size)
    rng = np.random.default_rng(12)
    x = rng.integers(0, 3, (37, 21))
    x[1], x[2] = x[0], 2 - x[0]
    x[9] = 1
    x[rng.random(x.shape) < 0.1] = -1
    x[rng.random(x.shape) < 0.1] = -2
    want = {}
    for a in range(37):
        for b in range(a + 1, 37):
            if (b - a) * 100 > 700:
                continue
            called_a, called_b = x[a] >= 0, x[b] >= 0
            da, db = np.where(called_a, x[a] - x[a][called_a].mean(), 0), np.where(called_b, x[b] - x[b][called_b].mean(), 0)
            norm = (da**2).sum() * (db**2).sum()
            if norm > 1e-9 and (da @ db) ** 2 / norm > 0.1:
                want[(a + 1) * 100, (b + 1) * 100] = (da @ db) ** 2 / norm
    got = {(r["position"], r["position_2"]): r["r2"] for r in linear.ld_pairs(genotypes(spark, x), r2_thresh=0.1, bp_window_size=700).collect()}
    assert got.keys() == want.keys() and len(want) > 10 and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def thin(rng, m, n, *shares):
    """m rows of n samples, called in the given shares by turns, at least twice; -2: no entry."""
    x = rng.integers(0, 3, (m, n))
    for k in range(m):
        wanted = max(2, int(n * shares[k % len(shares)]))
        x[k, rng.permutation(n)[wanted:]] = -2
    return x


def test_rows_take_no_more_bytes_than_their_calls(spark):
    x = thin(np.random.default_rng(21), 12, 400, 0.01, 0.9)
    cs = genotypes(spark, x)
    sizes = {(r["position"] // 100 - 1): (r["n_called"], len(r["codes"])) for r in packed.packed_rows(cs, packed.sample_names(cs), polymorphic=False).collect()}
    assert all(sizes[k] == ((4, 16) if k % 2 == 0 else (360, 100)) for k in range(12))


@pytest.mark.parametrize("shares", [(0.04,), (0.04, 0.7)])
def test_ld_pairs_of_thin_rows_by_brute_force(spark, monkeypatch, shares):
    monkeypatch.setattr(linear, "LD_VARIANTS", 4)
    x = thin(np.random.default_rng(22), 30, 90, *shares)
    value = np.array([np.where(r >= 0, r - r[r >= 0].mean(), 0) for r in x])
    norm = np.outer((value**2).sum(1), (value**2).sum(1))
    r2 = np.divide((value @ value.T) ** 2, norm, out=np.zeros_like(norm), where=norm > 1e-9)
    want = {((a + 1) * 100, (b + 1) * 100): r2[a, b] for a in range(30) for b in range(a + 1, min(30, a + 9)) if r2[a, b] > 0.01}
    got = {(r["position"], r["position_2"]): r["r2"] for r in linear.ld_pairs(genotypes(spark, x), r2_thresh=0.01, bp_window_size=800).collect()}
    assert got.keys() == want.keys() and len(want) > 5 and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_kinship_by_brute_force(spark, monkeypatch):
    """Strips of four samples and small blocks, against whole matrices."""
    monkeypatch.setattr(linear, "STRIP_SAMPLES", 4)
    rng = np.random.default_rng(7)
    x = rng.binomial(2, rng.uniform(0.05, 0.95, 60)[:, None], (60, 11))
    x[:, 10] = x[:, 3]
    x[rng.random(x.shape) < 0.08] = -1
    cs = genotypes(spark, x)
    score = rng.standard_normal((11, 2))
    scores = spark.createDataFrame([(f"s{j:04}", [float(v) for v in score[j]]) for j in range(11)], "s string, scores array<double>")
    called = x >= 0
    af = np.array([x[i][called[i]].mean() / 2 for i in range(60)])
    keep = (af > 0) & (af < 1)
    x, called, af = x[keep], called[keep], af[keep]
    design = np.column_stack([np.ones(11), score])
    mu = np.where(called, x, 2 * af[:, None]) @ np.linalg.pinv(design).T @ design.T / 2
    good = called & (mu > 0.01) & (mu < 0.99)
    r, spread = np.where(good, x - 2 * mu, 0), np.where(good, np.sqrt(np.clip(mu * (1 - mu), 0, None)), 0)
    want = (r.T @ r) / (4 * spread.T @ spread)
    got = {(p["s_1"], p["s_2"]): p["kinship"] for p in linear.kinship(cs, scores).collect()}
    assert got.keys() == {(f"s{i:04}", f"s{j:04}") for i in range(11) for j in range(i + 1, 11)}
    assert all(got[f"s{i:04}", f"s{j:04}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(11) for j in range(i + 1, 11))


def test_ld_prune_of_thin_rows_writes_no_more_bytes_than_their_calls(spark, monkeypatch):
    x = thin(np.random.default_rng(26), 60, 400, 0.01)
    sizes, written = {}, linear.written

    def weighed(df, where, **options):
        out = written(df, where, **options)
        name = where.rsplit("/", 1)[1]
        if name in ("rows", "blocks"):
            codes = out.select("codes") if name == "rows" else out.select(F.explode("rows.codes").alias("codes"))
            sizes[name] = codes.agg(F.sum(F.octet_length("codes"))).first()[0]
        return out

    monkeypatch.setattr(linear, "written", weighed)
    cs = genotypes(spark, x)
    kept = {r["position"] // 100 - 1 for r in linear.ld_prune(cs, r2_thresh=0.01, bp_window_size=2000).collect()}
    value = np.array([np.where(r >= 0, r - r[r >= 0].mean(), 0) for r in x])
    norm = (value**2).sum(1)
    near = (value @ value.T) ** 2 > 0.01 * np.outer(norm, norm) + 1e-12
    near &= np.abs(np.subtract.outer(np.arange(60), np.arange(60))) <= 20
    np.fill_diagonal(near, False)
    assert near.any() and not near[np.ix_(sorted(kept), sorted(kept))].any() and all(k in kept or near[k, sorted(kept)].any() for k in range(60))
    assert sizes.keys() == {"rows", "blocks"} and max(sizes.values()) <= 4 * 4 * 60


@pytest.mark.parametrize("shares", [(1.0,), (0.05,), (0.05, 0.6)])
def test_kinship_of_blocks_that_are_parts_of_a_batch(spark, monkeypatch, shares):
    """Full and thin rows in small blocks and strips, a strip without a call among them; all pairs, and those from a threshold on."""
    for module, name, value in ((packed, "CELLS", 3 * 90), (packed, "CALLS", 11), (linear, "STRIP_SAMPLES", 16), (linear, "PRODUCTS", 5)):
        monkeypatch.setattr(module, name, value, raising=False)
    rng = np.random.default_rng(25)
    x = thin(rng, 40, 90, *shares)
    if shares == (0.05,):
        x[:, 32:48] = -2
        x = x[(x >= 0).any(1)]
    cs, score = genotypes(spark, x), rng.standard_normal((90, 2)) / 10
    af = np.array([r[r >= 0].mean() / 2 for r in x])
    x, af = x[(af > 0) & (af < 1)], af[(af > 0) & (af < 1)]
    design = np.column_stack([np.ones(90), score])
    mu = np.where(x >= 0, x, 2 * af[:, None]) @ np.linalg.pinv(design).T @ design.T / 2
    good = (x >= 0) & (mu > 0.01) & (mu < 0.99)
    r, spread = np.where(good, x - 2 * mu, 0), np.where(good, np.sqrt(np.clip(mu * (1 - mu), 0, None)), 0)
    bottom = 4 * spread.T @ spread
    want = np.divide(r.T @ r, bottom, out=np.zeros_like(bottom), where=bottom > 0)
    scores = spark.createDataFrame([(f"s{j:04}", [float(v) for v in score[j]]) for j in range(90)], "s string, scores array<double>")
    got = {(p["s_1"], p["s_2"]): p["kinship"] for p in linear.kinship(cs, scores).collect()}
    assert got.keys() == {(f"s{i:04}", f"s{j:04}") for i in range(90) for j in range(i + 1, 90)}
    assert all(got[f"s{i:04}", f"s{j:04}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(90) for j in range(i + 1, 90))
    near = {(p["s_1"], p["s_2"]) for p in linear.kinship(cs, scores, min_kinship=0.1).collect()}
    assert near == {k for k, v in got.items() if v >= 0.1} and near


def test_components_of_missing_calls_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packed, "FAN_IN", 2)
    monkeypatch.setattr(packed, "SUM_NUMBERS", 7)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (50, 13))
    x[rng.random(x.shape) < 0.1] = -1
    called = x >= 0
    p = np.array([row[c].mean() / 2 for row, c in zip(x, called)])
    z = np.where(called, (x - 2 * p[:, None]) / np.sqrt(2 * p * (1 - p))[:, None], 0) / np.sqrt(50)
    _, sigma, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["pcs"]["scores"] for r in linear.compute_pcs(genotypes(spark, x), k=4).orderBy("s").collect()])
    assert np.allclose(np.abs(got), np.abs(vt[:4].T * sigma[:4]), atol=1e-8)
    none = genotypes(spark, x).only_variants(genotypes(spark, x).variants.where("false"))
    assert all(r["pcs"]["scores"] == [0.0] * 2 for r in linear.compute_pcs(none, k=2).collect())


@pytest.mark.parametrize("shares", [(1.0,), (0.05,), (0.05, 0.6)])
def test_components_of_blocks_that_are_parts_of_a_batch(spark, monkeypatch, shares):
    """Full and thin rows, cut into blocks of a few rows."""
    monkeypatch.setattr(packed, "CELLS", 3 * 90)
    monkeypatch.setattr(packed, "CALLS", 11)
    x = thin(np.random.default_rng(23), 50, 90, *shares)
    af = np.array([r[r >= 0].mean() / 2 for r in x])
    x, af = x[(af > 0) & (af < 1)], af[(af > 0) & (af < 1)]
    z = np.where(x >= 0, (x - 2 * af[:, None]) / np.sqrt(2 * af * (1 - af))[:, None], 0) / np.sqrt(len(x))
    _, sigma, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["pcs"]["scores"] for r in linear.compute_pcs(genotypes(spark, x), k=3).orderBy("s").collect()])
    assert np.allclose(np.abs(got), np.abs(vt[:3].T * sigma[:3]), atol=1e-7)


def test_the_basis_of_components_is_bounded(monkeypatch):
    """A spectrum of many equal values, searched within few columns: as few vectors are held, and none is multiplied anew."""
    rng, seen = np.random.default_rng(24), []
    values = np.repeat(np.linspace(1, 0.5, 100), 9)
    vectors = np.linalg.qr(rng.standard_normal((900, 900)))[0]
    monkeypatch.setattr(linear, "BASIS_COLUMNS", 150, raising=False)
    monkeypatch.setattr(linear, "BASIS_BYTES", 150 * 900 * 8)

    def product(block):
        seen.append(block)
        return vectors @ (values[:, None] * (vectors.T @ block))

    found, at = linear.leading_eigenvectors(product, 900, 4)
    assert np.allclose(found, 1) and np.linalg.norm(product(at) - at * found) < 1e-8
    met = np.hstack(seen[:5])
    assert np.allclose(met.T @ met, np.eye(met.shape[1]), atol=1e-8) and len(seen) < 90


def test_bucketed_call_sets_are_joined_in_place(spark, tmp_path):
    """No entry is shuffled for the join, nor for its variants, and the counts are those of the same call sets unbucketed."""
    rng = np.random.default_rng(11)
    exo, imp = (genotypes(spark, rng.integers(-2, 3, (60, 9))) for _ in range(2))
    stored = []
    for name, cs in (("e", exo), ("i", imp)):
        sinks.write_call_set(cs, f"file://{tmp_path}/{name}.cs", buckets=6)
        stored.append(call_sets.load(spark, f"file://{tmp_path}/{name}.cs"))
        assert len([f for f in (tmp_path / f"{name}.cs" / "entries").iterdir() if f.name.endswith(".parquet")]) == 6
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(joint.joined_entries(*stored)) and "Exchange" in plan(joint.joined_entries(exo, imp))
        cells = _Joined(*stored, [], [], joint.JoinType.inner).cells
        # of what is shuffled, nothing is read from the entries
        shuffled = [part.split("FileScan")[1].split("\n")[0] for part in plan(cells).split("Exchange hashpartitioning")[1:]]
        assert shuffled and not any("n_alt" in scan for scan in shuffled) and "n_alt" in plan(cells).split("ReadSchema", 1)[1]
        rows = lambda a, b: sorted(map(str, global_concordance(a, b).df.collect()))
        assert rows(*stored) == rows(exo, imp)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    sinks.write_call_set(imp, f"file://{tmp_path}/e.cs", overwrite=True)
    assert call_sets.load(spark, f"file://{tmp_path}/e.cs").entries.count() == imp.entries.count()


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb
chr1\t10\t.\tA\tG\t50\tPASS\tQUALapprox=70\tGT:AD:DP:GQ\t0/1:5,6:11:40\t./.:.:.:.
chr1\t20\t.\tC\tT,CA\t.\tLowQual;X\tRAF=0.5\tLGT:LA:GP\t0|1:0,2:0.1,0.8,0.1\t1/1:0,1:.
chrX\t30\t.\tG\t.\t.\t.\t.\tGT\t0\t1
"""


@pytest.mark.parametrize("suffix", [".vcf", ".vcf.gz", ".vcf.bgz"])
def test_vcf(spark, tmp_path, suffix):
    path = tmp_path / f"x{suffix}"
    data = VCF.encode()
    path.write_bytes(data if suffix == ".vcf" else gzip.compress(data[:120]) + gzip.compress(data[120:]))
    cs = call_sets.load(spark, f"file://{path}")
    v = {r["position"]: r for r in cs.variants.collect()}
    assert v[10]["filters"] == [] and v[20]["filters"] == ["LowQual", "X"] and v[30]["filters"] is None and v[10]["qual_approx"] == 70 and v[20]["raf"] == 0.5
    assert v[20]["alleles"] == ["C", "T", "CA"] and v[30]["alleles"] == ["G"]
    e = {(r["position"], r["s"]): r for r in cs.entries.collect()}
    assert e[10, "a"]["n_alt"] == 1 and e[10, "a"]["ad"] == [5, 6] and e[10, "b"]["n_alt"] is None and e[10, "b"]["ad"] is None
    assert e[20, "a"]["gt"] == [0, 2] and e[20, "b"]["gt"] == [1, 1] and e[20, "a"]["gp"] == [0.1, 0.8, 0.1] and e[30, "b"]["gt"] == [1]
    assert cs.samples.orderBy("col_idx").first()["s"] == "a"


def test_round_trips(spark, tmp_path):
    cs = call_set(spark, [(1, "a", 0), (1, "b", 1), (2, "a", 2), (2, "b", None), (3, "b", 2), (3, "a", 0), (4, "c", 1)])
    called = sorted((r["position"], r["s"], r["n_alt"]) for r in cs.entries.where("n_alt is not null").collect())
    back = lambda c: sorted((r["position"], r["s"], r["n_alt"]) for r in c.entries.where("n_alt is not null").collect())
    sinks.write_call_set(cs, f"file://{tmp_path}/x.cs")
    assert back(call_sets.load(spark, f"file://{tmp_path}/x.cs", n_partitions=2)) == called
    sinks.write_call_set(cs, f"file://{tmp_path}/y.cs")
    assert call_sets.load(spark, f"file://{tmp_path}/*.cs").variants.count() == 8
    sinks.write_plink(cs, f"file://{tmp_path}/p")
    plink = call_sets.load(spark, f"file://{tmp_path}/p")
    assert back(plink) == called and plink.variants.orderBy("position").first()["alleles"] == ["A", "G"]
    header, lines = sinks.vcf_lines(cs)
    (tmp_path / "z.vcf").write_text("\n".join(header + [r["line"] for r in lines.orderBy("position").collect()]) + "\n")
    assert back(call_sets.load(spark, f"file://{tmp_path}/z.vcf")) == called
    assert back(call_sets.load(spark, sinks.write_vcf(cs, f"file://{tmp_path}/w.vcf.bgz"))) == called
    with pytest.raises(ValueError, match="no call set"):
        call_sets.load(spark, f"file://{tmp_path}/nothing")


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\nchr1\t5\t9\nchrUn\t1\t2\nchr2\t9\t3\n")
    assert [tuple(r) for r in call_sets.read_bed(spark, f"file://{tmp_path}/a.bed").collect()] == [("chr1", 5, 9)]
    with pytest.raises(Exception, match="not an interval"):
        call_sets.read_bed(spark, f"file://{tmp_path}/a.bed", skip_invalid=False).collect()


def test_whole_concordance_analysis(spark, tmp_path):
    exo, imp = call_set(spark, CELLS["exo"]), call_set(spark, CELLS["imp"])
    out = f"file://{tmp_path}/out"
    made = compare(exo, imp, out, options={"exome_mac", "gq"}, global_conc=True, sample_conc=True, variant_conc=True)
    assert set(made) == {"global", "sample", "variant"}
    assert {p.name for p in (tmp_path / "out/global-results").iterdir() if p.suffix == ".tsv"} == {"ALL_ALL.tsv", "ALL_GQ.tsv", "exo_mac_ALL.tsv", "exo_mac_GQ.tsv"}
    assert (tmp_path / "out/sample-results/ALL_ALL.tsv").exists() and (tmp_path / "out/variant-results/ALL_GQ.tsv").exists()
    with pytest.raises(ValueError, match="has no info"):
        compare(exo, imp, out, options={"info"})


def test_incremental_counts(spark, tmp_path):
    cells = [(i % 5, i % 4, "x" if i % 3 else "y") for i in range(60)]
    for k in range(3):
        spark.createDataFrame(cells[k * 20 : k * 20 + 20], "l int, r int, g string").write.parquet(f"file://{tmp_path}/in/{k}.parquet")
    stream = spark.readStream.schema("l int, r int, g string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    incremental.start(stream, f"file://{tmp_path}/totals", f"file://{tmp_path}/ckpt", "g").awaitTermination(120)
    got = {r["g"]: r["HOMREF_HOMREF"] for r in incremental.read_totals(spark, f"file://{tmp_path}/totals", "g").collect()}
    assert got == {g: sum(c == (2, 2, g) for c in cells) for g in "xy"}


def test_joint_call_set(spark):
    exo = call_set(spark, [(1, "a", 1), (1, "b", 0), (2, "a", 2), (3, "c", 1)])
    imp = call_set(spark, [(1, "a", 1), (2, "b", 0), (4, "d", 1)])
    with JointCallSet(exo, imp) as both:
        assert both.n_sample_overlaps() == 2 and both.n_variant_overlaps() == 2
        assert both.variant_overlaps() is both.variant_overlaps() and both.variant_overlaps().is_cached
        kept = both.sample_overlaps()
        assert {tuple(r) for r in kept.collect()} == {("a", True, True), ("b", True, True), ("c", True, False), ("d", False, True)}
        assert both.global_concordance().get_view().result().equals(global_concordance(exo, imp).get_view().result())
        assert both.sample_concordance().df.count() == 2 and both.variant_concordance(join_type="outer").df.count() == 4
    assert not kept.is_cached
    both.close()
    with pytest.raises(ValueError, match="closed"):
        both.n_sample_overlaps()
    twice = exo.with_(samples=exo.samples.union(exo.samples.limit(1)))
    with pytest.raises(ValueError, match="duplicate sample ids"):
        JointCallSet(twice, imp)
    with pytest.raises(ValueError, match="duplicate sample ids in the imputation"):
        global_concordance(exo, twice)


def test_entry_point_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    from allelarium.plans.queries import QUERIES, SQL

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("allelarium.llm") or name == "corpus_pipeline" else found(name, *a))
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)


def test_no_pair_of_samples_from_a_high_kinship(spark):
    entries = [("1", 100 + v, ["A", "C"], f"s{i}", (v * 7 + i * i) % 3) for v in range(12) for i in range(4)]
    entries = spark.createDataFrame(entries, "contig string, position int, alleles array<string>, s string, n_alt int")
    cs = CallSet(entries.select(*VARIANT).distinct(), entries.select("s").distinct(), entries)
    scores = spark.createDataFrame([(f"s{i}", [0.0]) for i in range(4)], "s string, scores array<double>")
    every = {(r["s_1"], r["s_2"]): r["kinship"] for r in linear.kinship(cs, scores).collect()}
    assert sorted(every) == [(f"s{i}", f"s{j}") for i in range(4) for j in range(i + 1, 4)]
    some = linear.kinship(cs, scores, min_kinship=0.0).collect()
    assert {(r["s_1"], r["s_2"]) for r in some} == {p for p, k in every.items() if k >= 0}
    assert linear.kinship(cs, scores, min_kinship=9.0).count() == 0
