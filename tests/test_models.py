"""Statistics and models against brute force and known cases."""

import itertools
import math
import random

import numpy as np
import pytest

from cytoframe.functions import stats
from cytoframe.operators import hmm as H
from cytoframe.operators import models as M
from cytoframe.operators import ordered as O


def test_special_functions():
    x = np.array([0.01, 0.5, 1, 2.5, 10, 123.4])
    assert np.allclose(stats.lgamma_wide(x), [math.lgamma(v) for v in x], atol=1e-10)
    assert np.allclose(stats.digamma(x), [(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x], rtol=1e-5)
    for y in (-5, -1, 0.3, 3):
        assert abs(float(stats.digamma(stats.inverse_digamma(y))) - y) < 1e-8
    assert abs(stats.chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi2_sf(18.307, 10) - 0.05) < 1e-5 and stats.chi2_sf(0, 3) == 1
    assert np.allclose(stats.normal_sf(stats.normal_quantile([0.3, 0.9])), [0.7, 0.1])


def test_fisher_by_enumeration():
    def brute(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        p = {i: math.comb(k, i) * math.comb(n - k, r - i) / math.comb(n, r) for i in range(max(0, r + k - n), min(r, k) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-9))

    for t in itertools.product(range(4), repeat=4):
        if sum(t):
            assert abs(stats.fisher_two_sided(*[np.array([v]) for v in t])[0] - brute(*t)) < 1e-9


def test_normal_tails_and_quantiles():
    from statistics import NormalDist

    x = np.concatenate([np.linspace(-6, 6, 999), np.linspace(6, 26, 99)])
    assert np.allclose(stats.erfc(x), [math.erfc(v) for v in x], rtol=1e-10, atol=0)
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 500), 10.0 ** -np.arange(1, 12)])
    assert np.allclose(stats.normal_quantile(p), [NormalDist().inv_cdf(v) for v in p], atol=1e-9)


def test_chi2_tails_agree():
    x = np.array([0, 0.01, 0.5, 3, 9, 40, 200.0])
    for k in range(1, 25):
        assert np.allclose(stats.chi2_tails(x, np.full(len(x), k)), [stats.chi2_sf(v, k) for v in x], rtol=1e-7, atol=1e-13)


def plain_alleles(reads, width, rounds=10):
    """One window, read by read."""
    c = np.array([[i - o >= 0 and i - o < len(s) and s[i - o] == "C" for i in range(width)] for s, o in reads], float)
    t = np.array([[i - o >= 0 and i - o < len(s) and s[i - o] == "T" for i in range(width)] for s, o in reads], float)
    clip = lambda a: np.clip(a, 1e-12, 1 - 1e-12)
    like = lambda a: c @ np.log(clip(a)) + t @ np.log(1 - clip(a))
    one = ((c.sum(0) + 1e-10) / ((c + t).sum(0) + 2e-10))
    a, b, before = np.full(width, 0.25), np.full(width, 0.75), -np.inf
    for _ in range(rounds):
        la, lb = like(a), like(b)
        both = np.logaddexp(la, lb)
        w = np.exp(la - both)
        score = both.sum() + len(c) * np.log(0.5)
        w = w * (0.5 / w.mean()) if w.mean() > 0.5 else 1 - (1 - w) * (0.5 / (1 - w.mean()))
        if score - before <= 1e-10 * abs(score):
            break
        before = score
        a, b = ((w @ c + 5e-11) / (w @ (c + t) + 1e-10)), (((1 - w) @ c + 5e-11) / ((1 - w) @ (c + t) + 1e-10))
    used = np.flatnonzero((c + t).sum(0))
    return stats.chi2_sf(2 * float((np.logaddexp(like(a), like(b)) + np.log(0.5)).sum() - like(one).sum()), int(used.max() - used.min()) + 1)


def test_windows_together_as_one_by_one(spark):
    r = random.Random(7)
    rows = []
    for i in range(400):
        pos = r.randint(0, 90)
        allele = r.random() < 0.5
        rows.append(("c", pos, "".join("N" if r.random() < 0.1 else ("C" if (r.random() < (0.9 if allele else 0.1)) == (pos > 20) or (pos <= 20 and r.random() < 0.5) else "T") for _ in range(r.randint(1, 12)))))
    got = {x.w: x for x in M.window_tests(spark.createDataFrame(rows, "chrom string, pos long, seq string"), 10, 40).collect()}
    assert len(got) > 60
    for w, x in got.items():
        own = [(s[max(0, w - p) : max(0, w + 10 - p)], max(p - w, 0)) for _, p, s in rows if p < w + 10 and p + len(s) > w]
        assert x.reads == len(own) and sum(len(s) for s, _ in own) >= 40
        assert math.isclose(x.score, plain_alleles(own, 10), rel_tol=1e-5, abs_tol=1e-9), w


def test_sums_of_hypergeometric_terms(monkeypatch):
    def brute(p, q, r, s):
        term = lambda k: math.comb(r + s - 1, k) * math.comb(p + q - 1, p + r - 1 - k) / math.comb(p + q + r + s - 2, p + r - 1)
        return sum(term(k) for k in range(max(0, r - q), r))

    monkeypatch.setattr(stats, "TERMS", 50)
    r = np.random.default_rng(4)
    t = r.integers(1, 40, (4, 300))
    assert np.allclose(stats.hypergeometric_greater(*t), [brute(*map(int, x)) for x in t.T], atol=1e-9)
    assert len(stats.hypergeometric_greater(*np.zeros((4, 0), int))) == 0 and len(stats.fisher_two_sided(*np.zeros((4, 0), int))) == 0
    assert stats.fisher_two_sided(*np.array([[0, 3], [0, 1], [0, 1], [0, 3]])).round(6).tolist() == [1.0, 0.485714]


def test_fit_beta_recovers():
    r = np.random.default_rng(1)
    p = r.beta(2.0, 5.0, 200000)
    a, b = stats.fit_beta(np.log(p).mean(), np.log(1 - p).mean())
    assert abs(a - 2) < 0.05 and abs(b - 5) < 0.15


def test_forward_backward_by_enumeration():
    r = np.random.default_rng(2)
    model = H.Model(np.array([0.3, 0.5, 0.2]), r.dirichlet([1, 1, 1], 3), np.ones((1, 3, 2)), (0, 1, 2), np.zeros((3, 3), bool))
    emit = np.log(r.random((7, 3)))
    start, size = np.array([0, 4, 5]), np.array([4, 1, 2])
    post, moves, score = H.forward_backward(model, emit, start, size)
    want_post, want_moves, want = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for s, n in zip(start, size):
        total = 0.0
        part, trans = np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = model.start[path[0]] * np.prod([model.move[x, y] for x, y in zip(path, path[1:])]) * np.exp(sum(emit[s + i, x] for i, x in enumerate(path)))
            total += w
            for i, x in enumerate(path):
                part[i, x] += w
            for x, y in zip(path, path[1:]):
                trans[x, y] += w
        want_post[s : s + n] = part / total
        want_moves += trans / total
        want += math.log(total)
    assert np.allclose(post, want_post) and np.allclose(moves, want_moves) and abs(score - want) < 1e-9


def test_low_regions_are_found(spark):
    r = random.Random(5)
    rows = []
    for c in "abcd":
        for i in range(400):
            low = 100 <= i < 160 or 300 <= i < 330
            n = r.randint(5, 20)
            m = sum(r.random() < (0.08 if low else 0.85) for _ in range(n))
            rows.append((c, i * 10, [m], [n - m]))
    got = H.low_regions(spark.createDataFrame(rows, "chrom string, pos long, m array<long>, u array<long>"), gap=1000, rounds=6).collect()
    big = sorted((x.chrom, x.start, x.stop) for x in got if x.n > 15)
    assert len(big) == 8
    assert all(abs(s - 1000) <= 30 or abs(s - 3000) <= 30 for _, s, _ in big)


def test_high_regions_are_found(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        n = r.randint(8, 20)
        m = sum(r.random() < (0.9 if 200 <= i < 260 else 0.05) for _ in range(n))
        rows.append(("a", i * 10, [m], [n - m]))
    got = H.high_regions(spark.createDataFrame(rows, "chrom string, pos long, m array<long>, u array<long>"), rounds=6).collect()
    assert any(abs(x.start - 2000) <= 30 and abs(x.stop - 2591) <= 30 and x.kind == "HYPER" for x in got)


def test_regression_matches_a_grid(spark):
    n = np.array([[20, 18, 25, 22.0]])
    m = np.array([[4, 3, 20, 15.0]])
    x = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    w, ll = M.beta_binomial_fit(n, m, x)

    def like(a, b, t):
        s, out = math.exp(-t), 0.0
        for k, v, row in zip(n[0], m[0], x):
            p = 1 / (1 + math.exp(-(a * row[0] + b * row[1])))
            out += math.lgamma(v + p * s) - math.lgamma(p * s) + math.lgamma(k - v + (1 - p) * s) - math.lgamma((1 - p) * s) - math.lgamma(k + s) + math.lgamma(s)
        return out

    best = max(like(a, b, t) for a in np.linspace(0.5, 2, 16) for b in np.linspace(-4, -1.5, 26) for t in np.linspace(-12, -1, 23))
    assert ll[0] >= best - 1e-6
    assert abs(like(w[0][0], w[0][1], max(w[0][2], -12)) - ll[0]) < 1e-6


def test_regression_finds_what_differs_and_skips_what_cannot(spark):
    data = [("c", 1, [20, 20, 20, 20], [2, 3, 17, 18]), ("c", 2, [20, 20, 20, 20], [10, 9, 10, 11]), ("c", 3, [0, 0, 20, 20], [0, 0, 4, 5]), ("c", 4, [9, 9, 9, 9], [9, 9, 9, 9])]
    df = spark.createDataFrame([(*d[:2], "+", "CpG", *d[2:]) for d in data], "chrom string, pos long, strand string, context string, n array<long>, m array<long>")
    got = {r.pos: r.p for r in M.regression(df, [[1, 1], [1, 1], [1, 0], [1, 0]], 1).collect()}
    assert got[1] < 1e-3 and got[2] > 0.5 and got[3] is None and got[4] is None


def test_hydroxy(spark):
    df = spark.createDataFrame([("c", 1, 60, 40, 20, 80, 40, 60), ("c", 2, 90, 10, 50, 50, 60, 40), ("c", 3, 9, 1, 0, 0, 0, 0)], "chrom string, pos long, bs_m long, bs_u long, tab_m long, tab_u long, ox_m long, ox_u long")
    got = {r.pos: r for r in M.hydroxy(df).collect()}
    assert (got[1].p_m, got[1].p_h, got[1].p_u, got[1].conflicts) == (0.4, 0.2, 0.4, 0)
    assert abs(got[2].p_m + got[2].p_h + got[2].p_u - 1) < 1e-5 and got[2].p_m > got[2].p_h
    assert got[3].p_m is None and got[3].conflicts is None
    # the fit is the likeliest: compare with a grid
    def like(pm, ph):
        pu = 1 - pm - ph
        return 90 * math.log(pm + ph) + 10 * math.log(pu) + 50 * math.log(ph) + 50 * math.log(1 - ph) + 60 * math.log(pm) + 40 * math.log(1 - pm)
    best = max(like(a, b) for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if a + b < 0.995)
    assert like(got[2].p_m, got[2].p_h) >= best - 1e-3


def test_allele_specific_windows(spark):
    r = random.Random(7)
    split = [("c", 0, "".join(x if r.random() < 0.95 else "N" for _ in range(10)), i) for i in range(20) for x in ["CT"[i % 2]]]
    mixed = [("d", 0, "".join(r.choice("CT") for _ in range(10)), i) for i in range(20)]
    df = spark.createDataFrame(split + mixed, "chrom string, pos long, seq string, read long")
    got = {r.chrom: r.score for r in M.window_tests(df, 10, 40).where("w = 0").collect()}
    assert got["c"] < 1e-6 and got["d"] > 0.01
    assert {r.chrom for r in M.allele_regions(df).collect()} == {"c"}
    spans = spark.createDataFrame([("c", 0, 10), ("c", 50, 60)], "chrom string, start long, stop long")
    tested = {r.start: (r.reads, r.score) for r in M.region_tests(spans, df).collect()}
    assert tested[0][0] == 20 and tested[0][1] < 1e-6 and tested[50] == (0, 1.0)


@pytest.mark.parametrize("seed", range(2))
def test_adjustment_and_cutoff_by_hand(spark, seed):
    r = random.Random(seed)
    p = [r.choice([0.0, 1.0, 0.5, r.random(), r.random() ** 6]) for _ in range(200)]
    got = {x.i: x.fdr for x in O.adjusted(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    order = sorted(range(200), key=lambda i: p[i])
    low, want = 1.0, {}
    for rank in range(200, 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * 200 / rank)
        want[i] = low
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    s = sorted(p)
    first = next((v for i, v in enumerate(s, 1) if v >= 0.3 * i / 200), None)
    assert O.step_up_cutoff(spark.createDataFrame([(v,) for v in p], "p double"), 0.3).first().cutoff == first


def test_viterbi_by_enumeration_and_parameters_as_json():
    r = np.random.default_rng(9)
    model = H.Model(np.array([0.3, 0.5, 0.2]), r.dirichlet([1, 1, 1], 3), np.ones((1, 3, 2)), (0, 1, 2), np.zeros((3, 3), bool))
    emit = np.log(r.random((8, 3)))
    start, size = np.array([0, 4, 5]), np.array([4, 1, 3])
    got = H.viterbi(model, emit, start, size)
    for s, n in zip(start, size):
        def weight(path, s=s):
            return math.log(model.start[path[0]]) + sum(math.log(model.move[x, y]) for x, y in zip(path, path[1:])) + sum(emit[s + i, x] for i, x in enumerate(path))
        assert tuple(got[s : s + n]) == max(itertools.product(range(3), repeat=int(n)), key=weight)
    again = H.Model.from_json(model.to_json())
    assert np.allclose(again.move, model.move) and again.tie == model.tie


def test_levels_have_the_density_of_the_beta():
    from math import gamma

    p = np.array([0.2, 0.5, 0.9])
    got = H.log_chance(2.5, 4.0, p * 10, (1 - p) * 10, True)
    assert np.allclose(np.exp(got), p**1.5 * (1 - p) ** 3 * gamma(6.5) / gamma(2.5) / gamma(4.0))
    model = H.Model(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.ones((2, 2, 2)) * 2, (0, 1), np.zeros((2, 2), bool), (1,))
    again = H.Model.from_json(model.to_json())
    assert again.arrays == (1,) and H.emissions(again, np.array([[3.0, 2.0]]), np.array([[1.0, 8.0]])).shape == (1, 2)


def test_partly_methylated_domains_of_replicates(spark):
    r = random.Random(4)
    rows, levels = [], []
    for i in range(3000):
        low = 1000 <= i < 1600 or 2200 <= i < 2500
        for s in range(2):
            n = r.randint(3, 12)
            rows.append((s, "a", i * 50, sum(r.random() < (0.3 if low else 0.85) for _ in range(n)), n))
        levels.append(("a", i * 50, min(0.99, max(0.01, r.gauss(0.3 if low else 0.85, 0.08)))))
    df = spark.createDataFrame(rows, "s int, chrom string, pos long, n_meth long, n_reads long")
    own = lambda s: df.where(df.s == s).drop("s")
    sites = H.pooled_arrays([own(0), own(1), spark.createDataFrame(levels, "chrom string, pos long, level double")], arrays=(2,))
    assert H.good_tile(sites, 500, 8, 10) == 500
    got = sorted(H.domain_names(H.partly_methylated(sites, 500, rounds=6, arrays=(2,))).collect(), key=lambda x: x.start)
    big = [x for x in got if x.stop - x.start > 5000]
    assert len(big) == 2 and all(abs(x.start - s) <= 500 and abs(x.stop - e) <= 500 for x, (s, e) in zip(big, ((50_000, 80_000), (110_000, 125_000))))
    assert all(x.start_certainty > 50 and x.start_score > 0 for x in big)
    assert [x.name.split(":")[0] for x in got] == [f"PMD{k}" for k in range(len(got))] and all(len(x.name.split(":")) == 5 for x in got)


def test_boundary_scores_by_hand(spark):
    model = H.Model(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.array([[[2.0, 5.0], [6.0, 2.0]]]), (0, 1), np.zeros((2, 2), bool))
    sites = spark.createDataFrame([("a", p, [m], [u]) for p, m, u in ((80, 8, 2), (95, 7, 3), (100, 1, 9), (110, 3, 7), (190, 2, 8), (205, 9, 1))], "chrom string, pos long, m array<long>, u array<long>")
    x = H.boundary_scores(sites, spark.createDataFrame([("a", 100, 200)], "chrom string, start long, stop long"), model, 0, 30).first()
    beta = lambda p, a, b: p ** (a - 1) * (1 - p) ** (b - 1) * math.gamma(a + b) / math.gamma(a) / math.gamma(b)
    assert math.isclose(x.start_score, beta(4 / 20, 2, 5) * beta(15 / 20, 6, 2), rel_tol=1e-9) and x.start_certainty == 20
    assert math.isclose(x.stop_score, beta(2 / 10, 2, 5) * beta(9 / 10, 6, 2), rel_tol=1e-9) and x.stop_certainty == 10


def test_given_models_are_not_fitted(spark, monkeypatch):
    r = random.Random(5)
    rows = [("a", i * 10, [sum(r.random() < (0.08 if 100 <= i < 160 else 0.85) for _ in range(12))], [0]) for i in range(400)]
    rows = [(c, p, m, [12 - m[0]]) for c, p, m, _ in rows]
    model = H.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[[1.0, 8.0], [8.0, 1.5]]]), (0, 1), np.zeros((2, 2), bool))
    monkeypatch.setattr(H, "train", None)
    got = [x for x in H.low_regions(spark.createDataFrame(rows, "chrom string, pos long, m array<long>, u array<long>"), model=H.Model.from_json(model.to_json())).collect() if x.n > 15]
    assert len(got) == 1 and abs(got[0].start - 1000) <= 30 and abs(got[0].stop - 1591) <= 30


def plain_combination(rows, reach, bin_size):
    """Of (chrom, pos, value): number of neighbours and z, pair by pair."""
    pairs = [(a, b, (b[1] - a[1] - 1) // bin_size) for a in rows for b in rows if a[0] == b[0] and 0 < b[1] - a[1] <= reach + 1]
    r = {}
    for k in {k for *_, k in pairs}:
        x, y = (np.array([p[i][2] for p in pairs if p[2] == k]) for i in (0, 1))
        r[k] = np.corrcoef(x, y)[0, 1] if x.var() * len(x) > 1e-12 and y.var() * len(y) > 1e-12 else 0.0
    out = {}
    for c, p, _ in rows:
        near = [v for d, q, v in rows if d == c and abs(q - p) <= reach + 1]
        extra = sum(r[k] for a, b, k in pairs if a[0] == c and a[1] >= p - reach - 1 and b[1] <= p + reach + 1)
        out[c, p] = len(near), sum(near) / math.sqrt(max(len(near) + 2 * extra, 1e-9))
    return out


@pytest.mark.parametrize(("piece", "reach", "bin_size"), [(1 << 16, 6, 2), (1, 6, 2), (1, 3, 1), (1, 0, 1)])
def test_combination_by_hand(spark, monkeypatch, piece, reach, bin_size):
    monkeypatch.setattr(O, "PIECE", piece)
    r = random.Random(reach)
    rows = [(c, p, r.gauss(0, 1) + math.sin(p / 5)) for c in "ab" for p in sorted(r.sample(range(400), 90 if c == "a" else 40))]
    df = O.combined(spark.createDataFrame(rows, "chrom string, pos long, value double"), reach, bin_size)
    got, want = {(x.chrom, x.pos): (x.n, x.z) for x in df.collect()}, plain_combination(rows, reach, bin_size)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-8, abs_tol=1e-8) for k in want)


def test_combination_lists_no_pairs(spark):
    rows = spark.range(3000).selectExpr("'a' as chrom", "id as pos", "sin(id) as value")
    df = O.combined(rows, 200, 1)  # 3000 sites of which each has 60 000 pairs of neighbours around it
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    x = {x.pos: x for x in df.collect()}
    assert len(x) == 3000 and (x[0].n, x[1500].n, x[2999].n) == (202, 403, 202)
    assert O.combined(rows.limit(0), 200, 1).count() == 0


def test_combination_without_a_place_or_a_neighbour(spark):
    rows = spark.createDataFrame([("a", 5, 1.5), (None, 5, 2.0), ("a", None, 3.0), ("b", 5, -1.0)], "chrom string, pos long, value double")
    assert sorted((str(x.chrom), x.pos or -1, x.n, x.z) for x in O.combined(rows, 10, 2).collect()) == [("None", 5, 1, 2.0), ("a", -1, 1, 3.0), ("a", 5, 1, 1.5), ("b", 5, 1, -1.0)]


def test_adjustment_runs_the_tests_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = spark.range(0, 300, 1, 2).selectExpr("'a' as chrom", "id as pos", "if(id % 9 = 0, 1D, (id % 97 + 0.5) / 100) as p").mapInArrow(count, "chrom string, pos long, p double")
    got = {x.pos: x for x in M.adjust_regression(rows, 20, 5).collect()}
    assert ran.value == 300 and len(got) == 300
    low, tested = 1.0, sorted((x for x in got.values() if x.p < 1), key=lambda x: x.combined)
    assert all((x.combined, x.fdr) == (1, 1) for x in got.values() if x.p == 1) and 0 < len(tested) < 300
    for rank in range(len(tested), 0, -1):
        x = tested[rank - 1]
        low = min(low, x.combined * len(tested) / rank)
        assert math.isclose(x.fdr, low, rel_tol=1e-9)


def test_gamma_and_its_derivatives():
    x = 10.0 ** np.linspace(-10, 7, 300)
    value, first, second = stats.gamma_logs(x)
    assert np.allclose(value, [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11) and np.allclose(first, stats.digamma(x), rtol=1e-11, atol=1e-11)
    assert np.allclose(second - stats.gamma_logs(x + 1)[2], 1 / x**2, rtol=1e-6, atol=1e-9) and math.isclose(stats.gamma_logs(np.ones(1))[2][0], math.pi**2 / 6, rel_tol=1e-12)
    assert stats.gamma_logs(np.zeros(0)).shape == (3, 0)


def test_derivatives_of_the_likelihood_and_rows_on_their_own():
    r = np.random.default_rng(3)
    x = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    n = r.integers(0, 30, (4, 50)).astype(float)
    m = np.floor(n * r.random(n.shape))
    w = np.stack([r.normal(0, 1, 50), r.normal(0, 1, 50), r.normal(-2.5, 1, 50)])
    _, g, h = M.likelihood(w, n, m, x)
    for i in range(3):
        step = 1e-5 * np.eye(3)[i][:, None]
        up, down = M.likelihood(w + step, n, m, x), M.likelihood(w - step, n, m, x)
        assert np.allclose(g[i], (up[0] - down[0]) / 2e-5, rtol=1e-5, atol=1e-5) and np.allclose(h[i], -(up[1] - down[1]) / 2e-5, rtol=1e-5, atol=1e-5)
    v, best = M.beta_binomial_fit(n.T, m.T, x)
    some = r.permutation(50)[:17]
    again = M.beta_binomial_fit(n.T[some], m.T[some], x)
    assert (again[0] == v[some]).all() and (again[1] == best[some]).all()


def test_regression_refuses_rows_of_another_length(spark):
    df = spark.createDataFrame([("c", 1, "+", "CpG", [20, 20, 9], [2, 3, 4]), ("c", 2, "+", "CpG", [20, 20, 9, 9, 9], [2, 3, 4, 5, 6])], "chrom string, pos long, strand string, context string, n array<long>, m array<long>")
    with pytest.raises(Exception, match="one number for each of 4 samples"):
        M.regression(df, [[1, 1], [1, 1], [1, 0], [1, 0]], 1).collect()
