"""Nulls, empty and very long texts, repeated rows, empty tables, and extra columns with clashing names; and plain versions of learned operators."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cytoframe.llm import bpe, masked_lm, mixing, near_dup, quality_model, token_count, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that results, or steps inside, have too.
CLASH = "n_tokens string, score int, size string, host string, node int, _row int, component_id string, x int, n int, h int, verdict string, target int, _k0 int, key string, count int"
LONG = "some words that go on " * 60_000


def frame(spark, rows, table="doc_id long, text string, source string"):
    return spark.createDataFrame([(*r, *([None] * (CLASH.count(",") + 1))) for r in rows], f"{table}, {CLASH}")


ROWS = [(1, "a few words of text here", "a"), (1, "a few words of text here", "a"), (2, None, None), (None, "", "b"), (None, " \t", "b"), (3, LONG, "a"), (4, "漢字 é ***", None)]
OPERATORS = {
    "op1": lambda df: bpe.encode_documents(df), "op3": lambda df: mixing.mix(df), "op5": lambda df: token_count.count_tokens(df), "op8": lambda df: near_dup.near_duplicates(df),
    "op9": lambda df: masked_lm.score_documents(df), "op10": lambda df: quality_model.classify(df, df.sparkSession.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_long_texts_and_repeats(spark, name):
    f = OPERATORS[name]
    got, plain = f(frame(spark, ROWS)).collect(), f(spark.createDataFrame(ROWS, "doc_id long, text string, source string")).collect()
    assert len(got) == len(ROWS) and sorted(map(str, got)) == sorted(map(str, plain))
    assert len({str(g) for g in got if g.doc_id == 1}) == 1 or name == "op3"  # repeated rows are treated alike; in a mix they follow each other
    assert f(frame(spark, [])).collect() == []


def test_stages_keep_clashing_columns(spark):
    df = frame(spark, [r for r in ROWS if r[1]] * 2)
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    for f in (lambda d: quality_model.keep_good(d, labels), near_dup.keep_one, mixing.repeat_documents):
        got = f(df)
        assert got.columns == df.columns and got.count() >= 1 and f(df.limit(0)).collect() == []


def test_urls_of_odd_kinds(spark):
    rows = [(1, "http://x.org/a"), (1, "http://x.org/a"), (None, None), (2, ""), (3, "http://very." + "long" * 20_000 + ".net/" + "p" * 50_000), (4, "http://é.漢/É"), (5, "http://y.com/de/q"), (6, "http://z.net/")]
    df = frame(spark, rows, "page_id long, url string")
    got = url_filter.judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    got = got.collect()
    assert len(got) == len(rows) and len({str(g) for g in got if g.page_id == 1}) == 1 and all(g.verdict in ("allow", "block") for g in got)
    assert {g.page_id: len(g.host) for g in got}[3] == 80_009 and url_filter.judge(df.limit(0)).collect() == []


def test_cut_has_the_least_errors():
    r = random.Random(8)
    for _ in range(30):
        rows = [(b, r.randint(0, 9) if b > -3 else r.randint(0, 1), r.randint(0, 9) if b < 4 else r.randint(0, 1)) for b in r.sample(range(-12, 13), 14)]
        allowed, blocked = sum(x[1] for x in rows), sum(x[2] for x in rows)
        loss = lambda cut: sum(x[1] for x in rows if x[0] < cut) / allowed + sum(x[2] for x in rows if x[0] >= cut) / blocked
        best = min(range(-url_filter.BINS // 2, url_filter.BINS // 2 + 1), key=lambda c: (round(loss(c), 12), abs(c)))
        got = round(url_filter.cut_of(rows) / 0.02)
        assert math.isclose(loss(got), loss(best), abs_tol=1e-9)
    assert url_filter.cut_of([(3, 5, 0)]) == 0.0 and url_filter.cut_of([]) == 0.0


def test_verdicts_follow_score_and_cut(spark):
    r = random.Random(2)
    rows = [(i, f"http://{r.choice(['casino', 'poker'])}{i}.com/de/{i}") for i in range(60)] + [(100 + i, f"http://{r.choice(['garden', 'school'])}{i}.com/fr/{i}") for i in range(60)]
    rows += [(300 + i, f"http://{r.choice(['casino', 'garden', 'poker', 'school', 'x'])}{i}.net/{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    ruled = spark.createDataFrame([(u, "block" if "/de/" in u else "allow") for _, u in rows if ".com/" in u], "url string, verdict string")
    _, cut = url_filter.fit(ruled)
    for g in url_filter.judge(df).where("rule is null").collect():
        assert g.verdict == ("block" if g.score < cut else "allow")


def plain_features(text):
    """FEATURES of one text, without arrays."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n, some, letters = len(words), max(1, len(words)), max(1, sum(map(len, words)))
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    symbols = b"#*$%&|<>"
    runs = [tuple(words[i : i + 8]) for i in range(n - 7)] if n > 8 else []
    lines = [tuple(w) for line in raw.split(b"\n") if (w := [x for x in re.split(rb"[\x20\x09-\x0D]+", line) if x])]
    return [
        math.log1p(n), sum(map(len, words)) / some if n else 1.0, count(symbols) / some, count(b"!") / some, count(bytes(range(65, 91))) / letters, sum(a == b for a, b in zip(words, words[1:])) / some,
        (len(runs) - len(set(runs))) / some, (len(lines) - len(set(lines))) / max(1, len(lines)), count(bytes(range(48, 58))) / letters, count(b".") / some, count(b",") / some, count(b"|") / some,
        count(bytes(range(0xC0, 0x100))) / letters, math.log1p(n / (raw.count(b"\n") + 1)), len(set(words)) / some, sum(len(w) <= 2 for w in words) / some, sum(len(w) >= 14 for w in words) / some,
        sum(any(c in symbols for c in w) for w in words) / some,
    ]


def test_features_match_plain_ones():
    r = random.Random(3)
    texts = ["".join(r.choice(["a ", "bc ", "B! ", "é, ", "x*| ", "12. ", "\n", "\t", "longerthanfourteen ", "q q q q q q q q q "]) for _ in range(r.randint(0, 80))) for _ in range(150)] + [None, "", " \n ", "one", "same\nsame\nsame"]
    got = quality_model.features_of(pa.array(texts))
    assert np.allclose(got, [plain_features(t) for t in texts])


def plain_tree(g, h, depth):
    """The best split of bins, again and again; ties to the first."""
    total = sum(g) ** 2 / (sum(h) + 1)
    best, at = total + 1e-9, None
    for k in range(1, len(g)) if depth else ():
        gain = sum(g[:k]) ** 2 / (sum(h[:k]) + 1) + sum(g[k:]) ** 2 / (sum(h[k:]) + 1)
        if gain > best + 1e-12:
            best, at = gain, k
    if at is None:
        return [sum(g) / (sum(h) + 1)] * len(g)
    return plain_tree(g[:at], h[:at], depth - 1) + plain_tree(g[at:], h[at:], depth - 1)


def test_cyclic_boosting_matches_a_plain_one(monkeypatch):
    monkeypatch.setattr(quality_model, "ROUNDS", 4)
    monkeypatch.setattr(quality_model, "PAIRS", 0)
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (90, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + r.normal(0, 0.3, 90) > 0.4).astype(float)
    model = quality_model.fit(x, y)
    bins = [[sum(e <= v for e in model.edges[j]) for v in x[:, j]] for j in range(3)]
    share = (y.sum() + 0.5) / 91
    bias = math.log(share / (1 - share))
    logit, tables = [bias] * 90, [[0.0] * (quality_model.BINS + 1) for _ in range(3)]
    for _ in range(4):
        for j in range(3):
            p = [1 / (1 + math.exp(-v)) for v in logit]
            g, h = [0.0] * (quality_model.BINS + 1), [0.0] * (quality_model.BINS + 1)
            for i, b in enumerate(bins[j]):
                g[b] += y[i] - p[i]
                h[b] += p[i] * (1 - p[i])
            for b, v in enumerate(plain_tree(g, h, quality_model.DEPTH)):
                tables[j][b] += quality_model.RATE * v
            logit = [bias + sum(tables[k][bins[k][i]] for k in range(3)) for i in range(90)]
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in logit], atol=1e-9)


def test_pair_tree_is_the_best_of_all():
    r = np.random.default_rng(6)
    for _ in range(20):
        g, h = r.normal(0, 1, (5, 5)), r.random((5, 5))
        table, gain = quality_model.pair_leaves(g, h)
        part = lambda a, b: g[a, b].sum() ** 2 / (h[a, b].sum() + 1)
        best = max(sum(part(rows, slice(0, c)) + part(rows, slice(c, 5)) for rows, c in ((slice(0, a), b), (slice(a, 5), d))) for a in range(1, 5) for b in range(1, 5) for d in range(1, 5))
        assert math.isclose(gain, best, rel_tol=1e-9)
        assert math.isclose(sum(g[table == v].sum() ** 2 / (h[table == v].sum() + 1) for v in np.unique(table)), best, rel_tol=1e-9)


def test_pairs_and_bins_add_up():
    model = quality_model.Gam([np.array([0.0, 1.0]), np.array([5.0])], 0.25, np.array([[0.1, 0.2, 0.3], [1.0, 2.0, 0.0]]), [(1, 0)], [np.arange(9.0).reshape(3, 3)])
    x = np.array([[-1, 4], [0, 5], [0.5, 9], [1, 5], [7, 1]])
    want = [0.25 + 0.1 + 1 + 0, 0.25 + 0.2 + 2 + 4, 0.25 + 0.2 + 2 + 4, 0.25 + 0.3 + 2 + 5, 0.25 + 0.3 + 1 + 2]
    assert np.allclose(model.logit(model.binned(x)), want)


def test_pairs_just_above_the_threshold_are_found(spark):
    """Pairs at a similarity from 0.75 to 0.78: all of them."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(6))
    rows = []
    for i in range(600):
        n = r.choice([40, 90, 200, 500])
        a = [word() for _ in range(n)]
        b, k = list(a), 0
        places = r.sample(range(2, n - 2), n // 4)
        sets = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        own = sets(a)
        while True:  # one word more as long as the pair stays linked
            c = list(b)
            c[places[k]] = word()
            other = sets(c)
            if 100 * len(own & other) < 75 * len(own | other):
                break
            b, k = c, k + 1
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {g.doc_id: g.component_id for g in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(600)) == 600
