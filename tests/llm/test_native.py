"""Mixing, quality rules and URL filters."""

import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from cytoframe.llm import mixing, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def goals(sizes):
    """Targets by repeated resharing; sizes in order of source."""
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sizes)}
    total, free, out = sum(sizes.values()), set(sizes), {}
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * weight[s] / w for s in free}
            break
        out |= {s: 3 * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 60]))) if r.random() < 0.95 else None, r.choice(["b", "B", "é", None, "a", "hot", "hot", "hot", "tiny" if r.random() < 0.1 else "c"])) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS))
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got) and "CartesianProduct" not in plan_of(got)
    got = got.collect()
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, k in rows if k == s) for s in sorted({k for *_, k in rows if k is not None})} | {None: sum(len(WORD.findall(t or "")) for _, t, k in rows if k is None)}
    want = goals(sizes)
    for s in sizes:
        own = [g for g in got if g.source == s]
        assert all(g.source_size == sizes[s] and abs(g.target - want[s]) < 1e-6 for g in own)
        assert abs(sum(g.taken for g in own) - want[s]) <= 2
    assert all(0 <= g.taken <= 3 * g.size for g in got) and len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()), key=str)


def test_apportionment_is_by_highest_quotients(spark):
    r = random.Random(7)
    rows = [(g, i, r.choice([0, 1, 3, 3, 40, r.randint(1, 999)]), seats) for g, n, seats in (("x", 12, 37), ("y", 1, 5), ("z", 30, 4)) for i in range(n)]
    got = {(x.g, x.i): x.quota for x in mixing.apportion(spark.createDataFrame(rows, "g string, i int, v long, s long"), ["g"], "v", "s", ["i"]).collect()}
    for g in "xyz":
        own = [(i, v, s) for k, i, v, s in rows if k == g]
        best = sorted(((-v / (2 * k + 1), i, k) for i, v, s in own for k in range(s) if v))[: own[0][2]]
        assert all(got[(g, i)] == sum(b[1] == i for b in best) for i, *_ in own)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert [(g.size, g.target, g.taken) for g in got] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_repeated_documents_keep_columns(spark):
    rows = [(i, "w " * 50, "abc"[i % 3], i) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS + ", taken int")
    got = mixing.repeat_documents(df)
    assert got.columns == df.columns
    by = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(by["a"] - 5) <= 1 and abs(by["b"] - 10) <= 1 and abs(by["c"] - 15) <= 1


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice([*"ab#*|<é", " ", " ", "\n", "\t", "\xa0", "x y z "]) for _ in range(r.randint(0, 120)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "a " * 8), (903, "a " * 9), (904, "p q r s t u v w " * 3), (905, "same\nsame\n\n \nsame "), (906, "x" * 5000 + " y" * 5000)]
    got = quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)
    for g in got.collect():
        want = base_counts(dict(rows)[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, g.doc_id
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g.kept and g.base_failed)


def words(r, n, mark=lambda w: w):
    return " ".join(mark("".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8)))) for _ in range(n))


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5])
def test_rules_keep_clean_and_drop_junk(spark, share):
    r = random.Random(4)
    kinds = [lambda w: w + "***", lambda w: w.upper() + "!!", lambda w: w + " |"]
    rows = [(i, words(r, 80, r.choice(kinds)) if i < 200 * share else words(r, 80)) for i in range(200)]
    got = {g.doc_id: g.kept for g in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i >= 200 * share) for i in got)


def plain_em(docs):
    """The fit document by document, without arrays: of each document the posterior of being good."""
    m = len(quality_rules.RULES)
    share = [[1.0] for _ in docs]
    while True:
        kinds = len(share[0])
        for _ in range(quality_rules.ROUNDS):
            size = [sum(s[k] for s in share) for k in range(kinds)]
            more = [quality_rules.PRIOR_KIND[0 if k == 0 else 1] for k in range(kinds)]
            kind = [(size[k] + more[k]) / (len(docs) + sum(more)) for k in range(kinds)]
            chance = []
            for k in range(kinds):
                prior = quality_rules.PRIOR_BAD if k else quality_rules.PRIOR_GOOD
                chance.append([[(sum(s[k] for s, d in zip(share, docs) if d[j] == v) + quality_rules.PRIOR * prior[v]) / (size[k] + quality_rules.PRIOR) for v in range(3)] for j in range(m)])
            new = []
            for d in docs:
                p = [kind[k] * math.prod(chance[k][j][d[j]] for j in range(m)) for k in range(kinds)]
                new.append([x / sum(p) for x in p])
            moved = max(abs(a - b) for s, t in zip(share, new) for a, b in zip(s, t))
            share = new
            if moved < quality_rules.STILL:
                break
        best = (quality_rules.SURPRISE, None, None)
        for i in range(m):
            for j in range(i + 1, m):
                seen = sum(d[i] == 0 and d[j] == 0 for d in docs)
                expected = sum(sum(s[k] for s, d in zip(share, docs) if d[i] == 0) * sum(s[k] for s, d in zip(share, docs) if d[j] == 0) / max(sum(s[k] for s in share), 1e-300) for k in range(kinds))
                if seen > expected and (x := seen * math.log(seen / max(expected, 1e-300)) - (seen - expected)) >= best[0]:
                    best = (x, i, j) if x > best[0] or best[1] is None else best
        if best[1] is None:
            return [s[0] for s in share]
        both = [d[best[1]] == 0 and d[best[2]] == 0 for d in docs]
        share = [[x * (1e-3 if b else 1) for x in s] + [1 - 1e-3 if b else 0.0] for s, b in zip(share, both)]


def drawn(r, n, noise=0.0):
    """Made votes: two kinds of bad documents, each seen by two rules of three in four, and a rule (the last) that fires at random. (truth, votes)."""
    out = []
    for i in range(n):
        kind = r.choices((0, 1, 2), (0.8, 0.12, 0.08))[0]
        votes = [2 if r.random() < 0.9 else 1 for _ in quality_rules.RULES]
        for j in ((), (0, 1, 2), (3, 4, 5))[kind]:
            votes[j] = 0 if r.random() < 0.75 else votes[j]
        for j in range(len(votes) - 1):
            votes[j] = 0 if r.random() < 0.01 else votes[j]
        votes[-1] = 0 if r.random() < noise else votes[-1]
        out.append((kind == 0, tuple(votes)))
    return out


def posteriors(docs):
    counted = sorted(Counter(docs).items())
    kind, vote = quality_rules.expect(counted)
    total = {p: [kind[k] + sum(vote[k][j][x] for j, x in enumerate(p)) for k in range(len(kind))] for p, _ in counted}
    return {p: 1 / sum(math.exp(x - t[0]) for x in t) for p, t in total.items()}, len(kind)


@pytest.mark.parametrize("noise", [0.05, 0.3, 0.6])
def test_a_rule_that_fires_at_random_loses_its_say(noise):
    r = random.Random(3)
    docs = drawn(r, 4000, noise)
    post, kinds = posteriors([v for _, v in docs])
    assert kinds == 3
    alone = [p for p in post if p[-1] == 0 and 0 not in p[:-1]]
    assert len(alone) > 20 and all(post[p] >= 0.5 for p in alone)


def test_posterior_beats_all_must_pass():
    docs = drawn(random.Random(8), 4000, 0.1)
    post, _ = posteriors([v for _, v in docs])
    right = sum((post[v] >= 0.5) == good for good, v in docs)
    # bad documents with one bad vote at most, 3 in 100 of all, can't be told from noise
    assert right > 0.95 * len(docs) and right > sum((0 not in v) == good for good, v in docs) + 0.05 * len(docs)
    assert any(0 in v and post[v] >= 0.5 for _, v in docs)


def test_fit_agrees_with_plain_em():
    docs = [v for _, v in drawn(random.Random(5), 250, 0.2)]
    post, kinds = posteriors(docs)
    assert kinds > 1
    for d, want in zip(docs, plain_em(docs)):
        assert abs(post[d] - want) < 1e-6


def test_kept_follows_the_posterior_of_the_votes(spark):
    r = random.Random(14)
    kinds = [lambda w: w + "***", lambda w: w.upper() + "!!", lambda w: w + " |", lambda w: w]
    rows = [(i, words(r, r.choice([10, 22, 30, 80]), kinds[min(3, r.randint(0, 12))])) for i in range(250)]
    rows += [(i, rows[i][1]) for i in range(20)] + [(None, None), (None, "\n"), (7, words(r, 30000))]
    got = quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("*", *[v.alias(f"v{j}") for j, v in enumerate(quality_rules.votes())]).collect()
    assert len(got) == len(rows)
    fit = [g for g in got if not g.base_failed]
    want = plain_em([tuple(g[f"v{j}"] for j in range(len(quality_rules.RULES))) for g in fit])
    assert all(abs(g.posterior - w) < 1e-6 and g.kept == (w >= 0.5) for g, w in zip(fit, want))
    assert not any(g.kept for g in got if g.base_failed) and any(not g.kept for g in fit) and any(g.kept and g.v10 == 0 for g in fit)


def test_further_counts(spark):
    r = random.Random(21)
    rows = [(i, "".join(r.choice(["ab ", "AB ", "ab! ", "x*** ", "| ", "é%. ", "ab\n", "'q' ", "a-b "]) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(100, None)]
    for g in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = dict(rows)[g.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        ends = sum(bool(regex.search(quality_rules.ODD_END.removesuffix(r"(?=\s|$)") + "$", x)) for x in w)
        want = (len(lines), sum("A" <= c <= "Z" for c in t), t.count("!"), sum(a == b for a, b in zip(w, w[1:])), len(set(w)), len(re.findall(r"[#*$%&|<>]+", t)), ends)
        assert (g.n_lines, g.n_capitals, g.n_shouts, g.n_stutters, g.n_distinct, g.n_symbol_runs, g.n_odd_ends) == want


def test_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, posterior int")
    assert quality_rules.assess(empty).collect() == [] and quality_rules.keep_good(empty).collect() == []


def test_keep_good_keeps_columns(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(i, words(r, 40) if i % 4 else "###", i) for i in range(40)], "doc_id long, text string, n_words int")
    got = quality_rules.keep_good(df)
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == [i for i in range(40) if i % 4]
    assert quality_rules.keep_good(df.limit(0)).collect() == []


URLS = [
    (1, "http://A.Example.ORG/en/1?q#f", "a.example.org", "/en/1", "example.org/en/1", "block"), (2, "https://x.org", "x.org", "", None, None), (3, "https://x.org/", "x.org", "/", "org/", "allow"),
    (4, "ftp://news.com/de/x", "news.com", "/de/x", "com/de/", "block"), (5, "x://com/fr/", "com", "/fr/", "com/fr/", "allow"), (6, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (7, "http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"), (8, "no scheme", "", "", None, None), (9, None, "", "", None, None), (10, "a://b://c/d", "b:", "//c/d", None, None), (11, "http://h.com/de", "h.com", "/de", None, None),
]


def test_rules_of_urls(spark):
    df = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string")
    got = url_filter.judge(df)
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)
    got = {g.page_id: g for g in got.collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).collect() == []


def test_models_learn_from_ruled_urls(spark):
    r = random.Random(9)
    rows = [(i, f"http://{'casino' if i % 2 else 'garden'}{r.randint(1, 99)}.{'com/de' if i % 2 else 'com/fr'}/{r.randint(1, 9999)}") for i in range(400)]
    rows += [(1000 + i, f"http://{'casino' if i % 2 else 'garden'}{r.randint(1, 99)}.net/{r.randint(1, 9999)}") for i in range(60)]
    got = {g.page_id: g.verdict for g in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(60))
    assert right >= 57


def test_scores_match_plain_python(spark):
    r = random.Random(3)
    rows = [(f"http://{r.choice('abc')}{r.randint(0, 50)}.net/É", r.choice(["allow", "block"])) for _ in range(80)]
    df = spark.createDataFrame(rows, "url string, verdict string")
    ratios, _ = url_filter.fit(df)
    for row in df.distinct().select("url", url_filter.scorer(ratios)(F.col("url")).alias("s")).limit(20).collect():
        low = row.url.lower()
        codes = [url_filter.BEGIN] * 2 + [url_filter.ALPHABET.index(c) if c in url_filter.ALPHABET else url_filter.OTHER for c in low] + [url_filter.END]
        want = sum(ratios[(codes[i - 2] * url_filter.SYMBOLS + codes[i - 1]) * url_filter.SYMBOLS + codes[i]] for i in range(2, len(codes))) / 1000 / (len(row.url) + 1)
        assert abs(row.s - want) < 1e-9
