"""Near-duplicates against brute force."""

import random

import pytest

from cytoframe.llm import near_dup

DOCS = "doc_id long, text string"


def brute(docs):
    sets = []
    for _, t in docs:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\xa0", "\x01").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    at = list(range(len(docs)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    seen = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in seen.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            seen[x].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i))), d == least.get(root(i))) for i, (d, _) in enumerate(docs))


def own(spark, docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect())


def made(seed, groups=((60, 9), (40, 14), (25, 5)), short=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for size, edits in groups:
        base = [r.choice(words) for _ in range(150)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += [" ".join(r.choice(words[:12]) for _ in range(r.randint(0, 9))) for _ in range(short)]
    texts += [t.upper() for t in texts[:15]]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    docs = made(seed)
    assert own(spark, docs) == brute(docs)


def test_large_bands_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "CENTRES", 0)
    docs = made(3)
    assert own(spark, docs) == brute(docs)


def test_texts_may_be_shuffled_to_their_keys(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "KEYS", 0)
    docs = made(4, groups=((20, 9), (10, 3)), short=20)
    assert own(spark, docs) == brute(docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two "), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other text entirely that differs"), (8, "é\xa0x y"), (9, "É\xa0x y"), (10, "z" * 9000)]
    assert own(spark, docs) == brute(docs)
    assert own(spark, []) == []


def test_null_ids_come_last(spark):
    got = own(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, "alone in here with words")])
    assert got == [("5", 2, "5", True), ("None", 1, "None", True), ("None", 2, "5", False)]


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x", 1), (2, "A b c d e f", "y", 2), (1, "a b c d e f", "z", 3), (3, None, "n", 4), (4, "other words are here now", "o", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, node long")
    got = near_dup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b c d e f"), (3, None), (4, "other words are here now")] or sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, "a b c d e f"), (3, ""), (4, "other words are here now")]
