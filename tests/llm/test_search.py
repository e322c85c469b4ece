"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from cytoframe.llm import top_k

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=20, every=20):
    ready = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ready[(i, tuple(math.floor(64 * float(np.float32(x))) for x in v))] = True
    out = []
    for i, v in ready:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ready if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def own(spark, rows):
    return sorted(tuple(r) for r in top_k.search(spark.createDataFrame(rows, VECTORS)).collect())


@pytest.mark.parametrize("block", [10_000, 16])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "LEAST", block)
    monkeypatch.setattr(top_k, "QUERIES", 4 if block == 16 else 4096)
    r = random.Random(block)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # ties
    assert own(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (1, [1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [-1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.01, -0.01])]
    assert own(spark, rows) == brute(rows)
    assert own(spark, []) == [] and own(spark, [(20, [1.0])]) == []


@pytest.mark.parametrize("block", [10_000, 16])
def test_repeated_rows_are_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "LEAST", block)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(60)]
    rows += rows[41:60] * 3 + [(7, [x + 1e-9 for x in rows[7][1]])] * 30
    ready = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = []
    for i, v in ready[:60:20]:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ready if j != i)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    assert own(spark, rows) == sorted(want)


def test_nothing_is_lost_by_stopping_early():
    r = np.random.default_rng(1)
    for scale in (3, 40, 1 << 22):
        v = (r.standard_normal((300, 24)) * scale).astype(np.int64)
        v[:200] = (v[:200] * 0.1).astype(np.int64)
        q = (r.standard_normal((9, 24)) * scale).astype(np.int64)
        alive = top_k.ImpactIndex(v).possible(q, 10)
        exact = q @ v.T
        for i in range(len(q)):
            assert alive[i][np.argsort(-exact[i], kind="stable")[:10]].all()


def test_wide_components_are_exact(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1.0, -1.0]) * 2.0 ** r.randint(-3, 45) for _ in range(4)]) for i in range(80)] + [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(80, 120)]
    rows += [(300, [1e7, 1.0]), (301, [-1e7, 3.0]), (320, [float(2**24), float(2**24 - 1), -float(2**24)]), (340, [3e38, -3e38]), (341, [3e38, 3e38])]
    top = top_k.TOP
    whole = [(i, [max(-top, min(top, math.floor(64 * float(np.float32(x))))) for x in v]) for i, v in rows]
    want = []
    for i, v in whole:
        if i % 20 == 0:
            found = sorted((-max(-top, min(top, sum(a * b for a, b in zip(v, w)))), j) for j, w in whole if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    got = own(spark, rows)
    assert got == sorted(want)
    assert top_k.search(spark.createDataFrame([(0, [1e7]), (1, [1.0]), (2, [1e7])], VECTORS)).collect()[0].score == 640_000_000**2


def test_sql_agrees_where_rows_repeat(spark, tmp_path):
    import duckdb

    from cytoframe.llm import oracles

    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)], 3, 5) for i in range(70)]
    rows += rows[20:50] * 2 + [(40, [0.5] * 8, 1, 1), (60, None, 1, 1), (61, [], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = top_k.search(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(oracles.OP6).fetchall()
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
