"""Interval plans against brute force."""

import random

import pytest

from cytoframe.operators import levels as L
from cytoframe.plans import ranges as P

BED = "chrom string, start long, stop long"


def made(seed, n=60, span=400, longest=60):
    r = random.Random(seed)
    return [(r.choice("ab"), s := r.randrange(span), s + r.randint(0, r.choice([3, longest]))) for _ in range(n)]


def bases(data):
    return {(c, p) for c, s, e in data for p in range(s, e)}


def as_bases(df):
    return {(r.chrom, p) for r in df.collect() for p in range(r.start, r.stop)}


@pytest.mark.parametrize("seed", range(3))
def test_sets_of_bases(spark, seed):
    a, b = made(seed), made(seed + 100)
    da, db = spark.createDataFrame(a, BED), spark.createDataFrame(b, BED)
    merged = P.merge_touching(da).collect()
    assert {(r.chrom, p) for r in merged for p in range(r.start, r.stop)} == bases(a)
    for r in merged:
        assert not any(o.chrom == r.chrom and o is not r and o.start <= r.stop and r.start <= o.stop for o in merged)
    assert as_bases(P.intersect(P.merge_touching(da), P.merge_touching(db))) == bases(a) & bases(b)
    gaps = as_bases(P.complement(da))
    for c in "ab":
        top = max(e for k, _, e in a if k == c)
        assert {p for k, p in gaps if k == c} == set(range(top)) - {p for k, p in bases(a) if k == c}


@pytest.mark.parametrize("plan", [None, (1, 3), (7, 1), (16, 2), (1000, 1)])
def test_points_in_intervals(spark, plan):
    a = [(c, s, e) for c, s, e in made(5, 50, 300, 200)] + [("a", 0, 400), ("b", 17, 17)]
    points = [(c, p) for c in "abc" for p in range(0, 420, 3)]
    if plan and plan[0] * 16 ** plan[1] < 400:
        plan = (plan[0], 3)
    got = P.point_in_interval(spark.createDataFrame(points, "chrom string, pos long"), spark.createDataFrame(a, BED), plan)
    want = sorted((c, p, s, e) for c, p in points for k, s, e in a if k == c and s <= p < e)
    assert sorted(tuple(r) for r in got.select("chrom", "pos", "start", "stop").collect()) == want


def test_the_plan_is_an_equi_join(spark):
    a, p = spark.createDataFrame(made(1), BED), spark.createDataFrame([("a", 1)], "chrom string, pos long")
    text = P.point_in_interval(p, a)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text and "_bin" in text


def test_empty_intervals(spark):
    none = spark.createDataFrame([], BED)
    points = spark.createDataFrame([("a", 1)], "chrom string, pos long")
    assert P.point_in_interval(points, none).collect() == []
    assert P.merge_touching(none).collect() == [] and P.complement(none).collect() == []


def test_intervals_without_sites_stay(spark):
    sites = spark.createDataFrame([("a", 5, "+", "CpG", 1, 2)], "chrom string, pos long, strand string, context string, n_meth long, n_reads long")
    beds = spark.createDataFrame([("a", 0, 10, "x"), ("a", 0, 10, "y"), ("a", 6, 9, "z"), ("q", 0, 5, "w"), ("a", 5, 5, "v")], BED + ", name string")
    got = {r.name: (r.total_sites, r.total_c, r.mean_meth_weighted) for r in L.by_interval(beds, sites).collect()}
    assert got == {"x": (1, 1, 0.5), "y": (1, 1, 0.5), "z": (0, 0, None), "w": (0, 0, None), "v": (0, 0, None)}


def test_roi_over_a_partition_sums_to_levels(spark):
    r = random.Random(2)
    sites = spark.createDataFrame([("a", p, "+", "CpG", k := r.randint(0, 9), k + r.randint(0, 9)) for p in range(0, 500, 2)], "chrom string, pos long, strand string, context string, n_meth long, n_reads long")
    beds = spark.createDataFrame([("a", s, s + 50) for s in range(0, 500, 50)], BED)
    parts = L.by_interval(beds, sites).collect()
    whole = next(x for x in L.levels(sites).collect() if x.kind == "cytosines")
    for c in ("total_sites", "sites_covered", "total_c", "total_t", "called_meth"):
        assert sum(p[c] for p in parts) == whole[c]


def test_deserts_and_islands(spark):
    df = spark.createDataFrame([("a", p, s) for p, s in ((1, True), (2, True), (3, False), (4, True), (50, True))], "chrom string, pos long, state boolean")
    cut = P.deserts(df, ("chrom",), 10)
    assert [r.segment for r in cut.orderBy("pos").collect()] == [0, 0, 0, 0, 1]
    assert [r.island for r in P.islands(cut, ("chrom", "segment"), ("pos",), "state").orderBy("pos").collect()] == [1, 1, 2, 3, 1]


def test_few_intervals_narrow_the_scan(spark, tmp_path):
    from cytoframe.operators import levels as L

    sites = spark.range(5000).selectExpr("concat('c', id % 3) as chrom", "id as pos", "'+' as strand", "'CpG' as context", "id % 7 as n_reads", "id % 3 as n_meth").where("n_meth <= n_reads")
    sites.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    few = spark.createDataFrame([("c1", 100, 200, "a"), ("c2", 4000, 4100, "b"), ("c9", 1, 5, "none"), ("c1", 50, 50, "empty")], "chrom string, start long, stop long, name string")
    got = {r.name: r.total_sites for r in L.by_interval(few, stored).collect()}
    want = {r["name"]: sites.where(f"chrom = '{r['chrom']}' and pos >= {r['start']} and pos < {r['stop']}").count() for r in few.collect()}
    assert got == want and want["a"] > 20
    assert "GreaterThanOrEqual(pos,100)" in P.narrowed(stored, few)._jdf.queryExecution().executedPlan().toString()
    assert P.narrowed(stored, few, 3) is stored
    assert P.narrowed(stored, few.limit(0)).count() == 0
