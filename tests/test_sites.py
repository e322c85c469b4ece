"""Hand-made cases for operators on sites, and invariants with random ones."""

import random

from pyspark.sql import functions as F

from cytoframe.operators import levels as L
from cytoframe.operators import sites as S

SITE = "chrom string, pos long, strand string, context string, n_meth long, n_reads long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_contexts_of_a_short_genome(spark):
    # by hand: position, strand, context of the ten cytosines
    genome = spark.createDataFrame([("c", "ACGTCAGCTTCCGATG")], "chrom string, seq string")
    got = {(r.pos, r.strand): r.context for r in S.cytosines(genome).collect()}
    assert got == {
        (1, "+"): "CpG", (2, "-"): "CpG", (4, "+"): "CXG", (6, "-"): "CXG", (7, "+"): "CHH", (10, "+"): "CCG", (11, "+"): "CpG", (12, "-"): "CpG", (15, "-"): "CHH",
    }


def test_contexts_do_not_depend_on_pieces(spark):
    random.seed(3)
    seq = "".join(random.choice("ACGTN") for _ in range(2000))
    genome = spark.createDataFrame([("c", seq), ("empty", "")], "chrom string, seq string")
    got = {(r.pos, r.strand): r.context for r in S.cytosines(genome).collect()}
    assert len(got) == sum(x in "CG" for x in seq)
    for (pos, strand), tag in got.items():
        near = seq[pos : pos + 3] if strand == "+" else seq[max(0, pos - 2) : pos + 1].translate(str.maketrans("ACGT", "TGCA"))[::-1]
        if near[1:2] == "G":
            want = "CpG"
        elif len(near) == 3 and near[1] in "ACTN" and near[2] in "ACTN":
            want = "CHH"
        elif len(near) == 3 and near[1] in "ATN" and near[2] == "G":
            want = "CXG"
        else:
            want = "CCG"
        assert tag == want, (pos, strand, near)


def test_kmer_at_the_very_end_is_found(spark):
    genome = spark.createDataFrame([("c", "ATCGTTCG")], "chrom string, seq string")
    assert rows(S.kmer_sites(genome, "CG", 0), "pos") == [(2,), (6,)]


def test_symmetric_merges_mates_and_moves_lone_minus(spark):
    data = [("c", 10, "+", "CpG", 3, 4), ("c", 11, "-", "CpGx", 1, 6), ("c", 21, "-", "CpG", 2, 2), ("c", 30, "+", "CHH", 1, 1)]
    got = rows(S.symmetric(spark.createDataFrame(data, SITE)), "pos", "strand", "context", "n_meth", "n_reads")
    assert got == [(10, "+", "CpGx", 4, 10), (20, "+", "CpG", 2, 2)]


def test_symmetric_keeps_coverage(spark):
    random.seed(1)
    data = [("c", p, "+" if p % 2 == 0 else "-", "CpG", 1, random.randint(1, 9)) for p in random.sample(range(200), 90)]
    df = spark.createDataFrame(data, SITE)
    assert S.symmetric(df).agg(F.sum("n_reads")).first()[0] == sum(d[5] for d in data)


def test_deltas_round_trip(spark):
    data = [("c", p, "+", "CpG", 1, 2) for p in (0, 3, 4, 90)] + [("d", 7, "+", "CpG", 0, 1), ("d", 9, "+", "CpG", 0, 0)]
    back = S.from_deltas(S.to_deltas(spark.createDataFrame(data, SITE)).withColumnRenamed("pos", "line"), "line")
    assert rows(back, "chrom", "pos") == [("c", 0), ("c", 3), ("c", 4), ("c", 90), ("d", 7)]


def test_merge_of_one_sample_is_identity(spark):
    data = [("A", "c", 1, "+", "CpG", 1, 2), ("A", "c", 2, "-", "CpGx", 0, 5)]
    df = spark.createDataFrame(data, "sample string, " + SITE)
    assert rows(S.merge_counts(df, True), "pos", "context", "n_meth", "n_reads") == [(1, "CpG", 1, 2), (2, "CpGx", 0, 5)]
    assert rows(S.merge_counts(df), "context") == [("CpG",), ("CpG",)]


def test_difference_of_both_ways_sums_to_one(spark):
    a = spark.createDataFrame([("c", 1, "+", "CpG", 3, 9), ("c", 2, "+", "CpG", 8, 8)], SITE)
    b = spark.createDataFrame([("c", 1, "+", "CpG", 5, 6), ("c", 2, "+", "CpG", 0, 4)], SITE)
    one = {r.pos: r.score for r in S.difference(a, b).collect()}
    two = {r.pos: r.score for r in S.difference(b, a).collect()}
    for p in one:
        assert abs(one[p] + two[p] - 1) < 1e-9
    assert one[1] < 0.1 and one[2] > 0.95


def test_lift_drops_unlifted_and_turns_minus(spark):
    data = [("c", 5, "+", "CpG", 1, 2), ("c", 6, "+", "CpG", 1, 3), ("c", 7, "+", "CpG", 0, 1)]
    index = spark.createDataFrame([("c", 5, "d", 50, "-"), ("c", 6, "d", 49, "+")], "from_chrom string, from_pos long, to_chrom string, to_pos long, to_strand string")
    sites = spark.createDataFrame(data, SITE)
    lifted = S.lift(sites, index, plus_strand=True)
    assert rows(lifted, "chrom", "pos", "strand") == [("d", 49, "+"), ("d", 49, "+")]
    assert rows(S.unlifted(sites, index), "pos") == [(7,)]
    assert rows(S.merge_lifted(lifted), "pos", "n_reads") == [(49, 5)]
    assert rows(S.merge_lifted(lifted, unique=True), "pos") == []


def test_levels_of_nothing(spark):
    assert L.levels(spark.createDataFrame([], SITE)).collect() == []


def test_levels_by_hand(spark):
    data = [("c", 1, "+", "CpG", 9, 10), ("c", 2, "-", "CpG", 0, 10), ("c", 5, "+", "CHHx", 0, 0), ("c", 6, "+", "CXG", 1, 2)]
    got = {r.kind: r for r in L.levels(spark.createDataFrame(data, SITE)).collect()}
    all_ = got["cytosines"]
    assert (all_.total_sites, all_.sites_covered, all_.total_c, all_.coverage, all_.max_depth, all_.mutations) == (4, 3, 10, 22, 10, 1)
    assert (all_.called_meth, all_.called_unmeth) == (1, 1)
    assert got["cpg_symmetric"].total_sites == 1 and got["cpg_symmetric"].total_c == 9
    assert got["chh"].mean_meth is None and got["chh"].fractional_meth is None
    assert abs(all_.mean_meth - round((0.9 + 0 + 0.5) / 3, 6)) < 1e-9


def test_recovered_restores_zeros(spark):
    genome = spark.createDataFrame([("c", "CGACG"), ("d", "CG")], "chrom string, seq string")
    spine = S.cytosines(genome)
    known = spark.createDataFrame([("c", 3, 1, 4)], "chrom string, pos long, n_meth long, n_reads long")
    assert rows(S.recovered(known, spine), "chrom", "pos", "n_reads") == [("c", 0, 0), ("c", 1, 0), ("c", 3, 4), ("c", 4, 0)]
    assert S.recovered(known, spine, all_chroms=True).count() == 6


def test_common_order_of_chromosomes():
    assert S.common_order([["a", "c"], ["a", "b", "c"], ["c", "d"]]) == ["a", "b", "c", "d"]
    try:
        S.common_order([["a", "b"], ["b", "a"]])
    except ValueError:
        return
    raise AssertionError
