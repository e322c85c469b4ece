"""Reads: CIGARs, conversion, states, duplicates, mates, formats."""

import random

import pytest
from pyspark.sql import functions as F

from cytoframe.operators import reads as R
from cytoframe.operators import sites as S

READ = "qname string, chrom string, pos long, strand string, cigar string, seq string"


def test_bases_follow_the_cigar(spark):
    df = spark.createDataFrame([("r", "c", 10, "+", "1S2M1I1M2D2M", "NACTGGA"), ("m", "c", 0, "-", "3M", "AAC")], READ)
    got = {(r.qname, r.rpos): (r.fpos, r.base, r.original) for r in R.bases(df).collect()}
    assert got == {
        ("r", 10): (1, "A", "A"), ("r", 11): (2, "C", "C"), ("r", 12): (4, "G", "G"), ("r", 15): (5, "G", "G"), ("r", 16): (6, "A", "A"),
        ("m", 0): (2, "G", "C"), ("m", 1): (1, "T", "A"), ("m", 2): (0, "T", "A"),
    }
    assert [r[0] for r in df.orderBy("qname").select(R.reference_width(F.col("cigar"))).collect()] == [3, 7]


def test_counts_states_and_conversion(spark):
    genome = spark.createDataFrame([("c", "ACGTCAACGT")], "chrom string, seq string")
    reads = spark.createDataFrame([("a", "c", 0, "+", "10M", "ATGTTAACGT"), ("b", "c", 0, "-", "10M", "ACGTTGACAT"), ("h", "c", 8, "+", "5M", "GTAAA")], READ)
    got = {(r.pos, r.strand): (r.context, r.n_meth, r.n_reads) for r in R.counts(reads, S.cytosines(genome)).collect()}
    assert got[(1, "+")] == ("CpG", 0, 1) or got[(1, "+")] == ("CpGx", 0, 1)
    assert got[(7, "+")][1:] == (1, 1)
    states = {r.qname: (r.pos, r.seq) for r in R.states(reads, R.cpg_index(genome)).collect()}
    assert states["a"] == (0, "TC")
    rates = R.conversion_rates(R.conversion(reads, genome)).first()
    assert rates.total_plus == 1 and rates.converted_plus == 1


def test_duplicates_keep_one_each(spark):
    df = spark.createDataFrame([(i, "c", i // 3, i // 3 + 5, "+") for i in range(9)] + [(9, "c", 0, 5, "-")], "read long, chrom string, start long, stop long, strand string")
    kept = R.unique_reads(df)
    assert sorted(r.copies for r in kept.collect()) == [1, 3, 3, 3]
    assert [tuple(r) for r in kept.select("read").collect()] == [tuple(r) for r in R.unique_reads(df).select("read").collect()]


def test_mates_merge_gap_overlap_and_not(spark):
    rows = [
        ("gap", 1, "c", 0, "+", "3M", "AAA"), ("gap", 2, "c", 5, "-", "3M", "CCC"),
        ("over", 1, "c", 0, "+", "4M", "AAAA"), ("over", 2, "c", 2, "-", "4M", "CCCC"),
        ("dove", 1, "c", 5, "+", "4M", "AAAA"), ("dove", 2, "c", 3, "-", "4M", "CCCC"),
        ("far", 1, "c", 0, "+", "2M", "AA"), ("far", 2, "c", 50000, "-", "2M", "CC"),
        ("lone", 1, "c", 0, "+", "2M1D1M", "AAG"),
    ]
    df = spark.createDataFrame(rows, "name string, end int, chrom string, pos long, strand string, cigar string, seq string")
    got = sorted((r.name, r.pos, r.cigar, r.seq, r.ends) for r in R.merge_mates(df).collect())
    assert got == [("dove", 5, "2M", "AA", 2), ("far", 0, "2M", "AA", 1), ("far", 50000, "2M", "CC", 1), ("gap", 0, "8M", "AAANNCCC", 2), ("lone", 0, "4M", "AANG", 1), ("over", 0, "6M", "AAAACC", 2)]


def test_modification_tags(spark):
    df = spark.createDataFrame([("r", "c", 100, "+", "ACCAC", "C+h,0;C+m,1,0;", [51, 102, 255])], "read string, chrom string, pos long, strand string, seq string, mm string, ml array<int>")
    got = sorted((r.pos, r.kind, r.prob) for r in R.parse_modifications(df).collect())
    assert got == [(101, "h", 51), (102, "m", 102), (104, "m", 255)]
    assert {r.pos: (r.hydroxy, r.methyl) for r in R.nano_counts(R.parse_modifications(df)).collect()} == {101: (0.2, 0.0), 102: (0.0, 0.4), 104: (0.0, 1.0)}


def test_protocols(spark):
    random.seed(4)
    rich = lambda w: "".join(random.choices("ACGT", w, k=80))
    t = spark.createDataFrame([(str(i), rich((25, 1, 25, 49))) for i in range(50)], "name string, seq string")
    a = spark.createDataFrame([(str(i), rich((49, 25, 1, 25))) for i in range(50)], "name string, seq string")
    assert R.guess_protocol(t).first().protocol == "wgbs" and R.guess_protocol(a).first().protocol == "pbat"
    assert R.guess_protocol(t.union(a)).first().protocol == "rpbat"


def test_hairpins(spark):
    df = spark.createDataFrame([("h", "TTGACGTTTAGGTTGGACGT", "CTAACGTTTAGGTTGGACGT"), ("n", "A" * 25, "C" * 25), ("s", "A", "A")], "name string, seq1 string, seq2 string")
    got = {r.name: (r.matching, r.n, r.hairpin) for r in R.hairpins(df).collect()}
    assert got == {"h": (20, 20, True), "n": (0, 25, False)}


def test_suffix_lengths_count_every_name(spark):
    names = spark.range(120000).select(F.format_string("r%06d", "id").alias("name"))
    got = {r.suffix: r.most for r in R.suffix_length(names, longest=6).collect()}
    assert got == {0: 1, 1: 10, 2: 100, 3: 1000, 4: 10000, 5: 100000, 6: 120000}


def test_mates_of_odd_kinds(spark):
    rows = [
        ("del", 1, "c", 10, "+", "2M2D3M", "ACGTA"), ("del", 2, "c", 14, "-", "1S4M", "GCCCC"),
        ("far", 1, "c", 10, "+", "4M", "ACGT"), ("far", 2, "c", 90000, "-", "4M", "ACGT"), ("chrom", 1, "c", 10, "+", "4M", "ACGT"), ("chrom", 2, "d", 12, "-", "4M", "ACGT"),
        ("one", 1, "c", 5, "-", "2I3M", "TTACG"), ("over", 2, "c", 10, "+", "4M", "AAAA"), ("over", 1, "c", 8, "-", "4M", "CCCC"), ("same", 1, "c", 1, "+", "2M", "AC"), ("same", 2, "c", 3, "+", "2M", "GT"),
    ]
    got = sorted((r.name, r.chrom, r.pos, r.strand, r.cigar, r.seq, r.ends) for r in R.merge_mates(spark.createDataFrame(rows, "name string, end int, chrom string, pos long, strand string, cigar string, seq string")).collect())
    assert got == sorted([
        ("del", "c", 10, "+", "8M", "ACNNGTAC", 2), ("far", "c", 10, "+", "4M", "ACGT", 1), ("far", "c", 90000, "-", "4M", "ACGT", 1), ("chrom", "c", 10, "+", "4M", "ACGT", 1), ("chrom", "d", 12, "-", "4M", "ACGT", 1),
        ("one", "c", 5, "-", "3M", "ACG", 1), ("over", "c", 10, "-", "2M", "CC", 2), ("same", "c", 1, "+", "2M", "AC", 1), ("same", "c", 3, "+", "2M", "GT", 1),
    ])


def test_modifications_over_gaps_and_other_kinds(spark):
    rows = [("r", "c", 100, "+", "ACCGC", "2M3D1I2M", "C+a,0;C+h,0,1;C+m,1;", [9, 10, 20, 30]), ("s", "c", 50, "-", "CACC", "4M", "C+m?,2;", [77]), ("t", "c", 1, "+", "C", "1M", "C+m,5;", [1])]
    df = spark.createDataFrame(rows, "read string, chrom string, pos long, strand string, seq string, cigar string, mm string, ml array<int>")
    got = sorted((r.read, r.pos, r.kind, r.prob) for r in R.parse_modifications(df).collect())
    # of ACCGC over 2M3D1I2M the bases lie at 100, 101, (inserted), 105, 106
    assert got == [("r", 101, "h", 10), ("r", 106, "h", 20), ("s", 50, "m", 77)]


def test_standard_form(spark):
    rows = [("a", "+", "ACG", {"ZS": "+-", "NM": "2", "XX": "1"}), ("b", "-", "AACG", {"ZS": "-+", "NM": "0"})]
    df = spark.createDataFrame(rows, "qname string, strand string, seq string, tags map<string,string>")
    assert [tuple(r) for r in R.standardize(df, "bsmap").orderBy("qname").select("qname", "seq", "conversion", "nm", "qual").collect()] == [("a", "ACG", "A", 2, "*"), ("b", "CGTT", "T", 0, "*")]
    assert R.standardize(df, "walt").collect() == df.collect()
    with pytest.raises(Exception, match="no XR tag in a"):
        R.standardize(df.where("qname = 'a'"), "bismark").collect()
    with pytest.raises(ValueError):
        R.standardize(df, "other")


def test_hairpins_are_parted(spark):
    good, pin = ("g", "ACGT" * 10, "GGAC" * 10), ("p", "TCGA" * 10, "CCAA" * 10)
    df = spark.createDataFrame([good, pin, ("n", "N" * 40, "N" * 39 + "A"), ("s", "ACGT", "ACGT")], "name string, seq1 string, seq2 string")
    assert [r.name for r in R.clean_hairpins(df).collect()] == ["g"] and [r.name for r in R.clean_hairpins(df, invert=True).collect()] == ["p"]


def test_choice_among_the_first_copies(spark):
    df = spark.createDataFrame([(i, "c", 5, 9, "+") for i in range(50)] + [(99, "c", 6, 9, "+")], "read long, chrom string, start long, stop long, strand string")
    got = {r.start: r for r in R.unique_reads(df, most=3).collect()}
    assert got[5].read < 3 and got[5].copies == 50 and got[6].copies == 1
    assert {r.start: r.copies for r in R.unique_reads(df).collect()} == {5: 50, 6: 1} and R.unique_reads(df).columns == [*df.columns, "copies"]


def test_one_scan_gives_what_five_give(spark):
    from cytoframe.operators import many

    genome = spark.createDataFrame([("c", "ACGTCCGGATCGCGTTACGC")], "chrom string, seq string")
    reads = spark.createDataFrame([(f"r{i}", "c", i, "+-"[i % 2], "6M", "CGTCTG") for i in range(12)], "qname string, chrom string, pos long, strand string, cigar string, seq string")
    got = many.FromReads(reads, genome)
    spine = S.cytosines(genome)
    counted = R.counts(reads, spine)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got.states) == rows(R.states(reads, R.cpg_index(genome))) and rows(got.xcounts) == rows(S.to_deltas(counted))
    assert rows(got.bsrate) == rows(R.conversion_rates(R.conversion(reads, genome), ("fpos",)))
