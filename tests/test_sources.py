"""Text and binary formats through files."""

import gzip
import random
import os

import pytest

from cytoframe.sources import bam
from cytoframe.sources import text as T


def test_counts_file_with_header_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "x.counts.gz", "wt") as f:
        f.write("#cytoframe 1.0\n#chr1 100\n#\nchr1 \t 5   +  CpG 0.333333\t3\nchr1\t9\t-\tCHHx\t0\t0\n")
    got = T.parse_counts(T.lines(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.pos, r.strand, r.context, r.n_meth, r.n_reads) for r in got] == [(5, "+", "CpG", 1, 3), (9, "-", "CHHx", 0, 0)]
    assert [tuple(r) for r in T.header(T.lines(spark, str(tmp_path))).collect()] == [("chr1", 100)]


def test_malformed_counts_raise(spark):
    bad = spark.createDataFrame([("chr1\t5\t*\tCpG\t0.5\t3",)], "value string")
    with pytest.raises(Exception, match="malformed site"):
        T.parse_counts(bad).collect()
    wide = spark.createDataFrame([("chr1\t5\t+\tCpG\t0.5\t4\textra",)], "value string")
    with pytest.raises(Exception, match="malformed site"):
        T.parse_counts(wide).collect()
    assert T.parse_counts(wide, relaxed=True).first().n_meth == 2


def test_bed_kinds(spark):
    df = spark.createDataFrame([("chr1  3   9",), ("chr1\t1\t2\tn\t7\t-",)], "value string")
    got = {r.start: (r.stop, r.name, r.strand) for r in T.parse_bed(df).collect()}
    assert got[1] == (2, "n", "-") and got[3][0] == 9 and got[3][1].startswith("X")
    with pytest.raises(Exception, match="malformed interval"):
        T.parse_bed(spark.createDataFrame([("chr1\t1\t2\tn",)], "value string")).collect()


def test_fasta_file(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one some words\nacgt\nACG\n>two\nTT\n")
    assert sorted(tuple(r) for r in T.read_fasta(spark, str(tmp_path / "g.fa")).collect()) == [("one", "ACGTACG"), ("two", "TT")]


def test_xcounts_lines(spark):
    lines = ["#x", "chrA", "5\t1\t2", "3\t0\t1", "chrB", "2\t2\t0"]
    df = spark.createDataFrame(list(enumerate(lines)), "ln long, value string")
    assert sorted(tuple(r) for r in T.parse_xcounts(df).collect()) == [("chrA", 5, 1, 2), ("chrA", 8, 0, 1), ("chrB", 2, 2, 0)]
    assert T.looks_like_xcounts(df.select("value"))


def test_bam_round_trip(spark, tmp_path):
    data = bam.encode([("c1", 1000)], [("r1", 0, 0, 5, [(3, "M"), (1, "D"), (2, "M")], "ACGTA"), ("r2", 16, 0, 9, [(3, "M")], "AAC"), ("u", 4, -1, -1, [], "AC")])
    (tmp_path / "x.bam").write_bytes(data)
    got = sorted(tuple(r) for r in T.read_bam(spark, str(tmp_path)).collect())
    assert got == [("r1", 0, "c1", 5, "+", "3M1D2M", "ACGTA"), ("r2", 16, "c1", 9, "-", "3M", "GTT")]


def test_small_parsers(spark):
    one = lambda s: spark.createDataFrame([(s,)], "value string")
    assert tuple(T.parse_sizes(one("c 10")).first()) == ("c", 10)
    with pytest.raises(Exception, match="repeated chromosome"):
        T.parse_sizes(spark.createDataFrame([("c 10",), ("c 11",)], "value string")).collect()
    assert tuple(T.parse_lift_index(one("a 1 b 2 -")).first()) == ("a", 1, "b", 2, "-")
    assert T.parse_diffs(one("a 1 + CpG 0.5 1 2 3 4")).first().unmeth_b == 4
    assert T.parse_regression(one("a 1 + CpG NA 3")).first().p == 1.0
    r = T.parse_table(one("a:1:+:CpG 3 1 4 2")).first()
    assert (r.n, r.m) == ([3.0, 4.0], [1.0, 2.0])
    assert T.parse_design("base case\ns1 1 0\ns2 1 1\n") == (["base", "case"], ["s1", "s2"], [[1, 0], [1, 1]])
    with pytest.raises(ValueError):
        T.parse_design("base\ns1 2\n")
    assert T.parse_levels(T.format_levels([{"kind": "cpg", "total": 3, "mean": None}])) == {"cpg": {"total": 3.0}}
    assert T.looks_like_array(one("a 1 + CpG 0.5")) and not T.looks_like_array(one("a 1 + CpG 0.5 3"))


def test_sorted_write(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "b1"), ("a", 2, "a2"), ("a", 1, "a1")], "chrom string, pos long, value string")
    T.write_sorted(df, str(tmp_path / "o"), ["chrom", "pos"])
    names = sorted(f for f in os.listdir(tmp_path / "o") if f.startswith("part"))
    assert "".join((tmp_path / "o" / f).read_text() for f in names).split() == ["a1", "a2", "b1"]


@pytest.mark.parametrize("split", [700, 5000, 10_000_000])
def test_bam_in_splits(spark, tmp_path, split):
    r = random.Random(3)
    rows = []
    for i in range(4000):
        n = r.randint(1, 60) if i % 500 else 40_000  # some reads are longer than a block
        rows.append((f"read{i}", r.choice(["c1", "c2"]), r.randint(0, 900), r.choice("+-"), f"{n}M", "".join(r.choice("ACGT") for _ in range(n))))
    df = spark.createDataFrame(rows, "qname string, chrom string, pos long, strand string, cigar string, seq string").repartition(3)
    T.write_bam(df, str(tmp_path / "out"), [("c1", 50_000), ("c2", 50_000)])
    back = T.read_bam(spark, str(tmp_path / "out"), split=split)
    assert back.rdd.getNumPartitions() > 3 or split > 1_000_000
    got = sorted(tuple(x) for x in back.select("qname", "chrom", "pos", "strand", "cigar", "seq").collect())
    assert got == sorted(rows)


def test_bam_tags_and_header(spark, tmp_path):
    plain = bam.packed("r", 0, 0, 7, [(3, "M")], "ACG")
    tags = b"NMC\x02" + b"ZSZ++\0" + b"XAAq" + b"MLBC" + (3).to_bytes(4, "little") + bytes([1, 2, 250])
    size = int.from_bytes(plain[:4], "little") + len(tags)
    with open(tmp_path / "x.bam", "wb") as f:
        out = bam.BlockedFile(f)
        out.add(bam.head([("c", 10)], T.sam_header([("c", 10)], "p", "p x")))
        out.add(size.to_bytes(4, "little") + plain[4:] + tags)
        out.close()
    got = T.read_bam(spark, str(tmp_path / "x.bam"), tags=True).collect()
    assert [(x.qname, x.pos, x.tags) for x in got] == [("r", 7, {"NM": "2", "ZS": "++", "XA": "q", "ML": "1,2,250"})]
    assert T.sam_header([("c", 10)], "p", "p x").splitlines()[-1] == "@PG\tID:p\tPN:p\tCL:p x"


def test_stored_tables_are_looked_up(spark, tmp_path):
    sites = spark.createDataFrame([(c, i * 3, i) for c in "ab" for i in range(2000)], "chrom string, pos long, n long")
    T.store_sites(sites, str(tmp_path / "s"))
    found = T.lookup_sites(spark.read.parquet(str(tmp_path / "s")), "b", 30, 42)
    assert sorted(x.n for x in found.collect()) == [10, 11, 12, 13]
    assert "PushedFilters: [IsNotNull(chrom), IsNotNull(pos), EqualTo(chrom,b), GreaterThanOrEqual(pos,30), LessThan(pos,42)]" in found._jdf.queryExecution().executedPlan().toString()
    reads = spark.createDataFrame([("a", i, "CT" * (i % 4 + 1)) for i in range(100)], "chrom string, pos long, seq string")
    T.store_reads(reads, str(tmp_path / "r"))
    got = sorted(x.pos for x in T.lookup_reads(spark.read.parquet(str(tmp_path / "r")), "a", 50, 52).collect())
    assert got == [i for i in range(100) if i < 52 and i + 2 * (i % 4 + 1) > 50]


def test_summaries(spark):
    df = spark.createDataFrame([(3, None, 0.5)], "total long, none string, mean double")
    assert [x.value for x in T.format_summary(df).orderBy("at").collect()] == ["total: 3", "none: NA", "mean: 0.5"]
    assert T.format_json(df).first().value == '{"total":3,"none":null,"mean":0.5}'


def test_compact_counts_over_splits(spark, tmp_path):
    r = random.Random(5)
    lines, want, at = ["#xcounts", "#c0 5"], [], 0
    for c in range(12):
        lines.append(f"c{c}")
        at = 0
        for _ in range(r.choice([0, 1, 5, 400])):
            d, m, u = r.randint(1, 90), r.randint(0, 9), r.randint(0, 9)
            at += d
            lines.append(f"{d}\t{m}\t{u}")
            want.append((f"c{c}", at, m, u))
    (tmp_path / "x").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("150b", "700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = T.parse_xcounts(T.number_lines(T.lines(spark, str(tmp_path / "x"))))
            assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
