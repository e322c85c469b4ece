"""Queries through the text formats: views are written as lines and parsed back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cytoframe.catalog import query
from cytoframe.catalog.sites import one
from cytoframe.catalog.sql import V
from cytoframe.operators import sites as S
from cytoframe.sources import adapters as A
from cytoframe.sources import text as T


@query(V("SELECT chrom, pos, strand, context, n_reads, n_meth FROM sites WHERE sample = 'A'", "sites"))
def counts_text(spark, d):
    return T.parse_counts(T.format_counts(one(spark, d))).select("chrom", "pos", "strand", "context", "n_reads", "n_meth")


@query("SELECT true AS sites, false AS cpg_only, false AS symmetric")
def counts_sniff(spark, d):
    return T.looks_like_counts(T.format_counts(one(spark, d)))


@query(V("SELECT chrom, max(pos) + 1 AS size FROM sites GROUP BY 1", "sites"))
def counts_header(spark, d):
    sizes = A.sites(spark, d).groupBy("chrom").agg((F.max("pos") + 1).alias("size")).withColumn("ord", F.substring("chrom", 4, 9).cast("long"))
    return T.header(T.format_header(sizes))


@query(V("SELECT chrom, pos, n_meth, n_reads - n_meth AS n_unmeth FROM sites WHERE sample = 'A' AND n_reads > 0", "sites"))
def xcounts_text(spark, d):
    rows = T.format_xcounts(S.to_deltas(one(spark, d)))
    numbered = rows.select(F.struct("chrom", "at").alias("ln"), "value")
    return T.parse_xcounts(numbered, F.col("ln.chrom"))


@query(V("SELECT chrom, start, stop, replace(name, ' ', '_') AS name, CAST(length(name) AS DOUBLE) AS score, strand FROM intervals", "intervals"))
def bed_text(spark, d):
    rows = A.intervals(spark, d).withColumn("name", F.replace("name", F.lit(" "), F.lit("_"))).withColumn("score", F.length("name"))
    return T.parse_bed(T.format_bed(rows))


@query(V("SELECT chrom, start, stop, 'X' || (row_number() OVER (PARTITION BY chrom ORDER BY start, stop) - 1) AS name FROM intervals", "intervals"))
def bed3_text(spark, d):
    return T.parse_bed(T.format_bed(A.intervals(spark, d), six=False)).select("chrom", "start", "stop", "name")


@query(V("SELECT chrom, seq FROM genome WHERE length(seq) > 0", "genome"))
def fasta_text(spark, d):
    g = A.genome(spark, d).where("length(seq) > 0")
    wrapped = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    return T.parse_fasta(g.select(F.concat("chrom", F.lit(" made from text\n"), wrapped, F.lit("\n")).alias("value")))


@query(V("SELECT qname AS name, seq FROM reads", "reads"))
def fastq_text(spark, d):
    r = A.reads(spark, d).select(F.col("qname").alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    four = r.select("name", "seq", "qual").select("name", F.posexplode(F.array(F.concat(F.lit("@"), "name"), F.col("seq"), F.lit("+"), F.col("qual"))).alias("k", "value"))
    order = Window.partitionBy(F.lit(0)).orderBy("name", "k")
    return T.parse_fastq(four.select("value", (F.row_number().over(order) - 1).alias("ln"))).select("name", "seq")


@query(V("SELECT qname, chrom, pos, strand, cigar, seq FROM (SELECT *, length(seq) || 'M' AS cigar FROM reads)", "reads"))
def sam_text(spark, d):
    return T.parse_sam(T.format_sam(A.reads(spark, d))).select("qname", "chrom", "pos", "strand", "cigar", "seq")


@query(V("SELECT chrom, pos, seq, count(*) AS n FROM epireads GROUP BY 1, 2, 3", "epireads"))
def epiread_text(spark, d):
    lines = A.epireads(spark, d).select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "seq").alias("value"))
    return T.parse_epireads(lines).groupBy("chrom", "pos", "seq").agg(F.count(F.lit(1)).alias("n"))


@query(V("SELECT chrom, pos, CAST(coalesce(sum(n_reads) FILTER (sample = 'N'), 0) AS DOUBLE) AS n_reads, CAST(coalesce(sum(n_meth) FILTER (sample = 'R'), 0) AS DOUBLE) AS n_meth FROM sites GROUP BY 1, 2", "sites"))
def table_text(spark, d):
    t = S.merge_table(A.sites(spark, d), list("ANR"))
    lines = t.select(F.concat_ws("\t", "site", *[F.col(f"{s}_{k}").cast("string") for s in "ANR" for k in "RM"]).alias("value"))
    return T.parse_table(lines).select("chrom", "pos", F.col("n")[1].alias("n_reads"), F.col("m")[2].alias("n_meth"))


@query(V("SELECT chrom, pos, CASE WHEN pos % 5 = 0 THEN 1.0 ELSE round(CAST(n_meth AS DOUBLE) / n_reads, 4) END AS p FROM sites WHERE sample = 'A'", "sites"))
def regression_text(spark, d):
    p = F.when(F.col("pos") % 5 == 0, "NA").otherwise(F.round(F.col("n_meth").cast("double") / F.col("n_reads"), 4).cast("string"))
    return T.parse_regression(one(spark, d).select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "strand", "context", p).alias("value"))).select("chrom", "pos", "p")


@query(V("SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.n_reads, 0) AS n_reads, CASE WHEN a.n_reads IS NULL OR b.n_reads IS NULL THEN 0 ELSE CAST(floor(a.n_reads * (b.n_reads % 3) / 4.0 + 0.5) AS BIGINT) END AS n_meth FROM (SELECT * FROM sites WHERE sample = 'A') a FULL JOIN (SELECT * FROM sites WHERE sample = 'N') b ON a.chrom = b.chrom AND a.pos = b.pos", "sites"))
def bigwig_pair(spark, d):
    """Two tracks, depth and level, merged to counts."""
    track = lambda rows, v: T.parse_bedgraph(rows.select(F.concat_ws(" ", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), v.cast("string")).alias("value")))
    return T.merge_tracks(track(one(spark, d), F.col("n_reads")), track(one(spark, d, "N"), (F.col("n_reads") % 3) / 4))


@query(V("SELECT chrom, pos, n_reads FROM sites WHERE sample = 'A' AND chrom = 'chr3' AND pos >= 1000 AND pos < 1100", "sites"))
def point_lookup(spark, d):
    """Sites of a range, as a filter that reaches the scan where sites are stored sorted."""
    return one(spark, d).where("chrom = 'chr3' and pos >= 1000 and pos < 1100").select("chrom", "pos", "n_reads")


@query(V("SELECT chrom, count(*) AS lines FROM (SELECT chrom, unnest(range(1, length(seq))) AS p, seq FROM genome) WHERE seq[p:p + 1] = 'CG' GROUP BY 1", "genome"))
def kmer_wig(spark, d):
    """Lines of positions for each chromosome, less their declaration."""
    rows = T.format_wig(S.kmer_sites(A.genome(spark, d)))
    return rows.groupBy("chrom").agg((F.count(F.lit(1)) - 1).alias("lines"))


@query(V("SELECT a.chrom, a.pos, round(CAST(a.n_meth AS DOUBLE) / a.n_reads, 3) AS score, a.n_meth AS meth_a, b.n_reads - b.n_meth AS unmeth_b FROM sites a JOIN sites b ON a.sample = 'A' AND b.sample = 'N' AND a.chrom = b.chrom AND a.pos = b.pos", "sites"))
def methdiff_text(spark, d):
    a, b = one(spark, d), one(spark, d, "N").select("chrom", "pos", F.col("n_meth").alias("mb"), F.col("n_reads").alias("nb"))
    cells = ["chrom", F.col("pos").cast("string"), "strand", "context", F.round(F.col("n_meth") / F.col("n_reads"), 3).cast("string"), *[x.cast("string") for x in (F.col("n_meth"), F.col("n_reads") - F.col("n_meth"), F.col("mb"), F.col("nb") - F.col("mb"))]]
    return T.parse_diffs(a.join(b, ["chrom", "pos"]).select(F.concat_ws("\t", *cells).alias("value"))).select("chrom", "pos", "score", "meth_a", "unmeth_b")


@query(V("SELECT chrom AS from_chrom, pos AS from_pos, 'chr2' AS to_chrom, pos + 7 AS to_pos, strand AS to_strand FROM sites WHERE sample = 'A'", "sites"))
def lift_index_text(spark, d):
    return T.parse_lift_index(one(spark, d).select(F.concat_ws(" ", "chrom", F.col("pos").cast("string"), F.lit("chr2"), (F.col("pos") + 7).cast("string"), "strand").alias("value")))


@query("SELECT 'chr' || c_custkey AS chrom, c_custkey * 10 AS size FROM customer")
def sizes_text(spark, d):
    rows = A.table(spark, d, "customer")
    return T.parse_sizes(rows.select(F.concat(F.lit("chr"), F.col("c_custkey").cast("string"), F.lit("\t"), (F.col("c_custkey") * 10).cast("string")).alias("value")))


@query(V("SELECT chrom, pos, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (sample = '{s}'), 0) AS DOUBLE) AS {s}_{k}" for s in "ANR" for k, c in (("n", "n_reads"), ("m", "n_meth"))) + " FROM sites WHERE chrom = 'chr2' AND pos >= 500 AND pos < 900 GROUP BY 1, 2", "sites"))
def table_lookup(spark, d):
    """Rows of a merged table in a range."""
    t = S.merge_table(A.sites(spark, d), list("ANR"))
    lines = t.select(F.concat_ws("\t", "site", *[F.col(f"{s}_{k}").cast("string") for s in "ANR" for k in "RM"]).alias("value"))
    rows = T.lookup_sites(T.parse_table(lines), "chr2", 500, 900)
    return rows.select("chrom", "pos", *[F.col(k)[i].alias(f"{s}_{k}") for i, s in enumerate("ANR") for k in "nm"])


@query(V("SELECT chrom, pos, read, seq FROM epireads WHERE chrom = 'chrF' AND pos < 60 AND pos + length(seq) > 50", "epireads"))
def epiread_lookup(spark, d):
    """Reads with a site in a range."""
    return T.lookup_reads(A.epireads(spark, d).withColumn("stop", F.col("pos") + F.length("seq")), "chrF", 50, 60).drop("stop")


@query(V("SELECT CAST(k - 1 AS INTEGER) AS at, value FROM (SELECT 'sites: ' || count(*) AS a, 'reads: ' || CAST(sum(n_reads) AS BIGINT) AS b, 'deepest: ' || max(n_reads) AS c, 'none: NA' AS e FROM sites) UNPIVOT (value FOR name IN (a, b, c, e)) JOIN (VALUES ('a', 1), ('b', 2), ('c', 3), ('e', 4)) v(name, k) USING (name)", "sites"))
def summary_lines(spark, d):
    row = A.sites(spark, d).agg(F.count(F.lit(1)).alias("sites"), F.sum("n_reads").alias("reads"), F.max("n_reads").alias("deepest"), F.lit(None).cast("long").alias("none"))
    return T.format_summary(row)


@query(V("SELECT '{\"sample\":\"' || sample || '\",\"sites\":' || count(*) || ',\"none\":null}' AS value FROM sites GROUP BY sample", "sites"))
def summary_json(spark, d):
    return T.format_json(A.sites(spark, d).groupBy("sample").agg(F.count(F.lit(1)).alias("sites"), F.lit(None).cast("long").alias("none")))
