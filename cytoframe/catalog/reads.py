"""Queries over reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoframe.catalog import query
from cytoframe.catalog.sites import CYTOSINES
from cytoframe.catalog.sql import RATIOS, V, counters
from cytoframe.operators import levels as L
from cytoframe.operators import reads as R
from cytoframe.operators import sites as S
from cytoframe.operators.many import FromReads
from cytoframe.sources import adapters as A

#: Bases of reads: place in the read, reference position, and base as sequenced.
BASES = ", b AS (SELECT qname, chrom, strand, j AS fpos, CASE WHEN strand = '+' THEN pos + j ELSE pos + length(seq) - 1 - j END AS rpos, seq[j + 1] AS o FROM (SELECT *, unnest(range(0, length(seq))) AS j FROM reads))"
CYT = f", c AS MATERIALIZED ({CYTOSINES})"
PER = ", d AS (SELECT chrom, rpos, " + ", ".join(f"count(*) FILTER (strand = '{s}' AND o = '{x}') AS {n}{x}" for s, n in (("+", "p"), ("-", "n")) for x in "ACGT") + " FROM b GROUP BY 1, 2)"
COUNTS = PER + """, k AS (SELECT c.chrom, c.pos, c.strand, coalesce(CASE WHEN c.strand = '+' THEN pC ELSE nC END, 0) AS n_meth, coalesce(CASE WHEN c.strand = '+' THEN pC + pT ELSE nC + nT END, 0) AS n_reads,
    c.context || CASE WHEN coalesce(CASE WHEN c.strand = '+' THEN 2 * nG < nA + nC + nG + nT ELSE 2 * pG < pA + pC + pG + pT END, false) THEN 'x' ELSE '' END AS context FROM c LEFT JOIN d ON c.chrom = d.chrom AND c.pos = d.rpos)"""


def calls(spark, d, covered_only=False):
    return R.counts(A.reads(spark, d), S.cytosines(A.genome(spark, d)), covered_only)


@query(V(BASES + CYT + COUNTS + " SELECT chrom, pos, strand, context, n_meth, n_reads FROM k WHERE n_reads > 0", "genome", "reads"))
def counts_covered(spark, d):
    return calls(spark, d, True)


@query(V(BASES + CYT + COUNTS + " SELECT chrom, strand, context, count(*) AS sites, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM k GROUP BY 1, 2, 3", "genome", "reads"))
def counts(spark, d):
    """All cytosines, summed by chromosome, strand and context."""
    return calls(spark, d).groupBy("chrom", "strand", "context").agg(F.count(F.lit(1)).alias("sites"), F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"))


@query(V(BASES + CYT + COUNTS + ", known AS (SELECT * FROM k WHERE n_reads > 0) SELECT c.chrom, c.strand, c.context, count(*) AS sites, CAST(sum(c.pos) AS BIGINT) AS positions, CAST(sum(coalesce(x.n_meth, 0)) AS BIGINT) AS n_meth, CAST(sum(coalesce(x.n_reads, 0)) AS BIGINT) AS n_reads, count(*) FILTER (x.n_reads > 0) AS found FROM c LEFT JOIN known x ON c.chrom = x.chrom AND c.pos = x.pos WHERE c.chrom IN (SELECT chrom FROM known) GROUP BY 1, 2, 3", "genome", "reads"))
def recovered(spark, d):
    """Counts of the covered sites, with the missing sites of their chromosomes restored."""
    return by_kind(S.recovered(calls(spark, d, True), S.cytosines(A.genome(spark, d))))


def by_kind(rows):
    covered = F.count(F.when(F.col("n_reads") > 0, 1)).alias("found")
    return rows.groupBy("chrom", "strand", "context").agg(F.count(F.lit(1)).alias("sites"), F.sum("pos").alias("positions"), F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"), covered)


@query(V(BASES + CYT + COUNTS + ", known AS (SELECT * FROM k WHERE n_reads > 0) SELECT c.chrom, c.strand, c.context, count(*) AS sites, CAST(sum(c.pos) AS BIGINT) AS positions, CAST(sum(coalesce(x.n_meth, 0)) AS BIGINT) AS n_meth, CAST(sum(coalesce(x.n_reads, 0)) AS BIGINT) AS n_reads, count(*) FILTER (x.n_reads > 0) AS found FROM c LEFT JOIN known x ON c.chrom = x.chrom AND c.pos = x.pos WHERE c.chrom IN (SELECT chrom FROM known) GROUP BY 1, 2, 3", "genome", "reads"))
def unxcounts(spark, d):
    """Compact counts encoded and decoded, with strand, context and missing sites from the genome."""
    decoded = S.from_deltas(S.to_deltas(calls(spark, d, True)).withColumnRenamed("pos", "line"), "line").select("chrom", "pos", "n_meth", (F.col("n_meth") + F.col("n_unmeth")).alias("n_reads"))
    return by_kind(S.recovered(decoded, S.cytosines(A.genome(spark, d))))


INDEX = ", ix AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i FROM (SELECT chrom, CAST(p - 1 AS BIGINT) AS pos FROM (SELECT chrom, seq, unnest(range(1, length(seq))) AS p FROM genome) WHERE seq[p:p + 1] = 'CG'))"


@query(V(BASES + INDEX + ", s AS (SELECT qname, b.chrom, i, CASE WHEN o IN ('C', 'T') THEN o ELSE 'N' END AS st FROM b JOIN ix ON ix.chrom = b.chrom AND ix.pos = CASE WHEN strand = '-' THEN rpos - 1 ELSE rpos END) SELECT qname, chrom, min(i) AS pos, string_agg(st, '' ORDER BY i) AS seq FROM s GROUP BY 1, 2 HAVING count(*) FILTER (st <> 'N') > 0", "genome", "reads"))
def states(spark, d):
    return R.states(A.reads(spark, d), R.cpg_index(A.genome(spark, d)))


HITS = CYT + ", h AS (SELECT fpos, b.strand, o FROM b JOIN c ON c.chrom = b.chrom AND c.pos = b.rpos AND c.strand = b.strand WHERE c.context <> 'CpG')"
RATES = """CAST(count(*) FILTER (strand = '+' AND o IN ('C', 'T')) AS BIGINT) AS total_plus, count(*) FILTER (strand = '+' AND o = 'T') AS converted_plus, count(*) FILTER (strand = '-' AND o IN ('C', 'T')) AS total_minus, count(*) FILTER (strand = '-' AND o = 'T') AS converted_minus,
    count(*) FILTER (o IN ('C', 'T')) AS total, count(*) FILTER (o = 'T') AS converted, count(*) FILTER (o IN ('A', 'G')) AS errors, count(*) AS valid,
    round(CAST(count(*) FILTER (strand = '+' AND o = 'T') AS DOUBLE) / greatest(1, count(*) FILTER (strand = '+' AND o IN ('C', 'T'))), 6) AS rate_plus, round(CAST(count(*) FILTER (strand = '-' AND o = 'T') AS DOUBLE) / greatest(1, count(*) FILTER (strand = '-' AND o IN ('C', 'T'))), 6) AS rate_minus,
    round(CAST(count(*) FILTER (o = 'T') AS DOUBLE) / greatest(1, count(*) FILTER (o IN ('C', 'T'))), 6) AS rate, round(CAST(count(*) FILTER (o IN ('A', 'G')) AS DOUBLE) / greatest(1, count(*)), 6) AS error_rate"""


def conversion(spark, d):
    return R.conversion(A.reads(spark, d), A.genome(spark, d))


@query(V(BASES + HITS + f" SELECT CAST(fpos AS BIGINT) AS fpos, {RATES} FROM h GROUP BY 1", "genome", "reads"))
def bsrate(spark, d):
    return R.conversion_rates(conversion(spark, d), ("fpos",))


@query(V(BASES + HITS + f" SELECT {RATES} FROM h", "genome", "reads"))
def bsrate_summary(spark, d):
    return R.conversion_rates(conversion(spark, d))


@query(V(BASES + HITS + ", r AS (SELECT fpos, strand, count(*) FILTER (o IN ('C', 'T')) AS total, count(*) FILTER (o = 'T') AS t FROM h GROUP BY 1, 2) SELECT CAST(fpos AS BIGINT) AS fpos, CAST(sum(total) AS BIGINT) AS total, round(CAST(sum(t) AS DOUBLE) / greatest(1, sum(total)), 6) AS rate FROM r GROUP BY 1", "genome", "reads"))
def merge_bsrate(spark, d):
    """The reports of the two strands, merged."""
    parts = conversion(spark, d).select("fpos", "total", (F.col("converted").cast("double") / F.greatest(F.lit(1), "total")).alias("rate"))
    return R.merge_rates(parts)


@query(V(BASES + CYT + ", h AS (SELECT qname, b.chrom, o FROM b JOIN c ON c.chrom = b.chrom AND c.pos = b.rpos AND c.strand = b.strand WHERE c.context <> 'CpG' AND o IN ('C', 'T')), r AS (SELECT count(*) AS n, count(*) FILTER (o = 'T') AS t FROM h GROUP BY qname, chrom) SELECT least(19, t * 20 // n) AS bin, count(*) AS reads FROM r GROUP BY 1", "genome", "reads"))
def bsrate_histogram(spark, d):
    return R.conversion_histogram(A.reads(spark, d), A.genome(spark, d))


@query(V("SELECT qname, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, CASE WHEN length(seq) % 2 = 0 THEN 'T' ELSE 'A' END AS conversion FROM reads", "reads"))
def flip_conversion(spark, d):
    rows = A.reads(spark, d).withColumn("conversion", F.when(F.length("seq") % 2 == 0, "A").otherwise("T"))
    return R.flip_conversion(rows).select("qname", "strand", "seq", "conversion")


@query(V("SELECT chrom, start, stop, strand, count(*) AS copies, min(read) AS first_read FROM alignments GROUP BY 1, 2, 3, 4", "alignments"))
def uniq(spark, d):
    return R.duplicate_groups(A.alignments(spark, d))


@query(V("SELECT copies, count(*) AS reads FROM (SELECT count(*) AS copies FROM alignments GROUP BY chrom, start, stop, strand) GROUP BY 1", "alignments"))
def uniq_histogram(spark, d):
    """Of the reads that are kept, one of each group at random: how many stand for so many copies."""
    return R.unique_reads(A.alignments(spark, d)).groupBy("copies").agg(F.count(F.lit(1)).alias("reads"))


@query(V("SELECT CAST(sum(n) AS BIGINT) AS reads_in, count(*) AS reads_out, count(*) FILTER (n > 1) AS duplicated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_groups FROM (SELECT count(*) AS n FROM alignments GROUP BY chrom, start, stop, strand)", "alignments"))
def uniq_stats(spark, d):
    return R.duplicate_stats(A.alignments(spark, d))


MATES = "SELECT page_id, regexp_replace(translate(lower(url), 'etaoinshrdlu', 'CGTACGTACGTA'), '[^ACGT]', '', 'g') AS s1, regexp_replace(translate(lower(html), 'etaoinshrdlu', 'CGTACGTACGTA'), '[^ACGT]', '', 'g') AS s2 FROM pages"


def mates(spark, d):
    """Two ends of fragments; every second pair is a hairpin of its first end."""
    letters = lambda c: F.regexp_replace(F.translate(F.lower(c), "etaoinshrdlu", "CGTACGTACGTA"), "[^ACGT]", "")
    rows = A.table(spark, d, "pages").select(F.col("page_id").alias("name"), letters("url").alias("seq1"), letters("html").alias("seq2"))
    return rows.withColumn("seq2", F.when(F.col("name") % 2 == 0, F.translate("seq1", "TG", "CA")).otherwise(F.col("seq2")))


@query(f"""WITH m AS ({MATES}), p AS (SELECT page_id, s1, CASE WHEN page_id % 2 = 0 THEN translate(s1, 'TG', 'CA') ELSE s2 END AS s2 FROM m), x AS (SELECT page_id, s1[j] AS a, s2[j] AS b FROM (SELECT *, unnest(range(1, least(length(s1), length(s2)) + 1)) AS j FROM p WHERE length(s1) >= 20 AND length(s2) >= 20))
    SELECT page_id AS name, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (a = b OR a || b IN ('TC', 'GA')) AS INTEGER) AS matching, round(CAST(count(*) FILTER (a = b OR a || b IN ('TC', 'GA')) AS DOUBLE) / count(*), 6) AS share,
    least(19, 20 * count(*) FILTER (a = b OR a || b IN ('TC', 'GA')) // count(*)) AS bin, count(*) FILTER (a = b OR a || b IN ('TC', 'GA')) > 0.95 * count(*) AS hairpin FROM x GROUP BY 1""")
def cleanhp(spark, d):
    return R.hairpins(mates(spark, d))


#: Logarithms of 0.495 / 0.25 and 0.25 / 0.005, the odds of the two models by base.
@query(f"""WITH m AS ({MATES}), p AS (SELECT page_id AS name, 1 / (1 + exp(greatest(-500, least(500, ln(0.495 / 0.25) * n('A') + ln(0.25 / 0.005) * n('C') - ln(0.25 / 0.005) * n('G') - ln(0.495 / 0.25) * n('T'))))) AS t FROM m)
    SELECT count(*) AS reads, round(avg(t), 6) AS fraction, CASE WHEN avg(t) > 0.9 THEN 'wgbs' WHEN avg(t) < 0.1 THEN 'pbat' ELSE 'rpbat' END AS protocol,
    CASE WHEN avg(t) > 0.99 OR avg(t) < 0.01 OR (avg(t) > 0.2 AND avg(t) < 0.8) THEN 'high' ELSE 'low' END AS confidence FROM p""".replace("n('A')", "(length(s1) - length(replace(s1, 'A', '')))").replace("n('C')", "(length(s1) - length(replace(s1, 'C', '')))").replace("n('G')", "(length(s1) - length(replace(s1, 'G', '')))").replace("n('T')", "(length(s1) - length(replace(s1, 'T', '')))"))
def guessprotocol(spark, d):
    return R.guess_protocol(mates(spark, d).select("name", F.col("seq1").alias("seq")))


@query(V("SELECT qname AS name, chrom, pos, '+' AS strand, length(seq) || 'M' AS cigar, seq, CAST(2 AS INTEGER) AS ends FROM reads", "reads"))
def format_mates(spark, d):
    """Reads split into overlapping ends, and merged again."""
    n, cut = F.length("seq"), F.ceil(F.length("seq") * 0.6).cast("int")
    rows = A.reads(spark, d)
    one = rows.select(F.col("qname").alias("name"), F.lit(1).alias("end"), "chrom", "pos", F.lit("+").alias("strand"), F.concat(cut.cast("string"), F.lit("M")).alias("cigar"), F.substr("seq", F.lit(1), cut).alias("seq"))
    two = rows.select(F.col("qname").alias("name"), F.lit(2).alias("end"), "chrom", (F.col("pos") + n - cut).alias("pos"), F.lit("-").alias("strand"), F.concat(cut.cast("string"), F.lit("M")).alias("cigar"), F.substr("seq", n - cut + 1, cut).alias("seq"))
    return R.merge_mates(one.union(two))


@query("SELECT CAST(k AS INTEGER) AS suffix, max(n) AS most FROM (SELECT k, left(name, length(name) - k) AS stem, count(*) AS n FROM (SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS name FROM conversations), range(0, 6) r(k) WHERE length(name) > k GROUP BY 1, 2) GROUP BY 1")
def suffix_lengths(spark, d):
    names = A.table(spark, d, "conversations").select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"))
    return R.suffix_length(names)


@query("SELECT 'chr' || l_linestatus AS chrom, l_partkey AS pos, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, count(DISTINCT l_orderkey) AS n_reads, " + ", ".join(f"round(coalesce(sum(CAST(l_quantity * 5 AS BIGINT)) FILTER (l_linenumber % 2 = {k}), 0) / (255.0 * count(DISTINCT l_orderkey)), 6) AS {n}" for k, n in ((0, "hydroxy"), (1, "methyl"))) + " FROM lineitem GROUP BY 1, 2, 3")
def counts_nano(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.concat(F.lit("chr"), "l_linestatus").alias("chrom"), F.col("l_partkey").alias("pos"), F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("m").alias("kind"), (F.col("l_quantity") * 5).cast("long").alias("prob"), F.col("l_orderkey").alias("read"))
    return R.nano_counts(rows)


@query(V(""", c AS (SELECT qname, chrom, pos, strand, length(seq) AS n, list_filter(range(length(seq)), lambda i: seq[i + 1] = 'C') AS p FROM reads),
    m AS (SELECT qname, chrom, strand, CASE WHEN strand = '+' THEN pos + p[k] ELSE pos + n - 1 - p[k] END AS pos, kind, prob FROM c JOIN (VALUES (1, 'h', 10), (3, 'h', 20), (1, 'm', 200), (3, 'm', 220)) v(k, kind, prob) ON len(p) >= k)
    SELECT chrom, pos, strand, count(DISTINCT qname) AS n_reads, round(coalesce(sum(prob) FILTER (kind = 'h'), 0) / (255.0 * count(DISTINCT qname)), 6) AS hydroxy, round(coalesce(sum(prob) FILTER (kind = 'm'), 0) / (255.0 * count(DISTINCT qname)), 6) AS methyl FROM m GROUP BY 1, 2, 3""", "reads"))
def modification_tags(spark, d):
    """Reads with base-modification tags, parsed and summed."""
    rows = A.reads(spark, d).select(F.col("qname").alias("read"), "chrom", "pos", "strand", "seq", F.lit("C+h,0,1;C+m,0,1;").alias("mm"), F.array(*map(F.lit, (10, 20, 200, 220))).alias("ml"))
    return R.nano_counts(R.parse_modifications(rows))


def many(spark, d):
    return FromReads(A.reads(spark, d), A.genome(spark, d))


#: The kinds of sites of which levels are reported, from the counts k.
KINDS = "SELECT 'cytosines' AS kind, * EXCLUDE (chrom, pos, strand) FROM k UNION ALL SELECT CASE left(context, 3) WHEN 'CpG' THEN 'cpg' WHEN 'CHH' THEN 'chh' WHEN 'CCG' THEN 'ccg' ELSE 'cxg' END, * EXCLUDE (chrom, pos, strand) FROM k UNION ALL SELECT 'cpg_symmetric', n_meth, n_reads, context FROM (SELECT CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_reads) AS BIGINT) AS n_reads, CASE WHEN bool_or(context LIKE '%x') THEN 'CpGx' ELSE 'CpG' END AS context FROM k WHERE context LIKE 'CpG%' GROUP BY chrom, CASE WHEN strand = '-' THEN pos - 1 ELSE pos END HAVING count(*) = 2)"


@query(V(BASES + CYT + COUNTS + f" SELECT kind, {RATIOS} FROM (SELECT kind, {counters()} FROM ({KINDS}) GROUP BY 1)", "genome", "reads"))
def many_levels(spark, d):
    """Levels straight from reads, as one of the outputs that share a scan."""
    return many(spark, d).levels


@query(V(BASES + CYT + COUNTS + """, y AS (SELECT chrom, CASE WHEN strand = '-' THEN pos - 1 ELSE pos END AS pos, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM k WHERE context LIKE 'CpG%' GROUP BY 1, 2) SELECT * FROM y WHERE n_reads > 0""", "genome", "reads"))
def many_sym(spark, d):
    return many(spark, d).sym


@query(V(BASES + HITS + f" SELECT CAST(fpos AS BIGINT) AS fpos, {RATES} FROM h GROUP BY 1", "genome", "reads"))
def many_bsrate(spark, d):
    return many(spark, d).bsrate


@query(V(BASES + CYT + COUNTS + " SELECT chrom, pos, pos - coalesce(lag(pos) OVER (PARTITION BY chrom ORDER BY pos), 0) AS delta, n_meth, n_reads - n_meth AS n_unmeth FROM k WHERE n_reads > 0", "genome", "reads"))
def many_xcounts(spark, d):
    return many(spark, d).xcounts


@query(V(BASES + INDEX + ", s AS (SELECT qname, b.chrom, i, CASE WHEN o IN ('C', 'T') THEN o ELSE 'N' END AS st FROM b JOIN ix ON ix.chrom = b.chrom AND ix.pos = CASE WHEN strand = '-' THEN rpos - 1 ELSE rpos END) SELECT qname, chrom, min(i) AS pos, string_agg(st, '' ORDER BY i) AS seq FROM s GROUP BY 1, 2 HAVING count(*) FILTER (st <> 'N') > 0", "genome", "reads"))
def many_states(spark, d):
    return many(spark, d).states


@query(f"SELECT name, length(seq1) AS n FROM (SELECT page_id AS name, s1 AS seq1, CASE WHEN page_id % 2 = 0 THEN translate(s1, 'TG', 'CA') ELSE s2 END AS seq2 FROM ({MATES})) p WHERE length(seq1) >= 20 AND length(seq2) >= 20 AND NOT (SELECT count(*) FILTER (a = b OR a || b IN ('TC', 'GA')) > 0.95 * count(*) FROM (SELECT seq1[j] AS a, seq2[j] AS b FROM (SELECT unnest(range(1, least(length(seq1), length(seq2)) + 1)) AS j)))")
def cleanhp_kept(spark, d):
    """The pairs that are left."""
    return R.clean_hairpins(mates(spark, d)).select("name", F.length("seq1").alias("n"))


#: Mates weigh against their first reads.
@query(f"""WITH m AS ({MATES}), p AS (SELECT page_id AS name, 1 / (1 + exp(greatest(-500, least(500, ln(0.495 / 0.25) * a + ln(0.25 / 0.005) * c - ln(0.25 / 0.005) * g - ln(0.495 / 0.25) * t)))) AS t
    FROM (SELECT page_id, """ + ", ".join(f"(length(s1) - length(replace(s1, '{x}', ''))) - (length(s2) - length(replace(s2, '{x}', ''))) AS {x.lower()}" for x in "ACGT") + """ FROM (SELECT page_id, s1, CASE WHEN page_id % 2 = 0 THEN translate(s1, 'TG', 'CA') ELSE s2 END AS s2 FROM m)))
    SELECT count(*) AS reads, round(avg(t), 6) AS fraction, CASE WHEN avg(t) > 0.9 THEN 'wgbs' WHEN avg(t) < 0.1 THEN 'pbat' ELSE 'rpbat' END AS protocol,
    CASE WHEN avg(t) > 0.99 OR avg(t) < 0.01 OR (avg(t) > 0.2 AND avg(t) < 0.8) THEN 'high' ELSE 'low' END AS confidence FROM p""")
def guessprotocol_pairs(spark, d):
    return R.guess_protocol(mates(spark, d).select("name", F.col("seq1").alias("seq"), "seq2"))


@query(V("SELECT qname, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN length(seq) % 3 = 0 THEN 'A' ELSE 'T' END AS conversion, CAST(length(seq) % 5 AS BIGINT) AS nm, '*' AS qual FROM reads", "reads"))
def format_tags(spark, d):
    """Alignments of a mapper that names the conversion GA or CT, in one form."""
    n = F.length("seq")
    tags = F.create_map(F.lit("XR"), F.when(n % 3 == 0, "GA").otherwise("CT"), F.lit("NM"), (n % 5).cast("string"))
    return R.standardize(A.reads(spark, d).withColumn("tags", tags), "bismark").select("qname", "seq", "conversion", "nm", "qual")
