"""Queries over sites: filters, strands, samples, coordinates, genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.catalog import query
from cytoframe.catalog.sql import PAIRS, RATIOS, V, counters
from cytoframe.functions import expr as E
from cytoframe.operators import levels as L
from cytoframe.operators import sites as S
from cytoframe.sources import adapters as A

SITE = ["sample", "chrom", "pos", "strand", "context", "n_reads", "n_meth"]


def one(spark: SparkSession, d: str, sample: str = "A") -> DataFrame:
    return A.sites(spark, d).where(F.col("sample") == sample).drop("sample")


KINDS = "SELECT sample, 'cytosines' AS kind, n_meth, n_reads, context FROM sites UNION ALL SELECT sample, CASE left(context, 3) WHEN 'CpG' THEN 'cpg' WHEN 'CHH' THEN 'chh' WHEN 'CCG' THEN 'ccg' ELSE 'cxg' END, n_meth, n_reads, context FROM sites"


@query(V(f"SELECT kind, {RATIOS} FROM (SELECT kind, {counters()} FROM ({KINDS} UNION ALL SELECT sample, 'cpg_symmetric', n_meth, n_reads, context FROM ({PAIRS}) WHERE strands = 2) WHERE sample = 'A' GROUP BY 1)", "sites"))
def levels(spark, d):
    return L.levels(one(spark, d))


@query(V(f"SELECT sample, kind, {RATIOS} FROM (SELECT sample, kind, {counters()} FROM ({KINDS} UNION ALL SELECT sample, 'cpg_symmetric', n_meth, n_reads, context FROM ({PAIRS}) WHERE strands = 2) GROUP BY 1, 2)", "sites"))
def levels_by_sample(spark, d):
    return L.levels(A.sites(spark, d), ("sample",))


RAW = "total_sites, sites_covered, total_c, total_t, max_depth, mutations, called_meth, called_unmeth"


@query(V(f"SELECT sample, total_sites, sites_covered, total_c, total_t, max_depth, mutations, called_meth, called_unmeth, round(total_meth, 6) AS total_meth FROM (SELECT sample, {counters()} FROM sites GROUP BY 1)", "sites"))
def levels_merged(spark, d):
    """Counters by chromosome, merged."""
    parts = A.sites(spark, d).groupBy("sample", "chrom").agg(*L.counters())
    return L.merge_counters(parts, ("sample",)).withColumn("total_meth", F.round("total_meth", 6))


@query(V("SELECT s.sample, s.chrom, s.pos, s.n_reads FROM (SELECT sample, chrom, pos, context, CASE WHEN pos % 7 = 0 THEN 0 ELSE n_reads END AS n_reads FROM sites) s WHERE n_reads > 0 OR right(context, 1) = 'x'", "sites"))
def covered(spark, d):
    rows = A.sites(spark, d).withColumn("n_reads", F.when(F.col("pos") % 7 == 0, 0).otherwise(F.col("n_reads")))
    return S.covered(rows).select("sample", "chrom", "pos", "n_reads")


@query(V("SELECT chrom, pos, strand, context, n_reads, n_meth FROM sites s WHERE sample = 'A' AND EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = s.chrom AND s.pos >= i.start AND s.pos < i.stop)", "sites", "intervals"))
def selectsites(spark, d):
    return S.select_sites(one(spark, d), A.intervals(spark, d).select("chrom", "start", "stop")).select("chrom", "pos", "strand", "context", "n_reads", "n_meth")


@query(V("SELECT chrom, context, count(*) AS sites FROM sites WHERE context IN ('CpG', 'CpGx') AND n_reads > 0 GROUP BY 1, 2", "sites"))
def cpg_only(spark, d):
    return A.sites(spark, d).where(E.is_cpg() & (F.col("n_reads") > 0)).groupBy("chrom", "context").agg(F.count(F.lit(1)).alias("sites"))


@query(V("SELECT context, count(*) AS sites, context IN ('CpG', 'CpGx') AS cpg, context IN ('CHH', 'CHHx') AS chh, context = 'CCG' AS ccg, context = 'CXG' AS cxg, context IN ('CpGx', 'CHHx') AS mutated, replace(context, 'x', '') AS bare, replace(context, 'x', '') || 'x' AS marked FROM sites GROUP BY context", "sites"))
def contexts_of_sites(spark, d):
    rows = A.sites(spark, d).groupBy("context").agg(F.count(F.lit(1)).alias("sites"))
    return rows.select("context", "sites", E.is_cpg().alias("cpg"), E.is_chh().alias("chh"), E.is_ccg().alias("ccg"), E.is_cxg().alias("cxg"), E.is_mutated().alias("mutated"), E.set_mutated("context", F.lit(False)).alias("bare"), E.set_mutated("context", F.lit(True)).alias("marked"))


@query(V("SELECT chrom, pos, CASE WHEN lo > 0 THEN 1 ELSE 0 END AS in_every FROM (SELECT chrom, pos, min(n) AS lo, max(n) AS hi FROM (SELECT chrom, pos, CASE WHEN pos % 5 = 0 AND sample = 'A' THEN 0 ELSE n_reads END AS n FROM sites) GROUP BY 1, 2) WHERE hi > 0", "sites"))
def covered_in_replicates(spark, d):
    rows = A.sites(spark, d).withColumn("n_reads", F.when((F.col("pos") % 5 == 0) & (F.col("sample") == "A"), 0).otherwise(F.col("n_reads")))
    every = S.covered_in(rows, True).withColumn("in_every", F.lit(1))
    return S.covered_in(rows, False).join(every, ["chrom", "pos"], "left").na.fill(0, ["in_every"])


@query(V("SELECT chrom, pos, n_reads, abs(n_reads - 2 * n_meth) AS n_meth FROM sites WHERE sample = 'A'", "sites"))
def fold_partial(spark, d):
    return S.fold_partial(one(spark, d)).select("chrom", "pos", "n_reads", "n_meth")


@query(V(f"SELECT sample, chrom, pos, context, n_meth, n_reads, strands, round(CAST(n_meth AS DOUBLE) / n_reads, 6) AS meth FROM ({PAIRS})", "sites"))
def sym(spark, d):
    out = S.symmetric(A.sites(spark, d), ("sample", "chrom"))
    return out.select("sample", "chrom", "pos", "context", "n_meth", "n_reads", "strands", F.round(E.level(), 6).alias("meth"))


SAMPLES = ["A", "N", "R"]
FULL = """SELECT chrom, pos, coalesce(a.strand, n.strand, r.strand) AS strand, coalesce(a.context, n.context, r.context) AS context,
    coalesce(a.n_meth, 0) + coalesce(n.n_meth, 0) + coalesce(r.n_meth, 0) AS n_meth, coalesce(a.n_reads, 0) + coalesce(n.n_reads, 0) + coalesce(r.n_reads, 0) AS n_reads
    FROM (SELECT * FROM sites WHERE sample = 'A') a FULL JOIN (SELECT * FROM sites WHERE sample = 'N') n USING (chrom, pos) FULL JOIN (SELECT * FROM sites WHERE sample = 'R') r USING (chrom, pos)"""


@query(V(f"SELECT chrom, pos, strand, context, n_meth, n_reads FROM ({FULL})", "sites"))
def merge_counts(spark, d):
    return S.merge_counts(A.sites(spark, d), keep_mutated=True)


@query(V("SELECT chrom || ':' || pos || ':' || strand || ':' || replace(context, 'x', '') AS site, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (sample = '{s}'), 0) AS BIGINT) AS {s}_{k}" for s in SAMPLES for k, c in (("R", "n_reads"), ("M", "n_meth"))) + " FROM sites GROUP BY 1", "sites"))
def merge_table(spark, d):
    return S.merge_table(A.sites(spark, d), SAMPLES)


@query(V("SELECT chrom || ':' || pos || ':' || strand || ':' || replace(context, 'x', '') AS site, " + ", ".join(f"CASE WHEN sum(n_reads) FILTER (sample = '{s}') >= 20 THEN round(CAST(sum(n_meth) FILTER (sample = '{s}') AS DOUBLE) / sum(n_reads) FILTER (sample = '{s}'), 6) END AS {s}_level" for s in SAMPLES) + " FROM sites GROUP BY 1", "sites"))
def merge_table_levels(spark, d):
    return S.merge_table(A.sites(spark, d), SAMPLES, "levels", 20)


INDEX = "SELECT DISTINCT chrom AS from_chrom, pos AS from_pos, 'to_' || chrom AS to_chrom, pos // 4 * 4 + 4 AS to_pos, strand AS to_strand FROM sites WHERE context <> 'CXG'"


def lift_index(spark, d) -> DataFrame:
    """Where the sites of all samples lie in another assembly, which lacks those of one context."""
    at = A.sites(spark, d).where("context <> 'CXG'").select("chrom", "pos", "strand").distinct()
    return at.select(F.col("chrom").alias("from_chrom"), F.col("pos").alias("from_pos"), F.concat(F.lit("to_"), "chrom").alias("to_chrom"), (F.floor(F.col("pos") / 4) * 4 + 4).alias("to_pos"), F.col("strand").alias("to_strand"))


@query(V(f"SELECT to_chrom AS chrom, CASE WHEN to_strand = '-' THEN to_pos - 1 ELSE to_pos END AS pos, '+' AS strand, context, n_meth, n_reads FROM sites JOIN ({INDEX}) ON chrom = from_chrom AND pos = from_pos WHERE sample = 'A'", "sites"))
def fastlift(spark, d):
    return S.lift(one(spark, d), lift_index(spark, d), plus_strand=True)


@query(V(f"SELECT chrom, pos, n_reads FROM sites WHERE sample = 'A' AND (chrom, pos) NOT IN (SELECT (from_chrom, from_pos) FROM ({INDEX}))", "sites"))
def fastlift_unlifted(spark, d):
    return S.unlifted(one(spark, d), lift_index(spark, d)).select("chrom", "pos", "n_reads")


LIFTED = f"SELECT to_chrom AS chrom, to_pos AS pos, to_strand AS strand, context, n_meth, n_reads FROM sites JOIN ({INDEX}) ON chrom = from_chrom AND pos = from_pos WHERE sample = 'A'"


@query(V(f"SELECT chrom, pos, strand, min(context) AS context, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM ({LIFTED}) GROUP BY 1, 2, 3", "sites"))
def liftfilter(spark, d):
    return S.merge_lifted(S.lift(one(spark, d), lift_index(spark, d)))


@query(V(f"SELECT chrom, pos, strand, context, n_meth, n_reads FROM ({LIFTED}) QUALIFY count(*) OVER (PARTITION BY chrom, pos, strand) = 1", "sites"))
def liftfilter_unique(spark, d):
    return S.merge_lifted(S.lift(one(spark, d), lift_index(spark, d)), unique=True)


@query(V("SELECT chrom, pos, len(list(DISTINCT sample)) AS samples FROM sites GROUP BY 1, 2 HAVING len(list(DISTINCT sample)) < 3", "sites"))
def replicate_check(spark, d):
    return S.inconsistent(A.sites(spark, d), 3)


@query(V("SELECT chrom, pos, pos - coalesce((SELECT max(p.pos) FROM sites p WHERE p.sample = 'A' AND p.chrom = s.chrom AND p.pos < s.pos), 0) AS delta, n_meth, n_reads - n_meth AS n_unmeth FROM sites s WHERE sample = 'A' AND n_reads > 0", "sites"))
def xcounts(spark, d):
    return S.to_deltas(one(spark, d))


@query(V("SELECT chrom, pos, n_meth, n_reads - n_meth AS n_unmeth FROM sites WHERE sample = 'A' AND n_reads > 0", "sites"))
def xcounts_roundtrip(spark, d):
    return S.from_deltas(S.to_deltas(one(spark, d)).withColumnRenamed("pos", "line"), "line")


CYTOSINES = """SELECT chrom, CAST(i - 1 AS BIGINT) AS pos, CASE WHEN b = 'C' THEN '+' ELSE '-' END AS strand,
    CASE WHEN b = 'C' THEN CASE WHEN regexp_matches(down, '^CG') THEN 'CpG' WHEN regexp_matches(down, '^C[ACTN][ACTN]') THEN 'CHH' WHEN regexp_matches(down, '^C[ATN]G') THEN 'CXG' ELSE 'CCG' END
         ELSE CASE WHEN regexp_matches(up, 'CG$') THEN 'CpG' WHEN regexp_matches(up, '[AGTN][AGTN]G$') THEN 'CHH' WHEN regexp_matches(up, 'C[ATN]G$') THEN 'CXG' ELSE 'CCG' END END AS context
    FROM (SELECT chrom, i, substr(seq, i, 1) AS b, substr(seq, i, 3) AS down, substr(seq, greatest(i - 2, 1), least(i, 3)) AS up FROM (SELECT chrom, seq, unnest(range(1, length(seq) + 1)) AS i FROM genome)) WHERE b IN ('C', 'G')"""


@query(V(f"SELECT chrom, strand, context, count(*) AS sites, CAST(sum(pos) AS BIGINT) AS positions FROM ({CYTOSINES}) GROUP BY 1, 2, 3", "genome"))
def contexts(spark, d):
    return S.cytosines(A.genome(spark, d)).groupBy("chrom", "strand", "context").agg(F.count(F.lit(1)).alias("sites"), F.sum("pos").alias("positions"))


@query(V("SELECT chrom, CAST(i AS BIGINT) AS pos FROM (SELECT chrom, seq, unnest(range(1, length(seq))) AS i FROM genome) WHERE seq[i] = 'C' AND seq[i + 1] = 'G'", "genome"))
def kmersites(spark, d):
    return S.kmer_sites(A.genome(spark, d))


#: The check sums the tail as a product of binomials by logarithms of gamma functions.
DIFF = """SELECT chrom, pos, round(sum(exp(lgamma(ma + ua) - lgamma(k + 1) - lgamma(ma + ua - k) + lgamma(mb + ub) - lgamma(ma + mb - k) - lgamma(ub - ma + k + 1)
    - lgamma(ma + ua + mb + ub - 1) + lgamma(ma + mb) + lgamma(ua + ub))), 6) AS score, ma - 1 AS meth_a, ua - 1 AS unmeth_a, mb - 1 AS meth_b, ub - 1 AS unmeth_b
    FROM (SELECT *, unnest(range(greatest(0, ma - ub), ma)) AS k FROM (SELECT a.chrom, a.pos, a.n_meth + 1 AS ma, a.n_reads - a.n_meth + 1 AS ua, b.n_meth + 1 AS mb, b.n_reads - b.n_meth + 1 AS ub
    FROM sites a JOIN sites b ON a.sample = 'A' AND b.sample = 'R' AND a.chrom = b.chrom AND a.pos = b.pos)) GROUP BY chrom, pos, ma, ua, mb, ub"""


@query(V(DIFF, "sites"))
def diff(spark, d):
    out = S.difference(one(spark, d, "A"), one(spark, d, "R"))
    return out.select("chrom", "pos", F.round("score", 6).alias("score"), "meth_a", "unmeth_a", "meth_b", "unmeth_b")
