"""Queries that depend on the order of positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoframe.catalog import query
from cytoframe.catalog.sites import one
from cytoframe.catalog.sql import V
from cytoframe.operators import ordered as O
from cytoframe.plans import ranges as P
from cytoframe.sources import adapters as A


def values(spark, d):
    return one(spark, d).select("chrom", "pos", (F.col("n_meth").cast("double") / F.col("n_reads")).alias("value"))


def with_p(spark, d):
    """Levels stand in for p-values."""
    return one(spark, d).select("chrom", "pos", (F.col("n_meth").cast("double") / F.col("n_reads")).alias("p"), (F.col("n_reads") % 7).cast("double").alias("diff"))


VALUES = ", v AS (SELECT chrom, pos, CAST(n_meth AS DOUBLE) / n_reads AS value FROM sites WHERE sample = 'A')"
SUMS = "count(*) AS n, round(CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END, 6) AS r, round(stddev_samp(x), 6) AS sd_x, round(stddev_samp(y), 6) AS sd_y, round(covar_pop(x, y) * count(*), 6) AS cov"


@query(V(VALUES + f" SELECT b.pos - a.pos AS distance, {SUMS.replace('(x', '(a.value').replace('y)', 'b.value)')} FROM v a JOIN v b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos <= a.pos + 60 GROUP BY 1 HAVING count(*) >= 20", "sites"))
def autocorr(spark, d):
    return O.autocorrelation(values(spark, d), 60, 20)


@query(V(VALUES + f" SELECT d AS distance, {SUMS} FROM (SELECT a.value AS x, b.value AS y, unnest(range(greatest(1, b.pos - a.pos - 2), least(b.pos - a.pos + 2, 40) + 1)) AS d FROM v a JOIN v b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos <= a.pos + 40) GROUP BY 1", "sites"))
def autocorr_window(spark, d):
    return O.autocorrelation(values(spark, d), 40, 1, width=2)


@query(V(VALUES + f" SELECT distance, {SUMS} FROM (SELECT b.pos - a.pos AS distance, a.value AS x, b.value AS y FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM v) a JOIN (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM v) b ON a.chrom = b.chrom AND b.i = a.i + 3) WHERE distance <= 20 GROUP BY 1", "sites"))
def autocorr_kth(spark, d):
    return O.kth_neighbour(values(spark, d), 3, 20)




@query(V(VALUES + f", r AS (SELECT DISTINCT v.* FROM v JOIN intervals i ON i.chrom = v.chrom AND v.pos >= i.start AND v.pos < i.stop) SELECT b.pos - a.pos AS distance, {SUMS.replace('(x', '(a.value').replace('y)', 'b.value)')} FROM r a JOIN r b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos <= a.pos + 20 GROUP BY 1", "sites", "intervals"))
def autocorr_regions(spark, d):
    """Over the sites inside any interval."""
    inside = P.point_in_interval(values(spark, d), P.merge_touching(A.intervals(spark, d).select("chrom", "start", "stop")), how="left_semi")
    return O.autocorrelation(inside, 20)


ENTROPY = """, s AS (SELECT chrom, read, pos, seq, unnest(range(0, length(seq))) AS j FROM epireads), p AS (SELECT chrom, pos + j AS i, CAST(count(*) FILTER (seq[j + 1] = 'C') AS DOUBLE) / greatest(1, count(*) FILTER (seq[j + 1] <> 'N')) AS share FROM s GROUP BY 1, 2),
 m AS (SELECT chrom, max(pos + length(seq)) AS n FROM epireads GROUP BY 1), w AS (SELECT m.chrom, unnest(range(0, n - 3)) AS w FROM m),
 x AS (SELECT w.chrom, w.w, e.read, CASE coalesce(nullif(CASE WHEN w.w + k.k >= e.pos THEN seq[w.w + k.k - e.pos + 1] ELSE '' END, ''), 'N') WHEN 'C' THEN 1.0 WHEN 'T' THEN 0.0 ELSE coalesce(p.share, 0) END AS c, k.k FROM w JOIN epireads e ON e.chrom = w.chrom AND e.pos < w.w + 4 AND e.pos + length(seq) > w.w CROSS JOIN range(0, 4) k(k) LEFT JOIN p ON p.chrom = w.chrom AND p.i = w.w + k.k),
 q AS (SELECT chrom, w, read, s.s, product(CASE WHEN (s.s >> k) & 1 = 1 THEN c ELSE 1 - c END) AS pr FROM x CROSS JOIN range(0, 16) s(s) GROUP BY ALL),
 a AS (SELECT chrom, w, s, avg(pr) AS p, count(*) AS reads FROM q GROUP BY ALL)
 SELECT chrom, w + 2 AS site, round(sum(CASE WHEN p > 0 THEN p * log2(p) END), 6) AS entropy, max(reads) AS reads FROM a GROUP BY 1, 2"""


@query(V(ENTROPY, "epireads"))
def entropy(spark, d):
    return O.entropy(A.epireads(spark, d))


@query(V("SELECT chrom, read, pos, CASE WHEN 2 * len(list_filter(string_split(seq, ''), lambda c: c = 'C')) < length(seq) THEN translate(seq, 'CT', 'TC') ELSE seq END AS seq FROM epireads", "epireads"))
def flip_states(spark, d):
    return O.flip_majority(A.epireads(spark, d)).select("chrom", "read", "pos", "seq")


@query(V(VALUES + ", g AS (SELECT a.chrom, a.pos, count(b.pos) AS near FROM v a LEFT JOIN v b ON b.chrom = a.chrom AND b.pos < a.pos AND b.pos >= a.pos - 3 GROUP BY 1, 2), h AS (SELECT chrom, pos FROM g WHERE near = 0) SELECT h.chrom, h.pos AS start, count(v.pos) AS n FROM h JOIN v ON v.chrom = h.chrom AND v.pos >= h.pos AND v.pos < coalesce((SELECT min(k.pos) FROM h k WHERE k.chrom = h.chrom AND k.pos > h.pos), 1000000000) GROUP BY 1, 2", "sites"))
def deserts(spark, d):
    cut = P.deserts(values(spark, d), ("chrom",), 3)
    return cut.groupBy("chrom", "segment").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n")).drop("segment")


@query(V(VALUES + """, o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i, value < 0.5 AS state, coalesce(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 10, false) AS near FROM v),
 h AS (SELECT a.* FROM o a LEFT JOIN o b ON b.chrom = a.chrom AND b.i = a.i - 1 WHERE a.state AND (b.i IS NULL OR NOT b.state OR NOT a.near)), e AS (SELECT a.* FROM o a LEFT JOIN o b ON b.chrom = a.chrom AND b.i = a.i + 1 WHERE a.state AND (b.i IS NULL OR NOT b.state OR NOT b.near))
 SELECT h.chrom, h.pos AS start, min(e.pos) + 1 AS stop, min(e.i) - h.i + 1 AS n FROM h JOIN e ON e.chrom = h.chrom AND e.i >= h.i GROUP BY h.chrom, h.pos, h.i""", "sites"))
def domains(spark, d):
    return O.domains(values(spark, d), 10, F.col("value") < 0.5)


PS = ", q AS (SELECT chrom, pos, CAST(n_meth AS DOUBLE) / n_reads AS p, CAST(n_reads % 7 AS DOUBLE) AS diff FROM sites WHERE sample = 'A'), f AS (SELECT *, least(1, min(n * p / r) OVER (ORDER BY p DESC, chrom DESC, pos DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (SELECT *, row_number() OVER (ORDER BY p, chrom, pos) AS r, count(*) OVER () AS n FROM q))"


@query(V(PS + " SELECT chrom, pos, round(p, 6) AS p, round(fdr, 6) AS fdr FROM f", "sites"))
def bh(spark, d):
    return O.adjusted(with_p(spark, d)).select("chrom", "pos", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


@query(V(PS + " SELECT round(min(p), 6) AS cutoff FROM f WHERE p >= 0.2 * r / n", "sites"))
def stepup_cutoff(spark, d):
    return O.step_up_cutoff(with_p(spark, d), 0.2).select(F.round("cutoff", 6).alias("cutoff"))


@query(V(PS + """, o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM f), s AS (SELECT *, i - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM o WHERE fdr < 0.55)
 SELECT chrom, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS sites, count(*) FILTER (p < 0.55) AS score, round(avg(diff), 6) AS diff FROM s GROUP BY chrom, g HAVING count(*) FILTER (p < 0.55) > 0""", "sites"))
def radmerge(spark, d):
    return O.merge_significant(O.adjusted(with_p(spark, d)), 0.55)


@query(V(VALUES + """, z AS (SELECT chrom, pos, value * 4 - 2 AS value FROM v), pr AS (SELECT a.chrom, a.pos AS a, b.pos AS b, a.value AS x, b.value AS y, (b.pos - a.pos - 1) // 2 AS bin FROM z a JOIN z b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos - 1 <= 10),
 c AS (SELECT bin, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) ELSE 0 END AS r FROM pr GROUP BY 1),
 nb AS (SELECT i.chrom, i.pos, sum(j.value) AS s, count(*) AS n FROM z i JOIN z j ON i.chrom = j.chrom AND abs(i.pos - j.pos) <= 11 GROUP BY 1, 2),
 ex AS (SELECT i.chrom, i.pos, sum(c.r) AS e FROM z i JOIN pr ON pr.chrom = i.chrom AND pr.b <= i.pos + 11 AND pr.a >= i.pos - 11 JOIN c ON c.bin = pr.bin WHERE abs(pr.a - i.pos) <= 11 AND abs(pr.b - i.pos) <= 11 GROUP BY 1, 2)
 SELECT nb.chrom, nb.pos, n, round(s / sqrt(greatest(n + 2 * coalesce(e, 0), 1e-9)), 5) AS z FROM nb LEFT JOIN ex ON ex.chrom = nb.chrom AND ex.pos = nb.pos""", "sites"))
def stouffer_liptak(spark, d):
    rows = values(spark, d).select("chrom", "pos", (F.col("value") * 4 - 2).alias("value"))
    return O.combined(rows, 10, 2).withColumn("z", F.round("z", 5))


@query(V(", k AS (SELECT unnest(range(1, 21)) AS k), b AS (SELECT k, chrom, pos // (50 * k) AS bin, sum(n_reads) AS n FROM sites, k WHERE sample = 'A' GROUP BY 1, 2, 3) SELECT k * 50 AS bin_size, round(avg(CASE WHEN n >= 500 THEN 1.0 ELSE 0.0 END), 6) AS good FROM b GROUP BY 1", "sites"))
def pmd_bin_sizes(spark, d):
    return O.good_bins(one(spark, d), 50, 20, 500).select(F.col("bin_size").cast("long").alias("bin_size"), "good")


@query(V("SELECT chrom, pos // 200 * 200 AS pos, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM sites WHERE sample = 'A' GROUP BY 1, 2", "sites"))
def pmd_bins(spark, d):
    return O.binned(one(spark, d), 200)


@query(V(", b AS (SELECT sample, chrom, pos // 100 * 100 AS pos, sum(n_reads) AS n FROM sites WHERE NOT (sample = 'A' AND pos < 1000) GROUP BY 1, 2, 3), u AS (SELECT DISTINCT chrom, pos FROM b) SELECT u.chrom, u.pos, " + ", ".join(f"CAST(coalesce((SELECT sum(n) FROM b WHERE b.chrom = u.chrom AND b.pos = u.pos AND b.sample = '{s}'), 0) AS BIGINT) AS {s}_reads" for s in "ANR") + " FROM u", "sites"))
def bins_union(spark, d):
    """Tiles that any replicate has, with zeros where one lacks them."""
    rows = A.sites(spark, d).where("not (sample = 'A' and pos < 1000)").withColumn("pos", F.floor(F.col("pos") / 100) * 100)
    return rows.groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("sample") == s, F.col("n_reads")).otherwise(0)).alias(f"{s}_reads") for s in "ANR"])


@query(V(", s AS (SELECT chrom, pos, seq, unnest(range(1, length(seq))) AS k FROM epireads) SELECT chrom, pos + k - 1 AS i, " + ", ".join(f"count(*) FILTER (seq[k:k + 1] = '{s}') AS {s.lower()}" for s in ("CC", "CT", "TC", "TT")) + " FROM s GROUP BY 1, 2", "epireads"))
def adjacent_states(spark, d):
    return O.adjacent_states(A.epireads(spark, d))
