"""Queries over intervals, and over sites by interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.catalog import query
from cytoframe.catalog.sites import one
from cytoframe.catalog.sql import RATIOS, V, counters
from cytoframe.operators import levels as L
from cytoframe.plans import ranges as P
from cytoframe.sources import adapters as A

#: Islands by recursion-free counting: a start that no other interval reaches opens one.
MERGED = """SELECT chrom, start, (SELECT max(j.stop) FROM intervals j WHERE j.chrom = o.chrom AND j.start >= o.start AND j.start < coalesce((SELECT min(n.start) FROM heads n WHERE n.chrom = o.chrom AND n.start > o.start), 1e18)) AS stop FROM heads o"""
HEADS = ", heads AS (SELECT DISTINCT chrom, start FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM intervals j WHERE j.chrom = i.chrom AND j.start < i.start AND j.stop + {gap} >= i.start)), merged AS (" + MERGED + ") "


def beds(spark, d) -> DataFrame:
    return A.intervals(spark, d).select("chrom", "start", "stop")


def other(spark, d) -> DataFrame:
    """A second set, of all suppliers."""
    k = F.col("s_suppkey")
    start = (k * 41) % 4000
    return A.table(spark, d, "supplier").select(F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chrom"), start.cast("long").alias("start"), (start + 30 + k % 40).cast("long").alias("stop"))


OTHER = "(SELECT 'chr' || CAST(s_suppkey % 5 + 1 AS VARCHAR) AS chrom, CAST((s_suppkey * 41) % 4000 AS BIGINT) AS start, CAST((s_suppkey * 41) % 4000 + 30 + s_suppkey % 40 AS BIGINT) AS stop FROM supplier)"


@query(V(HEADS.format(gap=0) + "SELECT * FROM merged", "intervals"))
def interval_merge(spark, d):
    return P.merge_touching(beds(spark, d))


@query(V(HEADS.format(gap=5) + "SELECT m.chrom, m.start, m.stop, (SELECT min(length(i.name)) FROM intervals i WHERE i.chrom = m.chrom AND i.start >= m.start AND i.stop <= m.stop) AS score FROM merged m", "intervals"))
def interval_merge_gap(spark, d):
    """Intervals within five bases merged, with the least score."""
    rows = A.intervals(spark, d).select("chrom", "start", "stop", F.length("name").cast("long").alias("score"))
    return P.merge_touching(rows, 5, aggs=(F.min("score").alias("score"),))


@query(V(f"SELECT a.chrom, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM intervals a JOIN {OTHER} b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop", "intervals"))
def interval_intersect(spark, d):
    return P.intersect(beds(spark, d), other(spark, d))


#: Bases as rows: covered positions of each chromosome, and runs of uncovered ones.
GAPS = ", bases AS (SELECT DISTINCT chrom, unnest(range(start, stop)) AS p FROM {t}), free AS (SELECT chrom, unnest(range(0, hi + 1)) AS p FROM (SELECT chrom, max(p) AS hi FROM bases GROUP BY 1) EXCEPT SELECT chrom, p FROM bases)"
RUNS = "SELECT chrom, min(p) AS start, max(p) + 1 AS stop FROM (SELECT chrom, p, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS g FROM {t}) GROUP BY chrom, g"


@query(V(GAPS.format(t="intervals") + RUNS.format(t="free"), "intervals"))
def interval_complement(spark, d):
    return P.complement(beds(spark, d))


ONLY = ", a AS (SELECT DISTINCT chrom, unnest(range(start, stop)) AS p FROM intervals), b AS (SELECT DISTINCT chrom, unnest(range(start, stop)) AS p FROM " + OTHER + "), x AS (SELECT * FROM a EXCEPT SELECT * FROM b) "


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parts of ``a`` outside ``b``: each merged interval cut by the gaps and the tail of the other set."""
    top = a.select("chrom", "stop").union(b.select("chrom", "stop")).groupBy("chrom").agg(F.max("stop").alias("stop"))
    ends = P.merge_touching(b).groupBy("chrom").agg(F.max("stop").alias("last"))
    tail = top.join(ends, "chrom", "left").select("chrom", F.coalesce("last", F.lit(0)).alias("start"), F.col("stop")).where("start < stop")
    return P.intersect(P.merge_touching(a), P.complement(b).union(tail))


@query(V(ONLY + RUNS.format(t="x"), "intervals"))
def interval_difference(spark, d):
    return only_first(beds(spark, d), other(spark, d))


@query(V(HEADS.format(gap=0) + "SELECT 'before' AS stage, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases, round(avg(stop - start), 6) AS mean_size FROM intervals UNION ALL SELECT 'after', count(*), CAST(sum(stop - start) AS BIGINT), round(avg(stop - start), 6) FROM merged", "intervals"))
def interval_summary(spark, d):
    sizes = (F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"), F.round(F.avg(F.col("stop") - F.col("start")), 6).alias("mean_size"))
    of = lambda x, s: x.agg(*sizes).select(F.lit(s).alias("stage"), "*")
    return of(beds(spark, d), "before").union(of(P.merge_touching(beds(spark, d)), "after"))


@query(V(HEADS.format(gap=0) + "SELECT chrom, start, start - (SELECT max(p.stop) FROM merged p WHERE p.chrom = m.chrom AND p.start < m.start) AS distance FROM merged m", "intervals"))
def interval_distances(spark, d):
    merged = P.merge_touching(beds(spark, d))
    return merged.select("chrom", "start", (F.col("start") - F.lag("stop").over(Window.partitionBy("chrom").orderBy("start"))).alias("distance"))


ROI = "SELECT i.chrom, i.start, i.stop, i.name, {ratios} FROM (SELECT i.chrom, i.start, i.stop, i.name, {counters} FROM intervals i LEFT JOIN (SELECT * FROM sites WHERE sample = 'A') s ON i.chrom = s.chrom AND s.pos >= i.start AND s.pos < i.stop GROUP BY 1, 2, 3, 4) i"


@query(V(ROI.format(ratios=RATIOS, counters=counters()), "sites", "intervals"))
def roi(spark, d):
    return L.by_interval(A.intervals(spark, d).drop("strand"), one(spark, d))


def first_beds(spark, d, n: int, span: int) -> DataFrame:
    """The first ``n`` intervals by number, spread over ``span`` positions, for the benchmark's sweep."""
    return A.intervals(spark, d, span).where(F.regexp_extract("name", r"(\d+)", 1).cast("long") <= n).drop("strand")


def roi_over(n: int, span: int):
    return lambda spark, d: L.by_interval(first_beds(spark, d, n, span), one(spark, d))


def roi_naive(spark, d, n: int, span: int):
    """The same without bins: a hash join on the chromosome with the range as a filter. For comparison in the benchmark."""
    i, s = first_beds(spark, d, n, span), one(spark, d)
    hit = (i.chrom == s.chrom) & (s.pos >= i.start) & (s.pos < i.stop)
    return i.join(s.withColumnRenamed("strand", "s"), hit, "left").groupBy(i.chrom, "start", "stop", "name").agg(*L.counters())


#: 0.0627... is the normal quantile for alpha 0.95.
@query(V("SELECT i.chrom, i.start, i.stop, i.name, " + ", ".join(
    f"round(CAST(sum(n_meth) FILTER (sample = '{s}') AS DOUBLE) / sum(n_reads) FILTER (sample = '{s}'), 6) AS {s}_weighted, round(avg(CAST(n_meth AS DOUBLE) / n_reads) FILTER (sample = '{s}'), 6) AS {s}_mean, "
    f"count(*) FILTER (sample = '{s}' AND abs(n_meth - n_reads / 2.0) > 0.06270677794321385 * sqrt(n_reads) / 2) AS {s}_called" for s in "ANR"
) + " FROM intervals i LEFT JOIN sites s ON i.chrom = s.chrom AND s.pos >= i.start AND s.pos < i.stop GROUP BY 1, 2, 3, 4", "sites", "intervals"))
def multistat(spark, d):
    return L.by_interval_and_sample(A.intervals(spark, d), A.sites(spark, d), list("ANR"))


TILES = "SELECT chrom, tile * 100 AS start, least(tile * 100 + 100, size) AS stop, {ratios} FROM (SELECT t.chrom, t.tile, t.size, {counters} FROM (SELECT chrom, size, unnest(range(0, (size + 99) // 100)) AS tile FROM (SELECT chrom, max(pos) + 517 AS size FROM sites GROUP BY 1 UNION ALL SELECT 'chr6', 1234)) t LEFT JOIN (SELECT * FROM sites WHERE sample = 'A') s ON s.chrom = t.chrom AND s.pos >= t.tile * 100 AND s.pos < t.tile * 100 + 100 GROUP BY 1, 2, 3)"


@query(V(TILES.format(ratios=RATIOS, counters=counters()), "sites"))
def cpgbins(spark, d):
    """Chromosomes as long as the sites of all samples need, and one without sites."""
    sizes = A.sites(spark, d).groupBy("chrom").agg((F.max("pos") + 517).alias("size"))
    sizes = sizes.union(spark.range(1).select(F.lit("chr6"), F.lit(1234).cast("long")))
    return L.by_tile(sizes, one(spark, d), 100)


META = "SELECT bin, {ratios} FROM (SELECT CAST(floor(CASE WHEN turn = '-' THEN tss - pos ELSE pos - tss END / 50.0) AS BIGINT) * 50 AS bin, {counters} FROM (SELECT chrom, strand AS turn, CASE WHEN strand = '-' THEN stop - 1 ELSE start END AS tss FROM intervals) i JOIN (SELECT * FROM sites WHERE sample = 'A') s ON s.chrom = i.chrom AND s.pos >= tss - 500 AND s.pos < tss + 500 GROUP BY 1) WHERE bin >= -500 AND bin < 500"


@query(V(META.format(ratios=RATIOS, counters=counters()), "sites", "intervals"))
def metagene(spark, d):
    return L.around_features(A.intervals(spark, d), one(spark, d), 500, 50)


#: Candidate regions: parts of the first set outside the second, and sites there with small or large scores.
DMR = ", r AS (" + RUNS.format(t="x") + ") SELECT r.chrom, r.start, r.stop, count(s.pos) AS n_sites, count(*) FILTER (s.p < 0.05) AS n_low, count(*) FILTER (s.p > 0.95) AS n_high FROM r LEFT JOIN (SELECT chrom, pos, n_meth / n_reads AS p FROM sites WHERE sample = 'A') s ON s.chrom = r.chrom AND s.pos >= r.start AND s.pos < r.stop GROUP BY 1, 2, 3"


@query(V(ONLY + DMR, "sites", "intervals"))
def dmr(spark, d):
    """Levels stand in for the scores of a comparison."""
    regions = only_first(beds(spark, d), other(spark, d))
    scored = one(spark, d).select("chrom", "pos", (F.col("n_meth").cast("double") / F.col("n_reads")).alias("p"))
    hits = P.point_in_interval(scored, regions).groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("n_sites"), F.count(F.when(F.col("p") < 0.05, 1)).alias("n_low"), F.count(F.when(F.col("p") > 0.95, 1)).alias("n_high"))
    return regions.join(hits, ["chrom", "start", "stop"], "left").na.fill(0, ["n_sites", "n_low", "n_high"])


@query(V(", s AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, pos FROM sites WHERE sample = 'A') SELECT a.chrom, o.start AS first, o.stop AS last, a.pos AS start, b.pos + 1 AS stop FROM (SELECT chrom, start, stop FROM intervals) o JOIN s a ON a.chrom = o.chrom AND a.i = o.start JOIN s b ON b.chrom = o.chrom AND b.i = o.stop", "sites", "intervals"))
def ordinals_to_bases(spark, d):
    """Intervals in ordinals of sites turned to bases by two joins."""
    index = one(spark, d).select("chrom", "pos", (F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1).cast("long").alias("i"))
    rows = beds(spark, d).select("chrom", F.col("start").alias("first"), F.col("stop").alias("last"))
    at = lambda a, c: index.select("chrom", F.col("i").alias(a), F.col("pos").alias(c))
    return rows.join(at("first", "start"), ["chrom", "first"]).join(at("last", "end"), ["chrom", "last"]).select("chrom", "first", "last", "start", (F.col("end") + 1).alias("stop"))


@query(V(", s AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, pos FROM sites WHERE sample = 'A') SELECT o.chrom, o.start, o.stop, CAST(min(i) AS BIGINT) AS first, CAST(max(i) + 1 AS BIGINT) AS last FROM (SELECT DISTINCT chrom, start, stop FROM intervals) o JOIN s ON s.chrom = o.chrom AND s.pos >= o.start AND s.pos < o.stop GROUP BY 1, 2, 3", "sites", "intervals"))
def bases_to_ordinals(spark, d):
    """Intervals in bases turned to ordinals of the sites they hold."""
    index = one(spark, d).select("chrom", "pos", (F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1).cast("long").alias("i"))
    return P.point_in_interval(index, beds(spark, d).distinct()).groupBy("chrom", "start", "stop").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"))
