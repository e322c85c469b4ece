"""Queries that fit models. Most have no SQL; tests compare them with brute force on small inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cytoframe.catalog import query
from cytoframe.catalog.sites import one
from cytoframe.catalog.sql import V
from cytoframe.operators import hmm as H
from cytoframe.operators import models as M
from cytoframe.operators import sites as S
from cytoframe.sources import adapters as A


def patterned(spark, d, low: int = 300, turn: bool = False):
    """Sites whose levels are near 0 in the first ``low`` of every 1000 positions and near 1 elsewhere, or the other way round."""
    few = F.floor(F.col("n_meth") / 6).cast("long")
    inside = (F.col("pos") % 1000 < low) != F.lit(turn)
    return A.sites(spark, d).withColumn("n_meth", F.when(inside, few).otherwise(F.col("n_reads") - few))


def arrays(rows):
    return rows.where("n_reads > 0").select("chrom", "pos", F.array("n_meth").alias("m"), F.array(F.col("n_reads") - F.col("n_meth")).alias("u"))


def observed(spark, d, **how):
    return arrays(patterned(spark, d, **how).where("sample = 'A'"))


@query()
def hmr(spark, d):
    return H.low_regions(observed(spark, d), gap=50)


#: Given parameters: Beta-binomial of the low and the high state, and chances to stay.
GIVEN = H.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.05, 0.95]]), np.array([[[1.5, 6.0], [7.0, 2.0]]]), (0, 1), np.zeros((2, 2), bool))
#: Forward and backward probabilities by recursion over the places in all segments together, each step scaled to a sum of 1.
DECODED = """, o AS (SELECT chrom, pos, n_reads, CASE WHEN pos % 1000 < 300 THEN n_meth // 6 ELSE n_reads - n_meth // 6 END AS m FROM sites WHERE sample = 'A' AND n_reads > 0),
    d AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) > 50 THEN 1 ELSE 0 END AS far FROM o), s AS (SELECT *, sum(far) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM d),
    l AS (SELECT chrom, seg, pos, row_number() OVER (PARTITION BY chrom, seg ORDER BY pos) AS i, count(*) OVER (PARTITION BY chrom, seg) AS n, lgamma(m + 1.5) + lgamma(n_reads - m + 6.0) - lgamma(n_reads + 7.5) - lgamma(1.5) - lgamma(6.0) + lgamma(7.5) AS l0, lgamma(m + 7.0) + lgamma(n_reads - m + 2.0) - lgamma(n_reads + 9.0) - lgamma(7.0) - lgamma(2.0) + lgamma(9.0) AS l1 FROM s),
    e AS MATERIALIZED (SELECT chrom, seg, pos, i, n, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM l),
    f AS (SELECT chrom, seg, i, b0 / (b0 + b1) AS a0, b1 / (b0 + b1) AS a1 FROM e WHERE i = 1 UNION ALL
        SELECT e.chrom, e.seg, e.i, (a0 * 0.9 + a1 * 0.05) * b0 / ((a0 * 0.9 + a1 * 0.05) * b0 + (a0 * 0.1 + a1 * 0.95) * b1), (a0 * 0.1 + a1 * 0.95) * b1 / ((a0 * 0.9 + a1 * 0.05) * b0 + (a0 * 0.1 + a1 * 0.95) * b1) FROM f JOIN e ON e.chrom = f.chrom AND e.seg = f.seg AND e.i = f.i + 1),
    g AS (SELECT chrom, seg, i, b0, b1, CAST(0.5 AS DOUBLE) AS c0, CAST(0.5 AS DOUBLE) AS c1 FROM e WHERE i = n UNION ALL
        SELECT e.chrom, e.seg, e.i, e.b0, e.b1, x / (x + y), y / (x + y) FROM (SELECT chrom, seg, i, 0.9 * b0 * c0 + 0.1 * b1 * c1 AS x, 0.05 * b0 * c0 + 0.95 * b1 * c1 AS y FROM g) g JOIN e ON e.chrom = g.chrom AND e.seg = g.seg AND e.i = g.i - 1)
    SELECT e.chrom, e.pos, CAST(CASE WHEN a0 * c0 >= a1 * c1 THEN 0 ELSE 1 END AS INTEGER) AS state, round(greatest(a0 * c0, a1 * c1) / (a0 * c0 + a1 * c1), 5) AS post FROM e JOIN f USING (chrom, seg, i) JOIN g USING (chrom, seg, i)"""


@query(V(DECODED, "sites"))
def hmr_decoded(spark, d):
    """Posterior decoding under given parameters, which pass through their text form."""
    rows = H.segmented(observed(spark, d), 50)
    return H.decode(rows, H.Model.from_json(GIVEN.to_json())).select("chrom", "pos", "state", F.round("post", 5).alias("post"))


@query()
def hmr_given(spark, d):
    """Low regions under given parameters."""
    return H.low_regions(observed(spark, d), gap=50, model=GIVEN)


@query()
def hmr_partial(spark, d):
    """Partly methylated regions, by folded counts."""
    half = F.when(F.col("pos") % 1000 < 300, F.floor(F.col("n_reads") / 2).cast("long")).otherwise(F.col("n_meth"))
    return H.low_regions(arrays(S.fold_partial(patterned(spark, d).where("sample = 'A'").withColumn("n_meth", half))), gap=50)


@query()
def hmr_rep(spark, d):
    rows = patterned(spark, d).groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("sample") == s, F.col(c))).alias(f"{s}_{c}") for s in "ANR" for c in ("n_meth", "n_reads")])
    rows = rows.where(" and ".join(f"{s}_n_reads > 0" for s in "ANR"))
    return H.low_regions(rows.select("chrom", "pos", F.array(*[f"{s}_n_meth" for s in "ANR"]).alias("m"), F.array(*[F.col(f"{s}_n_reads") - F.col(f"{s}_n_meth") for s in "ANR"]).alias("u")), gap=50)


@query()
def hypermr(spark, d):
    return H.high_regions(observed(spark, d, low=200, turn=True), gap=50)


@query()
def pmd(spark, d):
    out = H.partly_methylated(patterned(spark, d).where("sample = 'A'").select("chrom", "pos", "n_meth", "n_reads"), bin_size=20)
    return out.select("chrom", "start", "stop", *[F.round(c, 4).alias(c) if c.endswith("score") else c for c in ("start_score", "start_certainty", "stop_score", "stop_certainty")])


@query()
def pmd_replicates(spark, d):
    """The same from three samples side by side, the third as an array of levels."""
    rows = patterned(spark, d)
    one = lambda s: rows.where(F.col("sample") == s).select("chrom", "pos", "n_meth", "n_reads")
    levels = one("R").select("chrom", "pos", (F.col("n_meth").cast("double") / F.col("n_reads")).alias("level"))
    return H.domain_names(H.partly_methylated(H.pooled_arrays([one("A"), one("N"), levels], arrays=(2,)), bin_size=20, arrays=(2,))).select("chrom", "start", "stop", "name")


#: Six samples: return flag by line status. Factors: base, and whether the flag is A.
DESIGN = [[1, 1], [1, 1], [1, 0], [1, 0], [1, 0], [1, 0]]


def table(spark, d):
    q, disc = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    rows = A.table(spark, d, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"), (2 * F.col("l_partkey") + F.col("l_linenumber") % 2).cast("long").alias("pos"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit("CpG").alias("context"), F.concat("l_returnflag", "l_linestatus").alias("s"), q.alias("n"), F.floor(q * disc / 10).cast("long").alias("m"),
    )
    of = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("s") == s, F.col(c))), F.lit(0)) for s in ("AF", "AO", "NF", "NO", "RF", "RO")])
    return rows.groupBy("chrom", "pos", "strand", "context").agg(of("n").alias("n"), of("m").alias("m"))


@query()
def radmeth(spark, d):
    out = M.regression(table(spark, d), DESIGN, 1)
    return out.select("chrom", "pos", "strand", "context", F.round("p", 6).alias("p"), F.round("dispersion", 4).alias("dispersion"), "n_case", "m_case", "n_control", "m_control")


@query()
def radmeth_nano(spark, d):
    """The same likelihood over real-valued counts."""
    rows = table(spark, d).withColumn("m", F.zip_with("m", "n", lambda m, n: F.least(m + 0.25, n.cast("double"))))
    return M.regression(rows, DESIGN, 1).select("chrom", "pos", F.round("p", 6).alias("p"), "n_case", "n_control")


@query(V(", r AS (SELECT count(*) FILTER (n_case = 0 OR n_control = 0) AS low, count(*) FILTER (n_case > 0 AND n_control > 0 AND (m = 0 OR m = n)) AS flat, count(*) AS sites FROM (SELECT chrom, pos, coalesce(sum(n_reads) FILTER (sample = 'A'), 0) AS n_case, coalesce(sum(n_reads) FILTER (sample <> 'A'), 0) AS n_control, sum(n_meth) AS m, sum(n_reads) AS n FROM sites GROUP BY 1, 2)) SELECT * FROM r", "sites"))
def radmeth_untestable(spark, d):
    """Sites that cannot be tested: no reads in cases or controls; or all, or no reads methylated."""
    case = F.col("sample") == "A"
    rows = A.sites(spark, d).groupBy("chrom", "pos").agg(F.coalesce(F.sum(F.when(case, F.col("n_reads"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~case, F.col("n_reads"))), F.lit(0)).alias("b"), F.sum("n_meth").alias("m"), F.sum("n_reads").alias("n"))
    low = (F.col("a") == 0) | (F.col("b") == 0)
    return rows.agg(F.count(F.when(low, 1)).alias("low"), F.count(F.when(~low & ((F.col("m") == 0) | (F.col("m") == F.col("n"))), 1)).alias("flat"), F.count(F.lit(1)).alias("sites"))


@query()
def radadjust(spark, d):
    tested = M.regression(table(spark, d), DESIGN, 1).select("chrom", "pos", F.coalesce("p", F.lit(1.0)).alias("p"))
    out = M.adjust_regression(tested, 20, 5)
    return out.select("chrom", "pos", F.round("p", 6).alias("p"), F.round("combined", 6).alias("combined"), F.round("fdr", 6).alias("fdr"))


def assays(spark, d):
    """Samples A, N and R as the three assays, at sites that all have."""
    rows = A.sites(spark, d).groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("sample") == s, c)).alias(f"{a}_{k}") for s, a in (("A", "bs"), ("N", "tab"), ("R", "ox")) for k, c in (("m", F.col("n_meth")), ("u", F.col("n_reads") - F.col("n_meth")))])
    return rows.where("bs_m is not null and tab_m is not null and ox_m is not null")


#: Expectation-maximisation site by site until no share moves by 1e-10, at most 500 rounds.
MLML = """, w AS (SELECT chrom, pos, a.n_meth AS bm, a.n_reads - a.n_meth AS bu, n.n_meth AS tm, n.n_reads - n.n_meth AS tu, r.n_meth AS om, r.n_reads - r.n_meth AS ou FROM (SELECT * FROM sites WHERE sample = 'A') a JOIN (SELECT * FROM sites WHERE sample = 'N') n USING (chrom, pos) JOIN (SELECT * FROM sites WHERE sample = 'R') r USING (chrom, pos)),
    s AS MATERIALIZED (SELECT chrom, pos, round_even(bm * least(1, 500.0::DOUBLE / (bm + bu)), 0) AS t, round_even(bu * least(1, 500.0::DOUBLE / (bm + bu)), 0) AS u, round_even(tm * least(1, 500.0::DOUBLE / (tm + tu)), 0) AS h, round_even(tu * least(1, 500.0::DOUBLE / (tm + tu)), 0) AS g,
        round_even(om * least(1, 500.0::DOUBLE / (om + ou)), 0) AS m, round_even(ou * least(1, 500.0::DOUBLE / (om + ou)), 0) AS l FROM w),
    h0 AS (SELECT *, m / (m + l) AS xm, h / (h + g) AS xh, u / (t + u) AS xu FROM s),
    i AS (SELECT *, least(0.98, greatest(0.01, xm)) AS p0, least(0.98, greatest(0.01, xh)) AS q0 FROM h0),
    e AS (SELECT chrom, pos, t, u, h, g, m, l, xm, xh, xu, p0 / greatest(1, (p0 + q0) / 0.99) AS p, q0 / greatest(1, (p0 + q0) / 0.99) AS q, 0 AS k, 1.0::DOUBLE AS moved FROM i UNION ALL
        SELECT chrom, pos, t, u, h, g, m, l, xm, xh, xu, np, nq, k + 1, greatest(abs(np - p), abs(nq - q)) FROM (SELECT *, (m + t * p / greatest(p + q, 1e-300) + g * p / greatest(1 - q, 1e-300)) / (t + u + h + g + m + l) AS np, (h + t * q / greatest(p + q, 1e-300) + l * q / greatest(1 - p, 1e-300)) / (t + u + h + g + m + l) AS nq FROM e WHERE k < 500 AND moved >= 1e-10)),
    f AS (SELECT chrom, pos, any_value(t + u) AS nu, any_value(h + g) AS nh, any_value(m + l) AS nm, any_value(xm) AS xm, any_value(xh) AS xh, any_value(xu) AS xu, abs(any_value(xm + xh + xu) - 1) < 1e-12 AS exact, arg_max(p, k) AS p, arg_max(q, k) AS q FROM e GROUP BY 1, 2),
    o AS (SELECT chrom, pos, nu, nh, nm, xm, xh, xu, exact, CASE WHEN exact THEN xm ELSE p END AS p, CASE WHEN exact THEN xh ELSE q END AS q FROM f),
    z AS (SELECT *, CASE WHEN 1 - p - q <= 1e-8 THEN 0 WHEN 1 - p - q >= 1 - 1e-8 THEN 1 ELSE 1 - p - q END AS r FROM o),
    c AS (SELECT *, """ + ", ".join(f"CASE WHEN NOT exact AND ({v} < ({x} + 3.841458820694124 / (2 * {n}) - 1.959963984540054 * sqrt({x} * (1 - {x}) / {n} + 3.841458820694124 / (4 * {n} * {n}))) / (1 + 3.841458820694124 / {n}) - 1e-12 OR {v} > ({x} + 3.841458820694124 / (2 * {n}) + 1.959963984540054 * sqrt({x} * (1 - {x}) / {n} + 3.841458820694124 / (4 * {n} * {n}))) / (1 + 3.841458820694124 / {n}) + 1e-12) THEN 1 ELSE 0 END AS c{n}" for v, x, n in (("p", "xm", "nm"), ("q", "xh", "nh"), ("r", "xu", "nu"))) + """ FROM z)
    SELECT chrom, pos, """ + ", ".join(f"round(CASE WHEN {v} <= 1e-8 THEN 0 WHEN {v} >= 1 - 1e-8 THEN 1 ELSE {v} END, 6) AS p_{n}" for v, n in (("p", "m"), ("q", "h"), ("r", "u"))) + """, CAST(cnm + cnh + cnu AS INTEGER) AS conflicts FROM c"""


@query(V(MLML, "sites"))
def mlml(spark, d):
    return M.hydroxy(assays(spark, d))


@query(V(", w AS (SELECT chrom, pos, a.n_meth AS bm, a.n_reads - a.n_meth AS bu, n.n_meth AS tm, n.n_reads - n.n_meth AS tu, r.n_meth AS om, r.n_reads - r.n_meth AS ou FROM (SELECT * FROM sites WHERE sample = 'A') a JOIN (SELECT * FROM sites WHERE sample = 'N') n USING (chrom, pos) JOIN (SELECT * FROM sites WHERE sample = 'R') r USING (chrom, pos)) SELECT chrom, pos, bm, bu, tm, tu, om, ou, round(CAST(bm AS DOUBLE) / (bm + bu) - CAST(tm AS DOUBLE) / (tm + tu), 6) AS m_by_difference FROM w", "sites"))
def mlml_inputs(spark, d):
    """The position-wise join of the three assays, with the estimate of methylation by difference."""
    m = lambda a: F.col(f"{a}_m").cast("double") / (F.col(f"{a}_m") + F.col(f"{a}_u"))
    return assays(spark, d).select("chrom", "pos", F.col("bs_m").alias("bm"), F.col("bs_u").alias("bu"), F.col("tab_m").alias("tm"), F.col("tab_u").alias("tu"), F.col("ox_m").alias("om"), F.col("ox_u").alias("ou"), F.round(m("bs") - m("tab"), 6).alias("m_by_difference"))


LCH = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"
FISHER = """, s AS (SELECT chrom, pos, seq, unnest(range(1, length(seq))) AS k FROM epireads), t AS (SELECT chrom, pos + k - 1 AS i, """ + ", ".join(f"count(*) FILTER (seq[k:k + 1] = '{s}') AS {s.lower()}" for s in ("CC", "CT", "TC", "TT")) + """ FROM s GROUP BY 1, 2),
    g AS (SELECT *, unnest(range(greatest(0, tc_row + tc_col - n), least(tc_row, tc_col) + 1)) AS k FROM (SELECT *, cc + ct AS tc_row, cc + tc AS tc_col, cc + ct + tc + tt AS n FROM t)),
    l AS (SELECT *, """ + LCH.format(n="tc_col", k="k") + " + " + LCH.format(n="(n - tc_col)", k="tc_row - k") + """ AS lp, """ + LCH.format(n="tc_col", k="cc") + " + " + LCH.format(n="(n - tc_col)", k="tc_row - cc") + " AS seen, " + LCH.format(n="n", k="tc_row") + """ AS all_p FROM g)
    SELECT chrom, i, cc, ct, tc, tt, round(CASE WHEN cc * tt > ct * tc THEN least(1, tail) ELSE 1 END, 6) AS p FROM (SELECT chrom, i, cc, ct, tc, tt, sum(exp(lp - all_p)) FILTER (lp <= seen + 1e-9) AS tail FROM l GROUP BY ALL)"""


@query(V(FISHER, "epireads"))
def allelic(spark, d):
    return M.allelic(A.epireads(spark, d)).withColumn("p", F.round("p", 6))


def alleles(spark, d):
    """Read states that agree within a read, half of the reads on either side, over the first 60 sites."""
    own = F.when(F.col("read") % 2 == 0, F.translate("seq", "T", "C")).otherwise(F.translate("seq", "C", "T"))
    return A.epireads(spark, d).withColumn("seq", F.when(F.col("pos") < 60, own).otherwise(F.col("seq")))


@query()
def amrfinder(spark, d):
    return M.allele_regions(alleles(spark, d)).select("chrom", "start", "stop", F.round("score", 6).alias("score"))


@query()
def amr_windows(spark, d):
    return M.window_tests(alleles(spark, d), 10, 40).select("chrom", "w", "reads", F.round("score", 6).alias("score"))


@query()
def amrtester(spark, d):
    spans = spark.range(0, 20).select(F.explode(F.array(F.lit("chrF"), F.lit("chrO"))).alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("stop"))
    return M.region_tests(spans, alleles(spark, d)).select("chrom", "start", "stop", "reads", F.round("score", 6).alias("score"))


@query(V("SELECT chrom, pos, CAST(count(*) FILTER (sample = 'A') AS INTEGER) AS cases, CAST(count(*) FILTER (sample <> 'A') AS INTEGER) AS controls FROM sites WHERE n_reads >= 10 GROUP BY 1, 2", "sites"))
def case_control(spark, d):
    """Samples with enough reads, by the design's factor, from arrays of observations."""
    obs = A.sites(spark, d).groupBy("chrom", "pos").agg(F.collect_list(F.struct("sample", "n_reads")).alias("obs"))
    ok = lambda case: F.size(F.filter("obs", lambda x: ((x["sample"] == "A") == F.lit(case)) & (x["n_reads"] >= 10)))
    return obs.select("chrom", "pos", ok(True).alias("cases"), ok(False).alias("controls")).where("cases + controls > 0")
