"""Per-site and per-window statistical models as Arrow kernels: regression, hydroxymethylation, allele-specific methylation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions import stats
from cytoframe.operators import ordered
from cytoframe.plans import ranges, store


#: Rows that are fitted together, at most.
ROWS = 1 << 14


def beta_binomial_fit(n: np.ndarray, m: np.ndarray, x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood for every row of counts (rows by samples) under one design (samples by factors): parameters and log-likelihoods.

    The level is a logistic function of the factors and the dispersion phi = logistic(last parameter). All rows take damped Newton steps together; a row's damping
    grows when its likelihood would fall.
    """
    w, best = np.zeros((len(n), x.shape[1] + 1)), np.zeros(len(n))
    for at in range(0, len(n), ROWS):
        some = n[at : at + ROWS].T > 0
        own = [np.ascontiguousarray(np.where(some, c[at : at + ROWS].T, 0)) for c in (n, m)]
        w[at : at + ROWS], best[at : at + ROWS] = newton(*own, x, rounds)
    return w, best


def likelihood(w: np.ndarray, n: np.ndarray, m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods of parameters (one a row of ``w``) with their gradients and negative Hessians, rows last. Counts are samples by rows; a sample without reads adds nothing.

    No result of a row depends on the rows beside it, down to the last bit.
    """
    k, factors = len(n), x.shape[1]
    over = lambda weights, rows: sum(c * r for c, r in zip(weights, rows) if c)
    eta = np.stack([over(weights, w) + np.zeros(n.shape[1]) for weights in x])
    p = np.clip(1 / (1 + np.exp(-np.clip(eta, -20, 20))), 1e-9, 1 - 1e-9)
    s = np.exp(-np.clip(w[-1], -12, 6))
    a, b = p * s, (1 - p) * s
    some = [np.flatnonzero(c) for c in (m, n - m, n)]  # a count of 0 adds nothing
    parts = [(c.ravel()[at], f.ravel()[at]) for c, f, at in zip((m, n - m, n), (a, b, np.broadcast_to(s, n.shape)), some)]
    done = stats.gamma_logs(np.concatenate([*(c + f for c, f in parts), *(f for _, f in parts[:2]), s]))
    less, upto = np.zeros((3, 3, n.size)), np.cumsum([0, *map(len, some), *map(len, some[:2])])
    for i, at in enumerate(some):  # of m, n - m and n: by how much the counts raise them
        more = done[:, upto[i] : upto[i + 1]]
        less[:, i, at] = more - (done[:, upto[i + 3] : upto[i + 4]] if i < 2 else done[:, upto[5] :][:, at % n.shape[1]])
    (like_a, like_b, like_s), (da, db, ds), (da2, db2, ds2) = less.reshape(3, 3, *n.shape)
    like = (like_a + like_b - like_s).sum(0)
    qs, gap = p * b, da - db
    e = gap * qs
    g = np.stack([*(over(weights, e) + np.zeros(n.shape[1]) for weights in x.T), -(da * a + db * b - ds * s).sum(0)])
    # beyond their bounds level and dispersion stand still
    free, loose = np.abs(eta) < 20, (w[-1] > -12) & (w[-1] < 6)
    ee = ((da2 + db2) * qs * qs + e * (1 - 2 * p)) * free
    et = -qs * (da2 * a - db2 * b + gap) * (0.5 * free + 0.5 * loose)
    h = np.empty((factors + 1, factors + 1, n.shape[1]))
    for i in range(factors):
        for j in range(i + 1):
            h[i, j] = h[j, i] = -over(x[:, i] * x[:, j], ee)
        h[i, -1] = h[-1, i] = -over(x[:, i], et)
    h[-1, -1] = -((da2 * a + da) * a + (db2 * b + db) * b - (ds2 * s + ds) * s).sum(0) * loose
    return like, g, h


def solved(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of symmetric systems (rows last) by elimination without pivots, and the least pivot of each: above 0 where the matrix is positive definite."""
    h, out, k = h.copy(), g.copy(), len(g)
    least = np.full(g.shape[1], np.inf)
    for i in range(k):
        least = np.fmin(least, h[i, i])
        for j in range(i + 1, k):
            f = h[j, i] / h[i, i]
            h[j, i + 1 :] -= f * h[i, i + 1 :]
            out[j] -= f * out[i]
    for i in reversed(range(k)):
        out[i] = (out[i] - (h[i, i + 1 :] * out[i + 1 :]).sum(0)) / h[i, i]
    return out, least


def newton(n: np.ndarray, m: np.ndarray, x: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The fit of one block, counts as samples by rows: parameters, one line a row of counts, and log-likelihoods."""
    rows, size = n.shape[1], x.shape[1] + 1
    w = np.zeros((size, rows))
    w[-1] = -2.5
    best, g, h = likelihood(w, n, m, x)
    live, damp = np.arange(rows), np.full(rows, 1e-2)
    v, score, eye = w.copy(), best.copy(), np.eye(size)[:, :, None]
    for _ in range(rounds):
        if not len(live):
            break
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            scale = np.abs(np.diagonal(h)).max(1) + 1e-6
            shift = damp * scale
            flat = ~(solved(h - 1e-6 * scale * eye, g)[1] > 0)
            if flat.any():  # not clearly concave: the least eigenvalue is raised
                low = np.linalg.eigvalsh(np.moveaxis(h[:, :, flat], 2, 0))[:, 0]
                shift[flat] += np.maximum(0, 1e-6 * scale[flat] - low)
            move = solved(h + shift * eye, g)[0]
        new = np.clip(v + np.clip(move, -2, 2), -15, 15)
        now, g2, h2 = likelihood(new, n, m, x)
        up = now >= score
        gain = now - score
        v, score, g, h = np.where(up, new, v), np.where(up, now, score), np.where(up, g2, g), np.where(up, h2, h)
        damp = np.where(up, damp / 5, damp * 10)
        stay = ~((up & (gain < 1e-9)) | (damp > 1e8))
        if not stay.all():
            done = live[~stay]
            w[:, done], best[done] = v[:, ~stay], score[~stay]
            live, damp, v, score, g, h, n, m = live[stay], damp[stay], v[:, stay], score[stay], g[:, stay], h[:, :, stay], n[:, stay], m[:, stay]
    w[:, live], best[live] = v, score
    return w.T, best


def regression(table: DataFrame, design: Sequence[Sequence[int]], factor: int, keys: tuple[str, ...] = ("chrom", "pos", "strand", "context")) -> DataFrame:
    """Likelihood-ratio test of one factor for each row of counts: ``keys``, p, levels of the groups of samples, and dispersion.

    ``table`` has arrays n and m by sample. Rows without reads in cases or in controls, or with all or no reads methylated, have no p.
    """
    full = np.array(design, float)
    null = np.delete(full, factor, axis=1)
    cases = full[:, factor] == 1
    groups, at = np.unique(full, axis=0, return_inverse=True)

    def matrix(column: pa.Array) -> np.ndarray:
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        if (size != len(full)).any():
            raise ValueError(f"a row of counts has not one number for each of {len(full)} samples")
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = matrix(batch.column("n")), matrix(batch.column("m"))
            low = (n[:, cases].sum(1) == 0) | (n[:, ~cases].sum(1) == 0)
            flat = (m.sum(1) == 0) | (m.sum(1) == n.sum(1))
            ok = ~(low | flat)
            p, disp = np.full(len(n), np.nan), np.full(len(n), np.nan)
            if ok.any():
                w, ll = beta_binomial_fit(n[ok], m[ok], full)
                _, ll0 = beta_binomial_fit(n[ok], m[ok], null)
                p[ok] = stats.erfc(np.sqrt(np.maximum(0, ll - ll0)))  # chi-square with one degree of freedom, of twice the difference
                disp[ok] = np.exp(-w[:, -1])
            level = np.stack([m[:, at == g].sum(1) / np.where(n[:, at == g].sum(1) > 0, n[:, at == g].sum(1), np.nan) for g in range(len(groups))], 1)
            own = {k: batch.column(k) for k in keys} | {"p": pa.array(p, from_pandas=True), "dispersion": pa.array(disp, from_pandas=True)}
            own["levels"] = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(groups)), pa.array(level.ravel(), from_pandas=True))
            for name, those in (("case", cases), ("control", ~cases)):
                own[f"n_{name}"], own[f"m_{name}"] = (pa.array(c.astype("int64")) for c in (n[:, those].sum(1), np.rint(m[:, those].sum(1))))
            yield pa.RecordBatch.from_pydict(own)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)
    return table.select(*keys, "n", "m").mapInArrow(run, f"{schema}, p double, dispersion double, levels array<double>, n_case long, m_case long, n_control long, m_control long")


def z_score(p):
    @F.pandas_udf("double")
    def kernel(s: pd.Series) -> pd.Series:
        return pd.Series(stats.normal_quantile(1 - np.clip(s.to_numpy(float), 1e-6, 1 - 1e-6)) if len(s) else np.zeros(0))

    return kernel(p)


def upper_tail(z):
    @F.pandas_udf("double")
    def kernel(s: pd.Series) -> pd.Series:
        return pd.Series(stats.normal_sf(s.to_numpy(float)) if len(s) else np.zeros(0))

    return kernel(z)


def adjust_regression(rows: DataFrame, reach: int = 200, bin_size: int = 1) -> DataFrame:
    """Rows (chrom, pos, p) with the p combined over neighbours and its adjusted value. Rows with p of 1, or none, are left out of both and keep 1.

    Several plans read what the tests gave, and what combining gives, so both are kept.
    """
    named = rows.columns
    rows = store.kept(rows.withColumn("_value", F.when(F.col("p") < 1, z_score("p"))))
    tested = rows.where(F.col("p") < 1).select("chrom", "pos", F.col("_value").alias("value"))
    both = store.kept(ordered.combined(tested, reach, bin_size).select("chrom", "pos", upper_tail("z").alias("combined")))
    done = ordered.adjusted(both, "combined")
    one = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    return rows.join(done, ["chrom", "pos"], "left").select(*named, one("combined"), one("fdr"))


def hydroxy(rows: DataFrame, cap: int = 500, alpha: float = 0.05, tolerance: float = 1e-10, rounds: int = 500) -> DataFrame:
    """Levels of methylation, hydroxymethylation and neither from three assays: (keys, p_m, p_h, p_u, conflicts).

    ``rows`` has (chrom, pos, bs_m, bs_u, tab_m, tab_u, ox_m, ox_u). The first assay reads either modification, the second hydroxymethylation, the third
    methylation. Estimates that sum to 1 stand; else expectation-maximisation splits what an assay cannot tell apart. Sites with fewer than two assays have none.
    A conflict is an assay whose Wilson interval leaves out the fitted value.
    """
    z = stats.normal_quantile(1 - alpha / 2)[0]
    counts = ["bs_m", "bs_u", "tab_m", "tab_u", "ox_m", "ox_u"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [batch[c].to_numpy(float) for c in counts]
            t, u, h, g, m, low = (np.rint(a * np.minimum(1, cap / np.maximum(a + b, 1))) for a, b in ((raw[0], raw[1]), (raw[1], raw[0]), (raw[2], raw[3]), (raw[3], raw[2]), (raw[4], raw[5]), (raw[5], raw[4])))
            share = lambda a, b: np.where(a + b > 0, a / np.maximum(a + b, 1), np.nan)
            hat_m, hat_h, hat_u = share(m, low), share(h, g), share(u, t)
            enough = ((t + u > 0).astype(int) + (h + g > 0) + (m + low > 0)) >= 2
            pm = np.nan_to_num(np.where(np.isnan(hat_m), 1 - hat_h - hat_u, hat_m), nan=0.33).clip(0.01, 0.98)
            ph = np.nan_to_num(np.where(np.isnan(hat_h), 1 - hat_m - hat_u, hat_h), nan=0.33).clip(0.01, 0.98)
            over = np.maximum(1, (pm + ph) / 0.99)
            pm, ph = pm / over, ph / over
            total = t + u + h + g + m + low
            of = lambda a, b: a / np.maximum(a + b, 1e-300)
            live = np.arange(len(pm))  # a row rests once it has converged, whatever its neighbours do
            for _ in range(rounds):
                if not len(live):
                    break
                x, y = pm[live], ph[live]
                z0 = 1 - x - y
                # expected methylated and hydroxymethylated among the reads that each assay leaves open
                em = m[live] + t[live] * of(x, y) + g[live] * of(x, z0)
                eh = h[live] + t[live] * of(y, x) + low[live] * of(y, z0)
                pm[live], ph[live] = em / np.maximum(total[live], 1), eh / np.maximum(total[live], 1)
                live = live[np.maximum(np.abs(pm[live] - x), np.abs(ph[live] - y)) >= tolerance]
            exact = np.abs(hat_m + hat_h + hat_u - 1) < 1e-12
            pm, ph = np.where(exact, hat_m, pm), np.where(exact, hat_h, ph)
            snap = lambda p: np.where(p <= 1e-8, 0.0, np.where(p >= 1 - 1e-8, 1.0, p))
            pu = snap(1 - pm - ph)

            def conflict(hat, n, p):
                n1 = np.maximum(n, 1)
                centre, half = hat + z * z / (2 * n1), z * np.sqrt(hat * (1 - hat) / n1 + z * z / (4 * n1 * n1))
                lo, hi = (centre - half) / (1 + z * z / n1), (centre + half) / (1 + z * z / n1)
                return (n > 0) & ((p < lo - 1e-12) | (p > hi + 1e-12)) & ~exact

            bad = conflict(hat_m, m + low, pm).astype(int) + conflict(hat_h, h + g, ph) + conflict(hat_u, t + u, pu)
            none = lambda p: np.where(enough, snap(p), np.nan)
            yield pd.DataFrame({"chrom": batch["chrom"], "pos": batch["pos"], "p_m": none(pm), "p_h": none(ph), "p_u": none(pu), "conflicts": np.where(enough, bad, 0)})

    out = rows.select("chrom", "pos", *counts).mapInPandas(run, "chrom string, pos long, p_m double, p_h double, p_u double, conflicts int")
    tidy = lambda c: F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c)
    return out.select("chrom", "pos", tidy("p_m"), tidy("p_h"), tidy("p_u"), F.when(F.col("p_m").isNotNull() & ~F.isnan("p_m"), F.col("conflicts")).alias("conflicts"))


def allelic(epireads: DataFrame) -> DataFrame:
    """Adjacent sites with counts of their four joint states and the p-value of Fisher's test; p is 1 where agreeing states are not in excess."""
    from cytoframe.operators.kernels import score_column

    t = ordered.adjacent_states(epireads)
    p = F.when(F.col("cc") * F.col("tt") > F.col("ct") * F.col("tc"), score_column("fisher_two_sided", *[F.col(c) for c in ("cc", "ct", "tc", "tt")])).otherwise(1.0)
    return t.withColumn("p", p)


def states_matrix(seqs: Sequence[str], offsets: Sequence[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each read has C, and whether it has T, at each site of a window."""
    size = np.array([len(s) for s in seqs], np.int64)
    row = np.repeat(np.arange(len(seqs)), size)
    column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(np.asarray(offsets, np.int64), size)
    letter = np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)
    inside = (column >= 0) & (column < width)
    out = []
    for x in b"CT":
        m = np.zeros((len(seqs), width))
        hit = inside & (letter == x)
        m[row[hit], column[hit]] = 1
        out.append(m)
    return out[0], out[1]


def two_alleles(c: np.ndarray, t: np.ndarray, copies: np.ndarray, first: np.ndarray, rounds: int = 10, low: float = 0.25, high: float = 0.75, pseudo: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: log-likelihoods of its reads under one methylation profile, and under an even mixture of two fitted by expectation-maximisation.

    Rows are kinds of reads with their numbers of copies; a window's rows begin at its place in ``first``. All windows step together; one that has converged rests.
    """
    win = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
    total = lambda x: np.add.reduceat(x, first, axis=0)
    profile = lambda w, add: (total((w * copies)[:, None] * c) + add) / (total((w * copies)[:, None] * (c + t)) + 2 * add)
    clip = lambda a: np.clip(a, 1e-12, 1 - 1e-12)
    like = lambda a: (c * np.log(clip(a))[win] + t * np.log(1 - clip(a))[win]).sum(1)
    n = total(copies)
    single = total(copies * like(profile(np.ones(len(c)), pseudo)))
    a, b = np.full((len(first), c.shape[1]), low), np.full((len(first), c.shape[1]), high)
    before, live = np.full(len(first), -np.inf), np.ones(len(first), bool)
    for _ in range(rounds):
        la = like(a)
        both = np.logaddexp(la, like(b))
        w = np.exp(la - both)
        score = total(copies * both) + n * np.log(0.5)
        # the two profiles hold equal shares of the reads
        share = np.clip(total(copies * w) / n, 1e-300, 1 - 1e-16)[win]
        w = np.where(share > 0.5, w * (0.5 / share), 1 - (1 - w) * (0.5 / (1 - share)))
        live &= score - before > 1e-10 * np.abs(score)
        if not live.any():
            break
        before = score
        a, b = np.where(live[:, None], profile(w, 0.5 * pseudo), a), np.where(live[:, None], profile(1 - w, 0.5 * pseudo), b)
    pair = total(copies * (np.logaddexp(like(a), like(b)) + np.log(0.5)))
    return single, pair


def allele_tests(seqs: Sequence[str], offsets: Sequence[int], copies: Sequence[int], first: Sequence[int], width: int, bic: bool = False, correct: bool = False, rounds: int = 10) -> np.ndarray:
    """Of each window: p-value of the likelihood-ratio test of two profiles against one, or the difference of their information criteria."""
    first, copies = np.asarray(first), np.asarray(copies, float)
    c, t = states_matrix(seqs, offsets, width)
    seen = np.add.reduceat(c + t, first, axis=0) > 0
    single, pair = two_alleles(c, t, copies, first, rounds)
    n = np.add.reduceat(copies, first)
    if correct:
        pair = pair + n * np.log(0.5)
    k = np.where(seen.any(1), width - seen[:, ::-1].argmax(1) - seen.argmax(1), 0)
    if bic:
        return k * np.log(np.maximum(n, 1)) - 2 * (pair - single)
    return stats.chi2_tails(2 * (pair - single), np.maximum(k, 1))


def allele_test(seqs: Sequence[str], offsets: Sequence[int], width: int, **options) -> float:
    """The test of one window."""
    return float(allele_tests(seqs, offsets, np.ones(len(seqs)), [0], width, **options)[0])


#: Windows that one call of the kernel tests, about.
WINDOWS = 64


def window_tests(epireads: DataFrame, width: int = 10, least: int = 40, **options) -> DataFrame:
    """The test in every window of ``width`` sites with at least ``least`` states: (chrom, w, reads, score). A read is copied to the windows it overlaps.

    Reads that show a window the same are counted before anything is shuffled by window, so a group is bounded by kinds of reads, not by depth; neighbouring windows are tested together.
    """
    starts = F.sequence(F.greatest(F.col("pos") - width + 1, F.lit(0)), F.col("pos") + F.length("seq") - 1)
    rows = epireads.where("length(seq) > 0").select("chrom", "pos", "seq", F.explode(starts).alias("w"))
    cut = F.greatest(F.col("w") - F.col("pos"), F.lit(0))
    end = F.least(F.col("pos") + F.length("seq"), F.col("w") + width)
    rows = rows.select("chrom", "w", (F.greatest("pos", "w") - F.col("w")).alias("o"), F.substr("seq", (cut + 1).cast("int"), (end - F.greatest("pos", "w")).cast("int")).alias("s"))
    kinds = rows.groupBy("chrom", "w", "o", "s").agg(F.count(F.lit(1)).alias("k")).withColumn("part", F.floor(F.col("w") / WINDOWS))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["w", "o", "s"])
        states = (g["s"].str.len() * g["k"]).groupby(g["w"]).transform("sum")
        g = g[states >= least]
        if not len(g):
            return pd.DataFrame({"chrom": pd.Series([], dtype=object), "w": pd.Series([], dtype="int64"), "reads": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})
        w = g["w"].to_numpy()
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        score = allele_tests(g["s"].tolist(), g["o"].to_numpy(), g["k"].to_numpy(), first, width, **options)
        return pd.DataFrame({"chrom": g["chrom"].iloc[0], "w": w[first], "reads": np.add.reduceat(g["k"].to_numpy(), first), "score": score})

    return kinds.groupBy("chrom", "part").applyInPandas(run, "chrom string, w long, reads long, score double")


def allele_regions(epireads: DataFrame, width: int = 10, gap: int = 1, cutoff: float = 0.01, states: int = 4, use_fdr: bool = True, **options) -> DataFrame:
    """Regions of windows with significant allele-specific methylation, in ordinals of sites: (chrom, start, stop, score).

    Windows are adjusted by Benjamini and Hochberg over all that were tested; overlapping ones and those within ``gap`` merge, with their least score; regions
    shorter than half a window are dropped.
    """
    tested = window_tests(epireads, width, states * width, **options)
    scored = ordered.adjusted(tested, "score").withColumn("score", F.col("fdr")) if use_fdr else tested
    hits = scored.where(F.col("score") < cutoff).select("chrom", F.col("w").alias("start"), (F.col("w") + width).alias("stop"), "score")
    merged = ranges.merge_touching(hits, gap, aggs=(F.min("score").alias("score"),))
    return merged.where(F.col("stop") - F.col("start") >= width / 2)


def region_tests(intervals: DataFrame, epireads: DataFrame, **options) -> DataFrame:
    """The test over given intervals in ordinals of sites: (chrom, start, stop, reads, score); 1 without reads."""
    ends = epireads.where("length(seq) > 0").withColumn("read_stop", F.col("pos") + F.length("seq"))
    reads = ends.select("chrom", F.col("pos").alias("start"), F.col("read_stop").alias("stop"), "seq")
    pairs = ranges.overlaps(intervals.select("chrom", "start", "stop").distinct(), reads.select("chrom", "start", "stop").distinct())
    joined = pairs.join(reads.select("chrom", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), "seq"), ["chrom", "b_start", "b_stop"])

    kinds = joined.groupBy("chrom", "a_start", "a_stop", "b_start", "seq").agg(F.count(F.lit(1)).alias("k"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["b_start", "seq"])
        start, stop = int(g["a_start"].iloc[0]), int(g["a_stop"].iloc[0])
        score = allele_tests(g["seq"].tolist(), (g["b_start"] - start).to_numpy(), g["k"].to_numpy(), [0], stop - start, **options)
        return pd.DataFrame({"chrom": [g["chrom"].iloc[0]], "start": [start], "stop": [stop], "reads": [int(g["k"].sum())], "score": score})

    done = kinds.groupBy("chrom", "a_start", "a_stop").applyInPandas(run, "chrom string, start long, stop long, reads long, score double")
    return intervals.join(done, ["chrom", "start", "stop"], "left").na.fill({"reads": 0, "score": 1.0})
