"""Statistics in numpy, for kernels that no column function expresses."""

from __future__ import annotations

import math

import numpy as np

#: Whole numbers up to this have their factorials looked up.
LOOKED_UP = 1 << 22
#: Terms of ragged sums that are held at a time.
TERMS = 1 << 20


def lgamma(x) -> np.ndarray:
    return lgamma_wide(x)


def ln_factorial(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 0."""
    top = int(n.max(initial=0))
    if top > LOOKED_UP:
        return lgamma_wide(n + 1.0)
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])[n]


def ln_choose(n, k) -> np.ndarray:
    n, k = np.broadcast_arrays(np.asarray(n), np.asarray(k))
    return ln_factorial(n.astype(np.int64)) - ln_factorial(k.astype(np.int64)) - ln_factorial((n - k).astype(np.int64))


def ln_beta(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + np.asarray(b))


def digamma(x) -> np.ndarray:
    """By recurrence up to 8 and the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def lgamma_wide(x) -> np.ndarray:
    """Logarithm of gamma for whole arrays: recurrence up to 8 and Stirling's series."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        shift = np.where(low, shift * np.where(low, z, 1), shift)
        z = np.where(low, z + 1, z)
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(shift)


#: Numbers that gamma_logs takes at a time, so that what it holds stays in a core's cache.
CACHED = 1 << 14


def gamma_logs(x: np.ndarray) -> np.ndarray:
    """Logarithm of gamma and its first two derivatives (three rows), of positive numbers in one dimension."""
    out = np.empty((3, len(x)))
    for at in range(0, len(x), CACHED):
        _gamma_logs(x[at : at + CACHED], *out[:, at : at + CACHED])
    return out


def _gamma_logs(x: np.ndarray, value: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Eight steps of the recurrence for all, whose factors are taken in pairs, and the series at x + 8."""
    y, slope, z = x * (x + 7), 2 * x + 7, x + 8
    product, once, twice = y.copy(), 1 / y, 1 / (y * y)
    for c in (6, 10, 12):  # (x + 1)(x + 6), (x + 2)(x + 5), (x + 3)(x + 4)
        t = y + c
        product *= t
        np.divide(1, t, out=t)
        once += t
        t *= t
        twice += t
    log, r = np.log(z), 1 / z
    q = r * r
    value[:] = (z - 0.5) * log - z + 0.9189385332046727 + r * (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680))) - np.log(product)
    first[:] = log - 0.5 * r - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - slope * once
    second[:] = r + q * (0.5 + r * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * (5 / 66)))))) + slope * slope * twice - 2 * once


def inverse_digamma(y: float, tolerance: float = 1e-10) -> float:
    """Newton's steps from the usual start."""
    x = math.exp(y) + 0.5 if y >= -2.22 else -1 / (y + 0.5772156649015329)
    for _ in range(50):
        h = 1e-5 * x
        slope = (float(digamma(x + h)) - float(digamma(x - h))) / (2 * h)
        step = (float(digamma(x)) - y) / slope
        x = x - step if x > step else x / 2
        if abs(step) < tolerance * x:
            break
    return x


def fit_beta(mean_log_p: float, mean_log_q: float, tolerance: float = 1e-10, rounds: int = 500) -> tuple[float, float]:
    """Maximum-likelihood Beta parameters from the means of log p and log(1 - p)."""
    a = b = 1.0
    for _ in range(rounds):
        base = float(digamma(a + b))
        a2, b2 = inverse_digamma(base + mean_log_p), inverse_digamma(base + mean_log_q)
        done = abs(a2 - a) <= tolerance * max(a2, a) and abs(b2 - b) <= tolerance * max(b2, b)
        a, b = a2, b2
        if done:
            break
    return a, b


def ln_beta_binomial(a: float, b: float, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    n = m + u
    choose = lgamma_wide(n + 1) - lgamma_wide(m + 1) - lgamma_wide(u + 1)
    return choose + lgamma_wide(m + a) + lgamma_wide(u + b) - lgamma_wide(n + a + b) - float(ln_beta(a, b))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: regularised incomplete gamma by series or continued fraction."""
    if not x > 0:
        return 1.0
    a, x = df / 2, x / 2
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if an * d + b else 1e-300)
        c = b + an / c if b + an / c else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_tails(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tails of chi-square for whole degrees of freedom: a finite sum of Poisson terms, or of their like at halves with the normal tail."""
    half, df = np.maximum(np.asarray(x, float), 0) / 2, np.asarray(df, np.int64)
    odd = df % 2 == 1
    with np.errstate(divide="ignore", under="ignore", invalid="ignore"):
        log = np.log(half)
        out = np.where(odd, erfc(np.sqrt(half)), 0.0)
        for k in range(int(df.max(initial=0) + 1) // 2):
            at = k + np.where(odd, 0.5, 0.0)
            term = np.exp(np.where(at > 0, at * np.where(half > 0, log, -np.inf), 0.0) - half - lgamma_wide(at + 1))
            out += np.where(k < df // 2, term, 0)
    return np.clip(out, 0.0, 1.0)


def erfc(x) -> np.ndarray:
    """The series of erf up to 2.5, whose terms are all positive, and beyond it the continued fraction of its complement."""
    x = np.asarray(x, float)
    z = np.abs(x)
    near = np.minimum(z, 2.5)
    term = near.copy()
    total = near.copy()
    for k in range(1, 48):
        term = term * (2 * near * near / (2 * k + 1))
        total = total + term
    inner = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far = np.maximum(z, 2.5)
    fraction = far.copy()
    for k in range(48, 0, -1):
        fraction = far + (k / 2) / fraction
    with np.errstate(under="ignore"):
        outer = np.exp(-far * far) / (math.sqrt(math.pi) * fraction)
    tail = np.where(z <= 2.5, inner, outer)
    return np.where(x >= 0, tail, 2 - tail)


def normal_sf(z) -> np.ndarray:
    return 0.5 * erfc(np.asarray(z, float) / math.sqrt(2))


def normal_quantile(p) -> np.ndarray:
    """A rational approximation (error below 5e-4), and three steps of Newton on the nearer tail."""
    p = np.atleast_1d(np.asarray(p, float))
    q = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(q))
        z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
        for _ in range(3):
            z = z + (normal_sf(z) - q) / (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    z = np.where(q <= 0, np.inf, z)
    return np.where(p < 0.5, -z, z)


def ragged(low: np.ndarray, high: np.ndarray):
    """Runs of rows with at most TERMS numbers from low to below high, as (rows, row of each number in the run, number, first place of each row)."""
    size = np.maximum(high - low, 0)
    upto = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TERMS, side="right")))
        n = size[start:stop]
        rows = np.arange(start, stop)[n > 0]
        n = n[n > 0]
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(rows)), n)
        yield rows, of, low[rows][of] + np.arange(len(of)) - first[of], first
        start = stop


def fisher_two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P-values of 2 x 2 tables: sum of the tables with the same margins that are no likelier."""
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    out = np.ones(len(a))
    row, col, n = a + b, a + c, a + b + c + d
    for rows, of, k, first in ragged(np.maximum(0, row + col - n), np.where(n > 0, np.minimum(row, col) + 1, 0)):
        r, e, m = row[rows], col[rows], n[rows]
        lp = ln_choose(e[of], k) + ln_choose((m - e)[of], r[of] - k) - ln_choose(m, r)[of]
        seen = lp[first + a[rows] - np.maximum(0, r + e - m)]
        out[rows] = np.minimum(1.0, np.add.reduceat(np.where(lp <= seen[of] + 1e-9, np.exp(lp), 0), first)) if len(rows) else out[rows]
    return out


def hypergeometric_greater(ma: np.ndarray, ua: np.ndarray, mb: np.ndarray, ub: np.ndarray) -> np.ndarray:
    """Of counts with pseudo-counts: the probability that b's level is above a's, as a sum of hypergeometric terms."""
    p, q, r, s = (np.asarray(x, np.int64) for x in (ma, ua, mb, ub))
    out = np.zeros(len(p))
    for rows, of, k, first in ragged(np.maximum(0, r - q), r):
        a, b, c, d = p[rows], q[rows], r[rows], s[rows]
        lp = ln_choose((c + d - 1)[of], k) + ln_choose((a + b - 1)[of], (a + c - 1)[of] - k) - ln_choose(a + b + c + d - 2, a + c - 1)[of]
        if len(rows):
            out[rows] = np.add.reduceat(np.exp(lp), first)
    return out
