"""Scalar expressions over sites: all are built-in column functions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile at 0.975 (fixed value, so that two engines agree).
Z_05 = 1.959963984540054


def z_of(alpha: float) -> float:
    return Z_05 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wilson(n_meth: Column | str, n_reads: Column | str, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval of a binomial proportion; (0, 1) where there are no reads."""
    n, m = col(n_reads).cast("double"), col(n_meth).cast("double")
    z, p = F.lit(z_of(alpha)), F.try_divide(m, n)
    scale = 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.greatest(F.lit(0.0), F.try_divide(centre - half, scale))
    high = F.least(F.lit(1.0), F.try_divide(centre + half, scale))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)


def level(n_meth: Column | str = "n_meth", n_reads: Column | str = "n_reads") -> Column:
    """Methylation level; 0 where there are no reads."""
    return col(n_meth).cast("double") / F.greatest(F.lit(1), col(n_reads)).cast("double")


def is_cpg(c: Column | str = "context") -> Column:
    return F.startswith(col(c), F.lit("CpG"))


def is_chh(c: Column | str = "context") -> Column:
    return F.startswith(col(c), F.lit("CHH"))


def is_ccg(c: Column | str = "context") -> Column:
    return F.startswith(col(c), F.lit("CCG"))


def is_cxg(c: Column | str = "context") -> Column:
    return F.startswith(col(c), F.lit("CXG"))


def is_mutated(c: Column | str = "context") -> Column:
    return F.endswith(col(c), F.lit("x"))


def set_mutated(c: Column | str, yes: Column) -> Column:
    bare = F.regexp_replace(col(c), "x$", "")
    return F.when(yes, F.concat(bare, F.lit("x"))).otherwise(bare)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGT", "TGCA"))


def base_count(seq: Column | str, base: str) -> Column:
    return F.length(col(seq)) - F.length(F.replace(col(seq), F.lit(base), F.lit("")))


def fold_partial(meth: Column | str) -> Column:
    """0 for a half methylated site, 1 for either extreme, so that partly methylated regions look like low ones."""
    m = col(meth)
    return F.when(m <= 0.5, 1 - 2 * m).otherwise(1 - 2 * (1 - m))


def overdispersion_factor(n_reads: Column | str, phi: Column | str) -> Column:
    return (col(n_reads) - 1) / (col(phi) + 1)


def logistic(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))

