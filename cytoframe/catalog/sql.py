"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from cytoframe.sources.adapters import with_views as V  # noqa: F401


def counters(z: str = "1.959963984540054") -> str:
    """The nine counters. A Wilson bound is beyond one half exactly where the score test against one half is significant."""
    return f"""count(n_reads) AS total_sites, count(*) FILTER (n_reads > 0) AS sites_covered, CAST(coalesce(sum(n_meth) FILTER (n_reads > 0), 0) AS BIGINT) AS total_c,
    CAST(coalesce(sum(n_reads - n_meth) FILTER (n_reads > 0), 0) AS BIGINT) AS total_t, CAST(coalesce(max(n_reads), 0) AS BIGINT) AS max_depth,
    count(*) FILTER (n_reads IS NOT NULL AND context LIKE '%x') AS mutations, count(*) FILTER (n_reads > 0 AND n_meth - n_reads / 2.0 > {z} * sqrt(n_reads) / 2) AS called_meth,
    count(*) FILTER (n_reads > 0 AND n_reads / 2.0 - n_meth > {z} * sqrt(n_reads) / 2) AS called_unmeth, coalesce(sum(CAST(n_meth AS DOUBLE) / n_reads) FILTER (n_reads > 0), 0) AS total_meth"""


RATIOS = """total_sites, sites_covered, total_c, total_t, max_depth, mutations, called_meth, called_unmeth, round(total_meth, 6) AS total_meth, total_c + total_t AS coverage,
    round(CAST(sites_covered AS DOUBLE) / nullif(total_sites, 0), 6) AS sites_covered_frac, round(CAST(total_c + total_t AS DOUBLE) / nullif(total_sites, 0), 6) AS mean_depth,
    round(CAST(total_c + total_t AS DOUBLE) / nullif(sites_covered, 0), 6) AS mean_depth_covered, round(total_meth / nullif(sites_covered, 0), 6) AS mean_meth,
    round(CAST(total_c AS DOUBLE) / nullif(total_c + total_t, 0), 6) AS mean_meth_weighted,
    CASE WHEN sites_covered > 0 THEN round(CAST(called_meth AS DOUBLE) / greatest(1, called_meth + called_unmeth), 6) END AS fractional_meth"""

#: CpG pairs of sample-wise sites by an outer join of the two strands: (sample, chrom, pos, context, n_meth, n_reads, strands).
PAIRS = """SELECT coalesce(p.sample, m.sample) AS sample, coalesce(p.chrom, m.chrom) AS chrom, coalesce(p.pos, m.pos - 1) AS pos,
    CASE WHEN coalesce(p.context, '') LIKE '%x' OR coalesce(m.context, '') LIKE '%x' THEN 'CpGx' ELSE 'CpG' END AS context,
    coalesce(p.n_meth, 0) + coalesce(m.n_meth, 0) AS n_meth, coalesce(p.n_reads, 0) + coalesce(m.n_reads, 0) AS n_reads, CAST(CASE WHEN p.pos IS NULL THEN 0 ELSE 1 END + CASE WHEN m.pos IS NULL THEN 0 ELSE 1 END AS BIGINT) AS strands
    FROM (SELECT * FROM sites WHERE strand = '+' AND context LIKE 'CpG%') p FULL JOIN (SELECT * FROM sites WHERE strand = '-' AND context LIKE 'CpG%') m
    ON p.sample = m.sample AND p.chrom = m.chrom AND p.pos = m.pos - 1"""
