"""Operators on cytosine sites: rows (chrom, pos, strand, context, n_meth, n_reads), with sample where there are several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions import expr as E
from cytoframe.plans import ranges

KEY = ("chrom", "pos")


def covered(sites: DataFrame) -> DataFrame:
    """Sites with reads, or that look mutated."""
    return sites.where((F.col("n_reads") > 0) | E.is_mutated())


def select_sites(sites: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sites inside any interval. Intervals are merged first, so that a site meets one at most."""
    return ranges.point_in_interval(sites, ranges.merge_touching(intervals), how="left_semi")


def covered_in(sites: DataFrame, every: bool) -> DataFrame:
    """(chrom, pos) of sites with reads in all samples that have the site, or in any."""
    reads = F.min("n_reads") if every else F.max("n_reads")
    return sites.groupBy(*KEY).agg(reads.alias("n_reads")).where("n_reads > 0").select(*KEY)


def fold_partial(sites: DataFrame) -> DataFrame:
    """Counts folded about one half, so that partly methylated sites read as low."""
    meth = F.round(E.fold_partial(E.level()) * F.col("n_reads")).cast("long")
    return sites.withColumn("n_meth", meth)


def symmetric(sites: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """CpG sites with both strands of a pair merged at the plus strand's position."""
    own = F.col("pos") - F.when(F.col("strand") == "-", 1).otherwise(0)
    rows = sites.where(E.is_cpg()).withColumn("pos", own)
    out = rows.groupBy(*keys, "pos").agg(F.max(E.is_mutated().cast("int")).alias("mutated"), F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"), F.count(F.lit(1)).alias("strands"))
    return out.select(*keys, "pos", F.lit("+").alias("strand"), F.when(F.col("mutated") == 1, "CpGx").otherwise("CpG").alias("context"), "n_meth", "n_reads", "strands")


def merge_counts(sites: DataFrame, keep_mutated: bool = False) -> DataFrame:
    """Counts of several samples summed by position: a union and one aggregation instead of full outer joins."""
    merged = sites.groupBy(*KEY).agg(
        F.min_by("strand", F.struct("sample", "strand")).alias("strand"), F.min_by("context", F.struct("sample", "context")).alias("context"), F.max(E.is_mutated().cast("int")).alias("mutated"),
        F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"),
    )
    mutated = (F.col("mutated") == 1) if keep_mutated else F.lit(False)
    return merged.select(*KEY, "strand", E.set_mutated("context", mutated).alias("context"), "n_meth", "n_reads")


def merge_table(sites: DataFrame, samples: Sequence[str], value: str = "counts", min_reads: int = 1) -> DataFrame:
    """One row for each site with reads and methylated reads of each sample (0 where missing), or levels (null below ``min_reads``)."""
    name = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "strand", E.set_mutated("context", F.lit(False)))
    rows = sites.withColumn("site", name)
    of = lambda s, c: F.sum(F.when(F.col("sample") == s, F.col(c)))
    if value == "counts":
        cells = [F.coalesce(of(s, c), F.lit(0)).alias(f"{s}_{short}") for s in samples for short, c in (("R", "n_reads"), ("M", "n_meth"))]
    else:
        cells = [F.when(of(s, "n_reads") >= min_reads, F.round(of(s, "n_meth").cast("double") / of(s, "n_reads"), 6)).alias(f"{s}_level") for s in samples]
    return rows.groupBy("site").agg(*cells)


def lift(sites: DataFrame, index: DataFrame, plus_strand: bool = False) -> DataFrame:
    """Sites at their coordinates in another assembly; ``index`` rows (from_chrom, from_pos, to_chrom, to_pos, to_strand), the last of repeated keys wins by to-coordinates."""
    last = index.groupBy("from_chrom", "from_pos").agg(F.max(F.struct("to_chrom", "to_pos", "to_strand")).alias("to"))
    at = sites.join(last, (F.col("chrom") == F.col("from_chrom")) & (F.col("pos") == F.col("from_pos")))
    minus = F.lit(plus_strand) & (F.col("to.to_strand") == "-")
    return at.select(F.col("to.to_chrom").alias("chrom"), (F.col("to.to_pos") - F.when(minus, 1).otherwise(0)).alias("pos"), F.when(minus, "+").otherwise(F.col("to.to_strand")).alias("strand"), "context", "n_meth", "n_reads")


def unlifted(sites: DataFrame, index: DataFrame) -> DataFrame:
    return sites.join(index, (F.col("chrom") == F.col("from_chrom")) & (F.col("pos") == F.col("from_pos")), "left_anti")


def merge_lifted(sites: DataFrame, unique: bool = False) -> DataFrame:
    """Sites that landed on one position, merged by coverage; or only those that nothing else landed on."""
    out = sites.groupBy("chrom", "pos", "strand").agg(F.min("context").alias("context"), F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"), F.count(F.lit(1)).alias("copies"))
    return (out.where("copies = 1") if unique else out).drop("copies")


def inconsistent(sites: DataFrame, samples: int) -> DataFrame:
    """Positions that some sample lacks."""
    return sites.groupBy(*KEY).agg(F.count_distinct("sample").alias("samples")).where(F.col("samples") < samples)


def to_deltas(sites: DataFrame) -> DataFrame:
    """Compact counts: covered sites by distance from the one before on the chromosome."""
    line = Window.partitionBy("chrom").orderBy("pos")
    return sites.where("n_reads > 0").select("chrom", "pos", (F.col("pos") - F.lag("pos", 1, 0).over(line)).alias("delta"), "n_meth", (F.col("n_reads") - F.col("n_meth")).alias("n_unmeth"))


def from_deltas(rows: DataFrame, order: str) -> DataFrame:
    """Positions back from distances, in the rows' order."""
    line = Window.partitionBy("chrom").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("chrom", F.sum("delta").over(line).alias("pos"), "n_meth", "n_unmeth")


#: Bases of a piece of a chromosome; pieces overlap, so that no test crosses their border.
PIECE = 256


def pieces(genome: DataFrame, before: int, after: int, piece: int = PIECE) -> DataFrame:
    """Chromosomes cut up: (chrom, at, lead, n, s), where ``s`` holds bases from ``at - lead`` on, and ``n`` of them belong to the piece.

    Bytes are sliced, as positions of a string are found by counting from its start; the long string isn't copied to the pieces' rows.
    """
    cut = (f"struct(k * {piece} as at, least(k * {piece}, {before}) as lead, least({piece}, octet_length(b) - k * {piece}) as n,"
           f" cast(substring(b, greatest(k * {piece} - {before}, 0) + 1, {piece} + least(k * {piece}, {before}) + {after}) as string) as s)")  # fmt: skip
    every = F.expr(f"transform(array(cast(upper(seq) as binary)), b -> transform(sequence(0, (octet_length(b) - 1) div {piece}), k -> {cut}))[0]")
    return genome.where(F.length("seq") > 0).select("chrom", F.explode(every).alias("x")).select("chrom", "x.*")


def cytosines(genome: DataFrame) -> DataFrame:
    """All cytosines of both strands: (chrom, pos, strand, context)."""
    cut = pieces(genome, 2, 2)
    found = cut.select("chrom", "at", "lead", "s", F.explode(F.expr("filter(sequence(1, n), i -> substr(s, i + lead, 1) in ('C', 'G'))")).alias("i"))
    at = lambda k: F.when(F.col("i") + F.col("lead") + k >= 1, F.substr("s", (F.col("i") + F.col("lead") + k).cast("int"), F.lit(1))).otherwise("")
    x = found.select("chrom", (F.col("at") + F.col("i") - 1).cast("long").alias("pos"), at(0).alias("b"), at(1).alias("n1"), at(2).alias("n2"), at(-1).alias("p1"), at(-2).alias("p2"))
    tag = lambda n1, n2, mate, stop: F.when(F.col(n1) == mate, "CpG").when(F.col(n1).isin(*stop) & F.col(n2).isin(*stop), "CHH").when(F.col(n1).isin(*"ATN") & (F.col(n2) == mate), "CXG").otherwise("CCG")
    plus, minus = tag("n1", "n2", "G", "ACTN"), tag("p1", "p2", "C", "AGTN")
    return x.select("chrom", "pos", F.when(F.col("b") == "C", "+").otherwise("-").alias("strand"), F.when(F.col("b") == "C", plus).otherwise(minus).alias("context"))


def recovered(sites: DataFrame, genome_sites: DataFrame, all_chroms: bool = False) -> DataFrame:
    """Every cytosine of the genome, with counts where there are any and zeros elsewhere; chromosomes without sites only if asked for."""
    spine = genome_sites if all_chroms else genome_sites.join(sites.select("chrom").distinct(), "chrom", "left_semi")
    counts = sites.select("chrom", "pos", "n_meth", "n_reads")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return spine.join(counts, ["chrom", "pos"], "left").select("chrom", "pos", "strand", "context", zero("n_meth"), zero("n_reads"))


def kmer_sites(genome: DataFrame, kmer: str = "CG", offset: int = 1) -> DataFrame:
    """Positions of a k-mer, plus an offset."""
    k = len(kmer)
    at = F.expr(f"filter(sequence(1, n), i -> substr(s, i, {k}) = '{kmer.upper()}')")
    found = pieces(genome, 0, k - 1).select("chrom", "at", F.explode(at).alias("i"))
    return found.select("chrom", (F.col("at") + F.col("i") - 1 + offset).cast("long").alias("pos"))


def common_order(orders: Sequence[Sequence[str]]) -> list[str]:
    """One order of chromosomes that agrees with all of the given ones, on the driver; raises where they contradict each other."""
    before: dict[str, set[str]] = {}
    for order in orders:
        for i, c in enumerate(order):
            before.setdefault(c, set()).update(order[max(0, i - 1) : i])
    out: list[str] = []
    while before:
        free = next((c for c in before if not before[c] - set(out)), None)
        if free is None:
            raise ValueError("chromosome orders contradict each other")
        out.append(free)
        del before[free]
    return out


def difference(a: DataFrame, b: DataFrame, pseudo: int = 1, nonzero_only: bool = False) -> DataFrame:
    """Two conditions site by site: the probability that the level of ``a`` is above that of ``b``."""
    from cytoframe.operators.kernels import score_column

    pick = lambda d, s: d.select("chrom", "pos", "strand", "context", F.col("n_meth").alias(f"meth_{s}"), (F.col("n_reads") - F.col("n_meth")).alias(f"unmeth_{s}"))
    both = pick(a, "a").join(pick(b, "b").drop("strand", "context"), ["chrom", "pos"])
    if nonzero_only:
        both = both.where((F.col("meth_a") + F.col("unmeth_a") > 0) & (F.col("meth_b") + F.col("unmeth_b") > 0))
    score: Column = score_column("hypergeometric_greater", *[F.col(c) + pseudo for c in ("meth_b", "unmeth_b", "meth_a", "unmeth_a")])
    return both.withColumn("score", score)
