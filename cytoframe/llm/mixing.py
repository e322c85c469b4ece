"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are words. A source's target is its share by weight of all words, but three times the source's own
size at most; what a capped source leaves is shared again by weight. The mix is cut into blocks of equal
size. Blocks go to sources by highest quotients ``target / (2k + 1)``, then each source's blocks go to its
shards in the same way by shard size. Within a shard the documents lie in a seeded order, and the shard's
quota of blocks is read off that order, from its start again when it is longer than the shard.

Everything is DataFrame code. A source is split by a seeded hash of doc_id and text into shards, a power of 16, of about a thousand
documents (or of the square root of their number, if that is more) if one source had all, so one source with a third of all rows still
spreads, and a source has no more than 16 times that root of shards, which meet in one task. Sizes are summed before
anything is shuffled by source. The windows over all sources hold one row a source. Documents without words take no part in any order.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, ordered last;
null doc_id is an ordinary value; rows that repeat a doc_id are separate documents; texts of any length are read whole; an empty
table gives an empty result; a table without words gives targets and takes of 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.llm.common import n_words, settle

#: The mix is cut into about this many blocks, of one word at least.
BLOCKS = 1 << 24
#: Rows of a shard, on average, if one source had all rows; the root of their number for more than its square.
SHARD_ROWS = 1000
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def apportion(df: DataFrame, within: Sequence[str], votes: str, seats: str, order: Sequence[str]) -> DataFrame:
    """Add ``quota``: Sainte-Laguë seats of each row among the rows that share ``within``.

    ``seats`` holds the number of seats of the group, on each of its rows. With n rows and V votes the divisor
    lies between V / (seats + n/2) and V / (seats - n/2), so each row has a certain number of seats and only
    about 2n quotients in all are left to be ranked. Ties go by ``order``.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    sure = F.floor(v * (s - F.col("_n") / 2) / F.col("_v") + 0.5) - 1
    most = F.floor(v * (s + F.col("_n") / 2) / F.col("_v") + 0.5) + 1
    bounded = (
        df.withColumn("_v", F.sum(v).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_sure", F.when(F.col("_v") > 0, F.greatest(sure, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("_most", F.when(F.col("_v") > 0, F.greatest(most, F.col("_sure") + 1)).otherwise(1).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    )
    ranked = bounded.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1))).withColumn(
        "_rank", F.row_number().over(group.orderBy((v / (2 * F.col("_k") + 1)).desc(), *order, "_k"))
    )
    won = F.sum(F.when((F.col("_rank") <= F.col("_open")) & (v > 0), 1).otherwise(0))
    return ranked.groupBy(*df.columns).agg((F.first("_sure") + won).cast("long").alias("quota"))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("h"))


def shard_digits(rows: int) -> int:
    """Hexadecimal digits of the order that name a shard."""
    digits = 0
    while 16**digits * max(SHARD_ROWS, math.isqrt(rows)) < rows:
        digits += 1
    return digits


def targets(sizes: DataFrame) -> DataFrame:
    """From rows (source, source_size): add weight and target; the water level is found in order of cap per weight."""
    wide = "decimal(38,0)"
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(line)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((n - 1) % len(WEIGHTS) + 1).cast("int"))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") * (6 / F.col("weight")).cast("long"), "place")
    every = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * MAX_REPEATS
    at = (
        sizes.select("source", "source_size", n.alias("place"), weight.cast("long").alias("weight"))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("below", F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", (F.col("all_size") - F.col("below")).cast(wide) * F.col("weight") > cap.cast(wide) * F.col("heavy"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(every), F.lit(0)))
        .withColumn("free", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
    )
    share = ((F.col("all_size") - F.col("spent")) * F.col("weight")).cast("double") / F.col("free").cast("double")
    return at.select("source", "source_size", "place", "all_size", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = "mix-1", blocks: int = BLOCKS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source), one for each row of ``docs``."""
    rows = settle(sized(docs, seed), "mix-sizes")
    total = rows.count()
    rows = rows.withColumn("shard", F.substring("h", 1, shard_digits(total)))
    shards = settle(rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "mix-shards", max(2, total // SHARD_ROWS >> 16))
    goal = targets(shards.groupBy("source").agg(F.sum("shard_size").alias("source_size")))
    block = F.greatest(F.lit(1), (F.col("all_size") / blocks).cast("long"))
    goal = goal.withColumn("block", block).withColumn("seats", (F.col("all_size") / F.col("block")).cast("long"))
    by_source = apportion(goal, [], "target", "seats", ["place"]).withColumnRenamed("quota", "source_seats")
    by_source = settle(by_source.select("source", "place", "source_size", "target", "block", "source_seats"), "mix-sources", 2)
    s, q = shards.alias("s"), by_source.alias("q")
    dealt = s.join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).select("s.*", "q.place", "q.source_size", "q.target", "q.block", "q.source_seats")
    quotas = apportion(dealt, ["place"], "shard_size", "source_seats", ["shard"])
    want = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * MAX_REPEATS)
    quotas = quotas.withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(want / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0).cast("long"))
    quotas = quotas.withColumn("rest", want - F.col("rounds") * F.col("shard_size"))
    r, q = rows.alias("r"), quotas.alias("q")
    both = r.where("size > 0").join(q, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.shard") == F.col("q.shard")))
    both = both.select("r.doc_id", "r.source", "r.size", "r.h", "q.place", "q.shard", "q.source_size", "q.target", "q.rounds", "q.rest")
    q = by_source.alias("q")
    blank = r.where("size = 0").join(q, F.col("r.source").eqNullSafe(F.col("q.source")))
    blank = blank.select("r.doc_id", "r.size", "q.source_size", "q.target", F.lit(0).cast("long").alias("taken"), "r.source")
    upto = F.sum("size").over(Window.partitionBy("place", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    part = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("rest")) - (F.col("upto") - F.col("size")))
    both = both.withColumn("upto", upto)
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds") + part).cast("long").alias("taken"), "source").union(blank)


def repeat_documents(docs: DataFrame, seed: str = "mix-1", blocks: int = BLOCKS) -> DataFrame:
    """The mix as documents: each row as many times as the words taken fill it, the last time if by half at least.

    The columns are those of ``docs``. Rows that repeat a doc_id, source and size are alike to the mix and share what it takes of them.
    """
    taken = mix(docs, seed, blocks).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    times = F.floor(F.col("taken") / (F.greatest(F.col("size"), F.lit(1)) * F.col("rows")) + 0.5).cast("int")
    taken = taken.select("doc_id", "source", "size", times.alias("times")).where("times > 0").alias("t")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size")).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    both = packed.join(taken, same[0] & same[1] & same[2]).select("d._row", F.explode(F.sequence(F.lit(1), F.col("t.times"))).alias("_time"))
    return both.select("_row.*")
