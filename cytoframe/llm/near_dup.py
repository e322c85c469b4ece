"""Near-duplicate documents by HyperMinHash.

A document's set holds hashes of its distinct runs of five lower-cased words. Its sketch has 128 registers of 16
bits: ``2 ** level`` buckets under each of ``128 / 2 ** level`` seeds, each keeping of its smallest hash the number of
leading zeros (6 bits) and the 10 bits that follow. The level grows with the set, so that a bucket gets four elements
or more; a document near the border of two levels has a sketch for both, so that any two sets
whose sizes allow the similarity share a level. Four registers make a band of 64 bits. Sets that share a band are
candidates; their registers give a Jaccard estimate, corrected for chance collisions of compressed registers, and
pairs that may reach the threshold are confirmed on the full sets.

At a similarity of exactly 0.75 two documents miss every band with a probability of 0.000005, and the estimate
rejects them (at 4.5 standard deviations) with 0.000004.

No group is expanded into its pairs. Equal word sequences become one class first. Members of a band are compared with
one pivot; then only members that are still in different components are compared: all of them where a band holds
few, else with the most central pivot as long as that connects an eighth of them, and last in blocks, where numpy compares pairs without writing them out.
So every candidate pair is either compared or already connected: nothing is capped. Bands with many members are dealt to tasks in parts.

Everything that is kept between steps is a table in the shared folder; the driver sees counts only.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are their own component;
a text with fewer than five words has one run, its whole sequence; a null doc_id takes part and is last in order, so
component_id is null only where all ids of a component are; rows that repeat a doc_id count as documents of their
own; texts of any length are read whole; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cytoframe.llm import wordscan
from cytoframe.llm.common import discard, settle, sparing

U = np.uint64
WIDTH, PERCENT = 5, 75
REGISTERS, BAND, TOP, LOAD = 128, 4, 7, 4
EMPTY = 0xFFFF
SEEDS = wordscan.mixed(np.arange(1, REGISTERS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
#: Pairs with an estimate below this cannot be expected to reach the threshold.
LEAST = PERCENT / 100 - 4.5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
#: Bands with at most this many members are compared pair by pair; larger ones in blocks of about BLOCK.
FEW, BLOCK, BLOCK_SIZE = 32, 1024, 4_000_000
#: Members of a large band are compared with one pivot again as long as a round connects this share of the open ones; rounds at most.
WORTH, CENTRES = 1 / 8, float("inf")
#: Keys of texts that are broadcast at most, some 90 MB with the table they are looked up in; more of them meet the texts in a shuffle.
KEYS = 1 << 20
#: Rows of links and members of components in a file of an intermediate table, and the least number of files.
FILE_ROWS, LEAST_FILES = 1 << 18, 2


def shingle_set(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    return np.unique(wordscan.shingles(hashes, width))


def level_of(n: int) -> int:
    return max(0, min(TOP, (n // LOAD).bit_length() - 1))


def levels(n: int) -> list[int]:
    """Levels of the sketches of a set of n: its own, and that of the largest set it can be linked with."""
    return sorted({level_of(n), level_of(n * 100 // PERCENT + 1)})


def compressed(x: np.ndarray) -> np.ndarray:
    """Registers of smallest hashes: leading zeros and the ten bits after the leading one."""
    bits = (np.maximum(x, U(1 << 11)) & ~U(0x7FF)).astype(np.float64).view(U)  # exact: 53 bits at most
    zeros = U(63 + 1023) - (bits >> U(52))
    return ((zeros << U(10)) | ((bits >> U(42)) & U(0x3FF))).astype(np.uint16)


def sketch(s: np.ndarray, level: int) -> np.ndarray:
    """The registers of a set at a level."""
    seeds = REGISTERS >> level
    x = wordscan.mixed(s[None, :] ^ SEEDS[:seeds, None])
    if not level:
        return compressed(x.min(axis=1))
    place = (x >> U(64 - level)).astype(np.int64) + (np.arange(seeds) << level)[:, None]
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, U)
    np.minimum.at(least, place.ravel(), (x << U(level)).ravel())
    out = compressed(least)
    hit = np.zeros(REGISTERS, bool)
    hit[place.ravel()] = True
    out[~hit] = EMPTY
    return out


def band_keys(registers: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each band that has a filled register."""
    words = np.ascontiguousarray(registers).view(U)
    tag = wordscan.mixed(level.astype(U)[:, None] * U(1000) + np.arange(words.shape[1], dtype=U)[None, :] + U(7))
    keys = wordscan.mixed(words ^ tag)
    rows, bands = np.nonzero(words != np.iinfo(np.uint64).max)
    return rows, keys[rows, bands].view(np.int64)


@cache
def collision(level: int, load: int) -> float:
    """Chance that a register of two disjoint sets, of ``load`` elements a bucket, is equal by chance."""
    zeros, mantissa = np.meshgrid(np.arange(40), np.arange(1024), indexing="ij")
    low = 2.0 ** -(zeros + 1) * (1 + mantissa / 1024)
    high = low + 2.0 ** -(zeros + 1) / 1024
    p = (1 - low) ** load - (1 - np.minimum(high, 1)) ** load
    return float((p * p).sum())


def chance(level: int, n: int) -> float:
    return collision(level, min(40, max(1, round(n / 2**level))))


def estimate(a: np.ndarray, b: np.ndarray, chance: np.ndarray | float) -> np.ndarray:
    """Jaccard estimates from registers (rows of a and b), corrected for chance collisions."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    equal = ((a == b) & (a != EMPTY)).sum(-1)
    return (equal / np.maximum(filled, 1) - chance) / (1 - chance)


def scanned(docs: DataFrame, keep: list[str], schema, rows_of) -> DataFrame:
    """Map over ``keep`` and the shingle sets of texts; ``rows_of`` gets word hashes and the set, and gives the further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in wordscan.runs(batch.column(len(keep)), lower=True):
                n, out = len(w.first) - 1, []
                for t in range(n):
                    h = w.hashes[w.first[t] : w.first[t + 1]]
                    out.append(rows_of(h, shingle_set(h), {k: batch.column(j)[i + t].as_py() for j, k in enumerate(keep) if k.startswith("_")}))
                arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, n) for c in batch.columns[:-1]), *arrays], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(schema))
    return docs.select(*keep, F.col("text")).mapInArrow(sparing(run), schema)


def word_class(h: np.ndarray) -> bytes:
    """128 bits for a sequence of words."""
    place = np.arange(1, len(h) + 1, dtype=U)
    one, two = wordscan.mixed(h + place * U(0x9E3779B97F4A7C15)), wordscan.mixed(h ^ (place * U(0xC2B2AE3D27D4EB4F)))
    return one.sum(dtype=U).tobytes() + two.sum(dtype=U).tobytes()


def text_key(text: str = "text") -> Column:
    """64 bits of the text itself; with doc_id it tells rows apart, but for exact repeats."""
    return F.xxhash64(text)


def sketched(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x, cls, n, sketches), one for each document; x is the key of the text."""
    keyed = docs.select("doc_id", text_key().alias("x"), "text")
    schema = keyed.select("doc_id", "x").schema.add("cls", "binary").add("n", "long").add("p1", "integer").add("r1", "binary").add("p2", "integer").add("r2", "binary")

    def row(h, s, _):
        if not len(s):
            return word_class(h), 0, None, None, None, None
        own = levels(len(s))
        made = [x for p in own for x in (p, sketch(s, p).tobytes())]
        return (word_class(h), len(s), *made, *([None] * (4 - len(made))))

    return scanned(keyed, ["doc_id", "x"], schema, row)


def in_bands(nodes: DataFrame) -> DataFrame:
    """Rows (key, level, node) of every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for level, registers in ((1, 2), (3, 4)):
                has = batch.column(level).is_valid().to_numpy(zero_copy_only=False)
                if has.any():
                    r = np.frombuffer(b"".join(batch.column(registers).drop_null().to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    p = batch.column(level).drop_null().to_numpy()
                    rows, keys = band_keys(r, p)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p[rows]), pa.array(node[has][rows])], names=["key", "level", "node"])

    return nodes.select("node", "p1", "r1", "p2", "r2").mapInArrow(sparing(run), "key long, level int, node long")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sizes and registers allow the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "p1", "r1", "p2", "r2")])
    fits = 100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    same = [(x, y) for x in "12" for y in "12"]
    pick = lambda f: F.coalesce(*[F.when(F.col(f"a_p{x}") == F.col(f"b_p{y}"), f(x, y)) for x, y in same])
    chosen = both.select("a", "b", "a_n", pick(lambda x, y: F.col(f"a_p{x}")).alias("p"), pick(lambda x, y: F.col(f"a_r{x}")).alias("ra"), pick(lambda x, y: F.col(f"b_r{y}")).alias("rb")).where("p is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
                by_chance = np.array([chance(p, n) for p, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)])
                good = pa.array(estimate(ra, rb, by_chance) >= LEAST)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return chosen.mapInArrow(sparing(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that reach the threshold on their full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"{x}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("a_set", "b_set")))
    return both.where(100 * F.col("shared") >= PERCENT * (F.size("a_set") + F.size("b_set") - F.col("shared"))).select("a", "b").distinct()


def stars(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, root) of all nodes on edges (a, b), the root being the smallest node; and the settled table behind them. Alternates large and small stars."""
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges", files)
    while True:
        # done when every node has one edge down and those at its lower end have none
        forks = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if forks.union(edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), edges
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, "near-large", files)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m")).distinct()
        small = settle(small, "near-edges", files)
        discard(edges, large)
        edges = small


def components(links: DataFrame, roots: DataFrame | None, files: int) -> DataFrame:
    """Rows (node, root) of all nodes on links (a, b) so far, given the roots before these links. Only roots that the links connect are worked on."""
    if roots is None:
        over, behind = stars(links, files)
        out = settle(over, "near-roots", files)
        discard(behind)
        return out
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over, behind = stars(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), files)
    moved = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = settle(known.union(over.join(roots, "node", "left_anti")), "near-roots", files)
    discard(behind, roots)
    return out


def unresolved(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, level, pivot, size, node, root) of the bands whose members are in more than one component.

    What is found out of a band is a row for each key; it meets the members by key and part, so that a band of many members isn't one task's.
    """
    rows = members.join(roots, "node", "left").select("key", "level", "pivot", "size", "node", F.coalesce("root", "node").alias("root"))
    open_keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("size")).where("low <> high")
    return in_parts(rows, "node").join(all_parts(open_keys.select("key", "size")).drop("size"), ["key", "part"]).drop("part")


def in_parts(rows: DataFrame, by: str) -> DataFrame:
    """Add the part of a member in its band of ``size`` members: about BLOCK of them to a part."""
    return rows.withColumn("part", F.pmod(F.xxhash64(F.lit(5), by), F.ceil(F.col("size") / BLOCK)))


def all_parts(keys: DataFrame) -> DataFrame:
    """One row for each part of the bands."""
    return keys.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1)))


def pairs_of(rows: DataFrame) -> DataFrame:
    """All pairs in a band that lie in different components; for bands of FEW members at most."""
    other = rows.select("key", F.col("node").alias("b"), F.col("root").alias("b_root"))
    return rows.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("b_root"))).select(F.col("node").alias("a"), "b").distinct()


def centres(rows: DataFrame) -> DataFrame:
    """Pairs of the members of large bands with one pivot of the band, in other components: the member that shares most bands with most others.

    The document that others were copied from shares more bands with them than they share with each other.
    """
    weight = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = rows.join(weight, "node")
    best = ranked.groupBy("key").agg(F.max("size").alias("size"), F.max(F.struct("weight", (-F.col("node")).alias("less"), "node", "root")).alias("best"))
    return in_parts(ranked, "node").join(all_parts(best).drop("size"), ["key", "part"]).where("root <> best.root").select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")).distinct()


def by_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components inside large bands.

    Bands with the same pivot, which mostly hold the same documents, are taken together. Their members are dealt into blocks of BLOCK rows, or of BLOCK_SIZE
    shingles, and each two blocks meet in one group. There numpy finds the pairs that share a band and whose registers allow the threshold, and
    compares their full sets. Pairs are not written out: a link joins components within the group, and pairs inside a component are
    passed over, so a group gives fewer links than it has rows.
    """
    rows = rows.select("pivot", "level", "node", "root").distinct().join(sets, "node")
    sizes = rows.groupBy("pivot", "level").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SIZE)).cast("int").alias("blocks"))
    sizes = settle(sizes, "near-blocks", LEAST_FILES)  # else a pivot with many members couldn't be split among tasks in the join
    rows = rows.join(sizes, ["pivot", "level"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    registers = F.when(F.col("p1") == F.col("level"), F.col("r1")).otherwise(F.col("r2"))
    wide = meet.select("pivot", "level", "node", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "n", registers.alias("r"), "members")

    def run(table: pa.Table) -> pa.Table:
        x, y, level = (table.column(c)[0].as_py() for c in ("x", "y", "level"))
        node, own, n = (table.column(c).to_numpy() for c in ("node", "own", "n"))
        part = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        regs = np.frombuffer(b"".join(table.column("r").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        bands = regs.view(U)
        lists = table.column("members").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        right, a, b = own == y, [], []
        for i in np.flatnonzero(own == x):
            j = np.flatnonzero(right & (part != part[i]))
            j = j[j > i] if x == y else j
            j = j[100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i])]
            if not len(j):
                continue
            j = j[((bands[j] == bands[i]) & (bands[i] != np.iinfo(np.uint64).max)).any(1)]
            j = j[estimate(regs[i][None], regs[j], chance(level, int(n[i]))) >= LEAST]
            mine = flat[at[i] : at[i + 1]]
            for k in j:
                if part[k] != part[i]:
                    theirs = flat[at[k] : at[k + 1]]
                    shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if 100 * shared >= PERCENT * (len(mine) + len(theirs) - shared):
                        a.append(min(node[i], node[k]))
                        b.append(max(node[i], node[k]))
                        part[part == part[k]] = part[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    wide = wide.repartition("pivot", "level", "x", "y")  # else all blocks of a pivot would stay in the task that counted them
    return wide.groupBy("pivot", "level", "x", "y").applyInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (doc_id, x, cls, n) of documents, and (cls, component_id, keep_id, keep_x) of classes with a set.

    A class is known by its smallest doc_id, and of rows that repeat that by one of the texts.
    """
    seen = settle(sketched(docs), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "x"))
    classes = seen.where("n > 0").groupBy("cls").agg(first.alias("rep"), *[F.first(c).alias(c) for c in ("n", "p1", "r1", "p2", "r2")])
    classes = classes.select("cls", F.col("rep.doc_id").alias("rep"), F.col("rep.x").alias("rep_x"), "n", "p1", "r1", "p2", "r2")
    classes = classes.repartitionByRange(F.col("rep").asc_nulls_last()).sortWithinPartitions(F.col("rep").asc_nulls_last())
    nodes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")  # in order of the smallest id
    files = max(LEAST_FILES, nodes.count() // FILE_ROWS)

    tops = in_bands(nodes).groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    tops = settle(tops, "near-tops", files)  # else a band with many members couldn't be split among tasks in the join
    members = settle(in_bands(nodes).join(tops, "key"), "near-members", 8 * files)
    starts = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").withColumnsRenamed({"rep": "_rep", "rep_x": "_x", "cls": "_cls"})
    keyed, keys = docs.select("doc_id", text_key().alias("x"), "text"), wanted.select("_rep", "_x")
    if wanted.count() <= KEYS:  # few texts are wanted: the others need not be shuffled
        keyed = keyed.join(F.broadcast(keys), (F.col("x") == F.col("_x")) & F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    d, w = keyed.alias("d"), wanted.alias("w")
    same = (F.col("d.x") == F.col("w._x")) & F.col("d.doc_id").eqNullSafe(F.col("w._rep"))
    texts = d.join(w, same).select("w.node", "w._cls", "w.n", "w.p1", "w.r1", "w.r2", "d.text")
    kept = ["node", "_cls", "n", "p1", "r1", "r2"]
    schema = texts.select(*kept).schema.add("same", "boolean").add("members", ArrayType(LongType()))
    sets = scanned(texts, kept, schema, lambda h, s, more: (word_class(h) == more["_cls"], s.view(np.int64)))
    sets = settle(sets.where("same").drop("_cls", "same"), "near-sets")

    links = settle(confirmed(possible(starts, nodes), sets), "near-links", files)
    roots = components(links, None, files)
    discard(links, tops)
    rest = settle(unresolved(members, roots), "near-rest", 8 * files)
    rounds = 0
    while rounds < CENTRES:
        rounds += 1
        large = rest.where(F.col("size") > FEW)
        open_nodes = large.select("node").distinct().count()
        if not open_nodes:
            break
        links = settle(confirmed(possible(centres(large), nodes), sets), "near-links", files)
        found = links.count()
        if found:
            roots = components(links, roots, files)
            old, rest = rest, settle(unresolved(members, roots), "near-rest", 8 * files)
            discard(old)
        discard(links)
        if found < WORTH * open_nodes:
            break
    few = confirmed(possible(pairs_of(rest.where(F.col("size") <= FEW)), nodes), sets)
    links = settle(few.union(by_blocks(rest.where(F.col("size") > FEW), sets)), "near-links", files)
    if not links.isEmpty():
        roots = components(links, roots, files)
    discard(links, rest, members, sets)

    named = roots.join(nodes.select(F.col("node").alias("root"), F.col("rep").alias("component_id")), "root").select("node", "component_id", (F.col("node") == F.col("root")).alias("top"))
    kept = F.when(F.coalesce("top", F.lit(True)), F.struct(F.col("rep").alias("id"), F.col("rep_x").alias("x"))).alias("keep")
    out = nodes.join(named, "node", "left").select("cls", F.when(F.col("top").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), kept)
    out = settle(out, "near-classes", files)
    discard(roots, nodes)
    return seen.select("doc_id", "x", "cls", "n"), out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each document."""
    seen, classes = link(docs)
    both = seen.join(classes, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, and those with an empty set, with their columns, whatever their names.

    Of rows that repeat the smallest doc_id and its words, one stays.
    """
    seen, classes = link(docs)
    kept = classes.where("keep is not null").select(F.col("cls").alias("_cls"), F.col("keep.id").alias("_id"), F.col("keep.x").alias("_x"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key().alias("x"))
    same = lambda x, y: (F.col(f"{x}x") == F.col(f"{y}x")) & F.col(f"{x}id").eqNullSafe(F.col(f"{y}id"))
    rows = seen.select(F.col("doc_id").alias("id"), "x", "n").groupBy("id", "x").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    wanted = kept.join(rows, same("", "_")).select("_id", "_x", "rows")
    empty = rows.where("n = 0").select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.lit(0).cast("long").alias("rows"))
    wanted = settle(wanted.union(empty), "near-kept")
    found = packed.join(wanted.where("rows <= 1"), same("", "_"), "left_semi").select("row")
    again = wanted.where("rows > 1")
    if not again.isEmpty():
        found = found.union(packed.join(again, same("", "_"), "left_semi").dropDuplicates(["id", "x"]).select("row"))
    return found.select("row.*")
