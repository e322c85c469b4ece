"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(64 x). Rows are dealt into blocks; each task indexes one block and answers one block
of queries on it. In an index block, postings (dimension, row, value) are grouped into segments by quantised impact (the bit
length of the value's size), and segments are processed from high impact to low for many queries at once: a segment is
scattered into a matrix, and a product adds its scores. What is still unprocessed can change a score by no more than the
product of the norms of the query and of the row's unprocessed values; rows that cannot reach the k-th best lower bound are
out, and processing stops early only when few rows are left. Those are rescored exactly in 64-bit integers.

Each block gives its best k of each query; the best k of those is the answer. A query meets every row: work grows with
queries times rows, as asked, but what is shuffled is each block once for every block of queries, and k rows for each query and
block of rows; a task holds two blocks.

Defined cases: vectors that are null, or hold null, NaN or infinite components, and rows without vec_id, take no part;
missing trailing components count 0, so vectors of different lengths compare; the empty vector scores 0; every row is a
candidate, repeated ones too, but for rows with the query's own vec_id; a query whose vec_id and whole numbers repeat answers once; queries with fewer
than k candidates get all; an empty table gives an empty result. Whole numbers are exact over the whole range of 64 bits, and so are scores, where Python's integers
take over when a sum might pass it; components and scores beyond it are its ends, by which such scores tie. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, EVERY = 20, 64, 20
#: Rows of an index block, queries of a query block, queries handled at once; a table of less than BLOCKS blocks is cut into that many, of LEAST rows at least.
BLOCK, QUERIES, BATCH = 16384, 16384, 128
BLOCKS, LEAST = 16, 1024
TOP = (1 << 63) - 1
SURE = TOP * (1 - 1e-9)
SEGMENTS = 3
RESULT = "query_key long, query_id long, vec_id long, score long"


def integers(vector: Column) -> tuple[Column, Column]:
    """floor(64 x) of each component, as int, or as bigint where some do not fit an int; both are null for vectors that take no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # a double beyond the range of bigint becomes its end
    whole = F.transform(vector, lambda x: F.greatest(F.floor(F.greatest(F.least(SCALE * x.cast("double"), F.lit(2.0**63)), F.lit(-(2.0**63)))), F.lit(-TOP)))
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) < float(1 << 24))
    fits = vector.isNotNull() & ~F.coalesce(odd, F.lit(True))
    return F.when(fits & small, F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("int"))), F.when(fits & ~small, whole)


def vectors_of(table: pa.Table, width: int) -> np.ndarray:
    out = matrix(table.column("v"), width)
    if table.column("wide").null_count < len(table):
        out += matrix(table.column("wide"), width)  # of the two one is null, which gives zeros
    return out


def longest(table: pa.Table) -> int:
    return max([0, *(int(np.diff(table.column(c).combine_chunks().offsets.to_numpy()).max(initial=0)) for c in ("v", "wide") if len(table))])


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width), np.int64)
    if len(lists):
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[at[0] : at[-1]]
        n = np.diff(at)
        row = np.repeat(np.arange(len(lists)), n)
        out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], n)] = flat
    return out


class ImpactIndex:
    """Postings of a block of vectors in segments of falling impact."""

    def __init__(self, vectors: np.ndarray, segments: int = SEGMENTS):
        self.vectors = vectors
        self.most = float(np.abs(vectors.astype(float)).max(initial=0))
        row, dim = np.nonzero(vectors)
        value = vectors[row, dim]
        impact = np.frexp(np.abs(value).astype(float))[1]
        order = np.argsort(-impact, kind="stable")
        self.row, self.dim, self.value, impact = row[order], dim[order], value[order], impact[order]
        # segments end where the quantised impact changes, and hold about equal numbers of postings
        ends = np.append(np.flatnonzero(np.diff(impact)) + 1, len(impact))
        wanted = [len(impact) * (i + 1) / segments for i in range(segments)]
        self.ends = sorted({int(ends[min(np.searchsorted(ends, w), len(ends) - 1)]) for w in wanted}) if len(impact) else []
        self.left = []
        square = np.zeros(len(vectors))
        rest = [0, *self.ends]
        for start, end in reversed(list(zip(rest, self.ends, strict=False))):
            self.left.append(np.sqrt(square))
            square = square + np.bincount(self.row[start:end], self.value[start:end].astype(float) ** 2, len(vectors))
        self.left.reverse()

    def segment(self, i: int, kind) -> np.ndarray:
        part = slice(self.ends[i - 1] if i else 0, self.ends[i])
        out = np.zeros(self.vectors.shape[::-1], kind)
        out[self.dim[part], self.row[part]] = self.value[part]
        return out

    def possible(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query (row), which vectors may be among its best k: a Boolean matrix."""
        most = np.abs(queries.astype(float)).sum(1).max(initial=0) * self.most
        kind = np.float32 if most < 1 << 23 else np.float64
        slack = 0.0 if most < 1 << 52 else most * 1e-12
        q, norm = queries.astype(kind), np.sqrt((queries.astype(float) ** 2).sum(1))
        n = len(self.vectors)
        score = np.zeros((len(q), n), kind)
        alive = np.ones((len(q), n), bool)
        for i in range(len(self.ends)):
            score += q @ self.segment(i, kind)
            bound = norm[:, None] * self.left[i][None, :] + slack
            if n > k:
                low = score - bound
                least = np.partition(low, n - k, axis=1)[:, n - k]
                # scores at an end of the range tie, whatever lies beyond
                least = np.where(least < -SURE, -np.inf, np.minimum(least, SURE))
                alive = score + bound >= least[:, None]
                if alive.sum() <= 4 * k * len(q):
                    break
        return alive

    def exact(self, rows: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of some rows, and the order of the best k."""
        vectors = self.vectors[rows]
        if float(np.abs(q.astype(float)).sum()) * float(np.abs(vectors.astype(float)).max(initial=0)) < 1 << 62:
            score = vectors @ q
            return score, np.lexsort((ids, -score))[:k]
        of_rows = [max(-TOP, min(TOP, sum(a * b for a, b in zip(row, q.tolist(), strict=True)))) for row in vectors.tolist()]
        return np.array(of_rows, np.int64), np.array(sorted(range(len(rows)), key=lambda i: (-of_rows[i], ids[i]))[:k], np.int64)

    def best(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
        """(query row, vector row, score) of the best k of each query, ties to the smaller id; rows with the query's own id are out."""
        out = []
        known = np.sort(ids)
        own = int((np.searchsorted(known, query_ids, side="right") - np.searchsorted(known, query_ids)).max(initial=0))
        for start in range(0, len(queries), BATCH):
            q = queries[start : start + BATCH]
            alive = self.possible(q, k + own)  # own rows among the best don't displace others
            for i in range(len(q)):
                rows = np.flatnonzero(alive[i])
                rows = rows[ids[rows] != query_ids[start + i]]
                score, order = self.exact(rows, q[i], ids[rows], k)
                out.append((np.full(len(order), start + i), rows[order], score[order]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def answer(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    width = max(longest(rows), longest(queries))
    ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    index = ImpactIndex(vectors_of(rows, width))
    q, r, score = index.best(ids, vectors_of(queries, width), query_ids, k)
    key = queries.column("key").to_numpy()
    return pa.table({"query_key": key[q], "query_id": query_ids[q], "vec_id": ids[r], "score": score})


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the best k of each query; queries are rows whose vec_id is divisible by ``every``."""
    small, wide = integers(F.col("embedding"))
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), small.alias("v"), wide.alias("wide")).where("vec_id is not null and (v is not null or wide is not null)")
    total = max(vectors.count(), 1)
    blocks, query_blocks = -(-total // min(BLOCK, max(LEAST, -(-total // BLOCKS)))), -(-total // (QUERIES * every))
    # copies of a row are dealt to blocks like others
    rows = ready.select("vec_id", "v", "wide", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("y"))
    asked = ready.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v", "wide"]).withColumn("key", F.xxhash64("vec_id", "v", "wide"))
    queries = asked.select("vec_id", "v", "wide", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("x"), F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(query_blocks)).cast("int").alias("y"))
    found = queries.groupBy("x", "y").cogroup(rows.groupBy("x", "y")).applyInArrow(lambda q, r: answer(r, q, k), RESULT)
    line = Window.partitionBy("query_key", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
