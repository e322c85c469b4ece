"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Cyclic boosting visits the features in turn, and then pairs of
features, and fits a shallow tree to the residuals of each; its leaves are added to a lookup table of the feature
(or pair). A score is the sum of one table entry for each feature and pair, turned into a probability.

Fitting takes a bounded sample of labelled documents to the driver: the ``sample`` labels of the smallest hashes of doc_id, and for each doc_id
among them one row of documents, that with the smallest hash of features. Nothing else is left out. Features are computed
from whole texts in Arrow batches; scoring is a map without a shuffle; the tables are a few KB.

Defined cases: null and empty texts have features of 0 and get the score of those; a null doc_id is not held out
and never has a label; rows that repeat a doc_id are scored separately; without labels of both kinds the score is
the share of label 1, or a half; an empty table gives an empty result. labels with a null or other quality are not used;
of labels that repeat a doc_id each row counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.llm import wordscan
from cytoframe.llm.common import sparing

FEATURES = (
    "log_words", "mean_word", "symbols", "shouts", "capitals", "stutter", "repeats", "dup_lines", "digits", "points",
    "commas", "bars", "not_ascii", "line_words", "distinct_words", "short_words", "long_words", "symbol_words",
)
#: Labelled rows that the fit takes at most.
SAMPLE = 30_000
THRESHOLD = 0.3
BINS, ROUNDS, RATE, DEPTH, PAIRS = 32, 60, 0.15, 3, 8
CLASSES = {
    "symbols": b"#*$%&|<>", "shouts": b"!", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)),
    "points": b".", "commas": b",", "bars": b"|", "not_ascii": bytes(range(0xC0, 0x100)), "lines": b"\n",
}
_CLASS = np.zeros((len(CLASSES), 256), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[_k, list(_bytes)] = 1


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive places of ``first``."""
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[first[1:]] - upto[first[:-1]]


def features_of(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, w in wordscan.runs(texts):
        n = len(w.text_at) - 1
        words = np.diff(w.first).astype(float)
        some, size = np.maximum(words, 1), w.ends - w.starts
        letters = np.maximum(per_text(size, w.first), 1)
        count = {name: per_text(_CLASS[k][w.data], w.text_at) for k, name in enumerate(CLASSES)}
        text_of = np.repeat(np.arange(n), np.diff(w.first))
        same = np.zeros(len(w.hashes), bool)
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text_of[1:] == text_of[:-1])
        order = np.lexsort((w.hashes, text_of))
        new = np.ones(len(order), bool)
        new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
        distinct = np.bincount(text_of[order][new], minlength=n)
        has_symbol = np.zeros(len(w.starts), bool)
        if len(w.starts):
            has_symbol = np.add.reduceat(_CLASS[0][w.data], w.starts) > 0
        rows = [
            np.log1p(words), letters / some, count["symbols"] / some, count["shouts"] / some, count["capitals"] / letters,
            per_text(same, w.first) / some, repeated(w, 8) / some, dup_lines(w), count["digits"] / letters, count["points"] / some,
            count["commas"] / some, count["bars"] / some, count["not_ascii"] / letters, np.log1p(words / (count["lines"] + 1)), distinct / some,
            per_text(size <= 2, w.first) / some, per_text(size >= 14, w.first) / some, per_text(has_symbol, w.first) / some,
        ]
        out[i : i + n] = np.stack(rows, 1)
    return out


def repeated(w: wordscan.Words, width: int) -> np.ndarray:
    """Of each text: number of runs of ``width`` words that occur earlier in it."""
    out = np.zeros(len(w.first) - 1)
    for t in range(len(out)):
        h = w.hashes[w.first[t] : w.first[t + 1]]
        if len(h) > width:
            s = wordscan.shingles(h, width)
            out[t] = len(s) - len(np.unique(s))
    return out


def dup_lines(w: wordscan.Words) -> np.ndarray:
    """Of each text: share of its lines with a word that equal an earlier one, by their words."""
    out = np.zeros(len(w.first) - 1)
    breaks = np.flatnonzero(w.data == 10)
    edges = np.unique(np.concatenate([np.searchsorted(w.starts, breaks), w.first]))
    edges = edges[edges < len(w.starts)]
    if not len(edges):
        return out
    place = np.arange(len(w.starts)) - np.repeat(edges, np.diff(np.append(edges, len(w.starts))))
    line = np.add.reduceat(wordscan.mixed(w.hashes + place.astype(wordscan.U) * wordscan.U(0x9E3779B97F4A7C15)), edges)
    text_of = np.searchsorted(w.first, edges, side="right") - 1
    order = np.lexsort((line, text_of))
    same = (line[order][1:] == line[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    n, dup = np.bincount(text_of, minlength=len(out)), np.bincount(text_of[order][1:][same], minlength=len(out))
    return dup / np.maximum(n, 1)


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features."""

    edges: list[np.ndarray]
    bias: float
    single: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def logit(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.bias)
        for j in range(b.shape[1]):
            out += self.single[j][b[:, j]]
        for (j, k), table in zip(self.pairs, self.tables, strict=True):
            out += table[b[:, j], b[:, k]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.binned(x)), -30, 30)))


def leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float = 1.0) -> np.ndarray:
    """A tree of that depth over the ordered bins of one axis, from sums of gradients and weights by bin: the leaf value of each bin."""
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + least) + (g.sum() - cg) ** 2 / (h.sum() - ch + least)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + least) + 1e-9:
            return np.concatenate([leaves(g[:at], h[:at], depth - 1), leaves(g[at:], h[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + least))


def pair_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two axes: the best split of the first, and of the second on either side; with its gain."""
    best, found = -1.0, None
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    for a in range(1, len(g)):
        total, cuts = 0.0, []
        for lo in (True, False):
            rg, rh = (cg[a - 1], ch[a - 1]) if lo else (cg[-1] - cg[a - 1], ch[-1] - ch[a - 1])
            gain = rg[:-1] ** 2 / (rh[:-1] + 1) + (rg[-1] - rg[:-1]) ** 2 / (rh[-1] - rh[:-1] + 1)
            b = int(np.argmax(gain))
            total += gain[b]
            cuts.append((b + 1, rg[b] / (rh[b] + 1), (rg[-1] - rg[b]) / (rh[-1] - rh[b] + 1)))
        if total > best:
            best, found = total, (a, cuts)
    out = np.zeros_like(g)
    if found:
        a, ((b, x, y), (c, u, v)) = found
        out[:a, :b], out[:a, b:], out[a:, :c], out[a:, c:] = x, y, u, v
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the features one by one, then of the pairs that explain most of what is left."""
    m = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(m)]
    model = Gam(edges, float(np.log(share / (1 - share))), np.zeros((m, BINS + 1)))
    if not 0 < y.sum() < len(y):
        return model
    b = model.binned(x)
    logit = np.full(len(y), model.bias)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(m):
            g, h = rest()
            step = RATE * leaves(np.bincount(b[:, j], g, BINS + 1), np.bincount(b[:, j], h, BINS + 1), DEPTH)
            model.single[j] += step
            logit += step[b[:, j]]
    g, h = rest()
    both = lambda j, k, v: np.bincount(b[:, j] * (BINS + 1) + b[:, k], v, (BINS + 1) ** 2).reshape(BINS + 1, BINS + 1)
    gains = sorted(((pair_leaves(both(j, k, g), both(j, k, h))[1], j, k) for j in range(m) for k in range(j)), reverse=True)
    model.pairs = [(j, k) for _, j, k in gains[:PAIRS]]
    model.tables = [np.zeros((BINS + 1, BINS + 1)) for _ in model.pairs]
    for _ in range(ROUNDS // 2):
        for (j, k), table in zip(model.pairs, model.tables, strict=True):
            g, h = rest()
            step = RATE * pair_leaves(both(j, k, g), both(j, k, h))[0]
            table += step
            logit += step[b[:, j], b[:, k]]
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fit to labelled documents that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("quality").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # a bounded sample, taken by hash so that it doesn't follow any order
    known = known.groupBy("doc_id").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    names = [f"f{j}" for j in range(len(FEATURES))]
    schema = known.schema
    for name in names:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features_of(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, x.T)], names=schema.names)

    every = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "n0", "n1", "text").mapInArrow(sparing(run), schema)
    one = every.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*names).alias("h"), "n0", "n1", *names)).alias("x"))
    rows = one.select("x.n0", "x.n1", *[f"x.{name}" for name in names]).toPandas()  # ``sample`` rows at most
    rows = rows.sort_values([*names, "n0", "n1"]).to_numpy(dtype=float)  # the fit doesn't depend on the order of tasks
    x = np.concatenate([np.repeat(rows[:, 2:], rows[:, y].astype(int), axis=0) for y in (0, 1)])
    return fit(x, np.repeat([0.0, 1.0], [int(rows[:, y].sum()) for y in (0, 1)]))


def score_documents(docs: DataFrame, model: Gam, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score of each document."""
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(features_of(batch.column(len(keep)))))], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(sparing(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document."""
    scored = score_documents(docs, train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with their columns; names of other columns cannot clash."""
    model, at = train(docs, labels, sample), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features_of(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(sparing(run), docs.schema)
