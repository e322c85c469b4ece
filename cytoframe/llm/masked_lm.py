"""Masked pseudo-likelihood of documents under a bidirectional window network.

A token is one of the corpus's 1984 most frequent words, if it is met LEAST times, or one of 64 shapes (length, alphabet, end and symbols) for
all other words. The network predicts each token from the two tokens on either side: a table for each place in the window
adds to a hidden layer, tanh, and two softmaxes give the token's group and its place in the group. Tokens are dealt to groups by frequency, so that groups
are met alike. A word that has
only its shape as token has the probability of the shape times the word's share among the words of that shape, from the counts of
all words of the corpus. The score of a document is the sum over all its words of the log-probability of the word given both sides.

The corpus is read three times. Words of all documents are counted, which shuffles one row for each distinct word of a task;
the network's tokens are the bounded top of that, and the whole table, which grows with the corpus, gives the shares. Documents are dealt by hash to shards of about
SHARD words, whose number grows with the corpus; in each the network is trained on every token, from one
common start and in order of the hash, and the parameters of all shards are averaged, weighted by tokens. They are summed as fixed-point integers, FAN shards at a time, so the result depends neither on
how the input is split nor on the order of tasks, and the driver gets one network. The last pass scores; it deals words without a token of their own to buckets by hash, each of which
meets its part of the table of counts, and what a bucket adds to a document comes back in fixed point. The number of buckets grows with
those words, so a bucket stays as large at any input size. A word that the table lacks (with a model of another corpus) counts as met once.

Defined cases: null, empty and blank texts have no tokens, a sum of 0 and no mean; a null doc_id passes through;
rows that repeat are scored alike; an empty table gives an empty result; texts of any length are read whole. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cytoframe.llm import wordscan
from cytoframe.llm.common import settle, spare, sparing

GROUPS, PLACES, SHAPES, HIDDEN, SIDE = 32, 64, 64, 16, 2
TOKENS = GROUPS * PLACES
PAD = TOKENS
FIXED = 1 << 16
#: How often a word with a token of its own is met at least.
LEAST = 20
#: Words of a shard, about; shards whose parameters are summed at a time; parameters of a row.
SHARD, FAN, PART = 3_000_000, 64, 8192
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 20
#: Words of a bucket, about; fixed point of log counts; a word as a bucket gets it, and what it gives back for a text of a run.
BUCKET, FINE = 2_000_000, 1 << 32
WORD, ADDED = np.dtype([("h", "<u8"), ("at", "<u4")]), np.dtype([("at", "<u4"), ("v", "<i8")])
#: Tokens of a training step, and of a scoring step; learning rate at the start.
STEP, SCORED, RATE = 8192, 8192, 2.5
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"0123456789#*$%&|<>@_/=+")] = 1
_LAST = np.zeros(256, bool)
_LAST[list(b".,!?;:")] = True


def shapes(w: wordscan.Words) -> np.ndarray:
    """Shape, below SHAPES, of each word."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    size = w.ends - w.starts
    length = np.searchsorted([2, 4, 6, 8, 10, 13, 17], size, side="right")
    wide = np.add.reduceat((w.data >= 128).astype(np.int64), w.starts) > 0
    odd = np.add.reduceat(_SYMBOL[w.data], w.starts) > 0
    return ((length * 2 + wide) * 2 + _LAST[w.data[w.ends - 1]]) * 2 + odd


@dataclass
class Vocabulary:
    """Hashes of words in ascending order, with their tokens; counts of all tokens; and the tokens of shapes."""

    hashes: np.ndarray
    token: np.ndarray
    counts: np.ndarray
    of_shape: np.ndarray = field(default_factory=lambda: np.arange(TOKENS - SHAPES, TOKENS))

    def tokens(self, w: wordscan.Words) -> np.ndarray:
        out = self.of_shape[shapes(w)]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, w.hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == w.hashes, self.token[at], out)
        return out


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Counts the words of all documents; also gives the table of all counts (h, n, shape)."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, n, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        return h[order][first], np.add.reduceat(n[order], first), shape[order][first]

    def row(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, n, shape = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(shape)], names=["h", "n", "shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, known = [], 0, 0
        for batch in batches:
            for _, w in wordscan.runs(batch.column(0), lower=True):
                if not len(w.hashes):
                    continue
                h, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                parts.append((h, n, shapes(w)[first]))
                size += len(h)
                if size > 2 * known + (1 << 18):
                    parts = [merged(parts)]
                    size = known = len(parts[0][0])
                    if known > COUNTED:
                        yield row(parts)
                        parts, size, known = [], 0, 0
        if parts:
            yield row(parts)

    counts = docs.select("text").mapInArrow(sparing(run), "h long, n long, shape long").groupBy("h").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))
    counts = settle(counts, "lm-words")
    top = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "h").limit(TOKENS - SHAPES).collect()  # a bounded vocabulary
    rare = counts.groupBy("shape").agg(F.sum("n")).collect()  # SHAPES rows
    hashes, met = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.zeros(TOKENS)
    met[: len(top)] = [r["n"] for r in top]
    for s, n in rare:
        met[TOKENS - SHAPES + s] = n
    for r in top:
        met[TOKENS - SHAPES + r["shape"]] -= r["n"]
    # the n-th most frequent goes to group n modulo GROUPS
    rank = np.empty(TOKENS, np.int64)
    rank[np.argsort(-met, kind="stable")] = np.arange(TOKENS)
    token = rank % GROUPS * PLACES + rank // GROUPS
    total = np.empty(TOKENS)
    total[token] = met
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], token[: len(top)][order], total, token[TOKENS - SHAPES :]), counts


class Network:
    """Parameters as one flat array, with views of its parts."""

    SHAPE = {"window": (2 * SIDE, TOKENS + 1, HIDDEN), "hidden": (HIDDEN,), "group": (GROUPS, HIDDEN), "group_bias": (GROUPS,), "place": (GROUPS, PLACES, HIDDEN), "place_bias": (GROUPS, PLACES)}
    SIZE = sum(int(np.prod(s)) for s in SHAPE.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPE.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random tables, and the corpus's shares as biases."""
        net = cls(np.random.default_rng(3).normal(0, 0.05, cls.SIZE).astype(np.float32))
        share = ((counts + 0.5) / (counts + 0.5).sum()).reshape(GROUPS, PLACES)
        net.group_bias[:] = np.log(share.sum(1))
        net.place_bias[:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def forward(self, context: np.ndarray) -> np.ndarray:
        z = self.window[0][context[0]]
        for j in range(1, 2 * SIDE):
            z += self.window[j][context[j]]
        z += self.hidden
        return np.tanh(z, out=z)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def by_group(self, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(group.astype(np.uint16), kind="stable")  # sixteen bits are sorted by counting
        ends = np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS)))
        for g in range(GROUPS):
            if ends[g] < ends[g + 1]:
                yield g, order[ends[g] : ends[g + 1]]

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.forward(context)
        group, place = np.divmod(target, PLACES)
        z = h @ self.group.T + self.group_bias
        rows = np.arange(len(target))
        out = z[rows, group] - np.log(np.exp(z).sum(1))
        for g, at in self.by_group(group):
            z = h[at] @ self.place[g].T + self.place_bias[g]
            out[at] += z[np.arange(len(at)), place[at]] - np.log(np.exp(z).sum(1))
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        h = self.forward(context)
        group, place = np.divmod(target, PLACES)
        n = len(target)
        p = self.softmax(h @ self.group.T + self.group_bias)
        p[np.arange(n), group] -= 1
        dh = p @ self.group
        pace = np.float32(rate / n)
        self.group -= pace * (p.T @ h)
        self.group_bias -= pace * p.sum(0)
        for g, at in self.by_group(group):
            hg = h[at]
            p = self.softmax(hg @ self.place[g].T + self.place_bias[g])
            p[np.arange(len(at)), place[at]] -= 1
            dh[at] += p @ self.place[g]
            # a group meets its share of the tokens only, so its pace is by the root of that share
            own = np.float32(rate / (n * len(at)) ** 0.5)
            self.place[g] -= own * (p.T @ hg)
            self.place_bias[g] -= own * p.sum(0)
        dh *= 1 - h * h
        self.hidden -= pace * dh.sum(0)
        dh *= -pace * 20  # rows of the tables are met rarely
        for j in range(2 * SIDE):
            order = np.argsort(context[j].astype(np.uint16), kind="stable")
            key = context[j][order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.window[j][key[first]] += np.clip(np.add.reduceat(dh[order], first, axis=0), -0.1, 0.1)


def windows(w: wordscan.Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens around each token (a row for each place in the window), and the tokens; windows don't leave a text."""
    token = vocabulary.tokens(w)
    n = len(w.first) - 1
    text_of = np.repeat(np.arange(n), np.diff(w.first))
    padded = np.full(len(token) + SIDE * (n + 1), PAD)
    at = np.arange(len(token)) + SIDE * (text_of + 1)
    padded[at] = token
    return np.stack([padded[at + d] for d in [*range(-SIDE, 0), *range(1, SIDE + 1)]]), token


def train(docs: DataFrame, words: Vocabulary, keys: tuple[str, ...] = ()) -> Network:
    """One pass over all tokens of the corpus: each shard from the common start, then the weighted mean. Rows are dealt to shards by ``keys`` and text."""
    shards = max(1, -(-int(words.counts.sum()) // SHARD))
    h = F.xxhash64(*keys, "text")
    rows = docs.where(F.length("text") > 0).select(F.pmod(F.xxhash64(F.lit(3), h), F.lit(shards)).alias("shard"), h.alias("h"), "text")
    schema = "shard long, part int, v binary, w long"
    names = ["shard", "part", "v", "w"]

    def packed(shard: int, values: np.ndarray, weight: int, parts: list[int]) -> pa.Table:
        return pa.table({"shard": pa.array([shard] * len(parts), pa.int64()), "part": pa.array(parts, pa.int32()), "v": pa.array([x.tobytes() for x in values], pa.binary()), "w": pa.array([weight] * len(parts), pa.int64())})

    def learn(table: pa.Table) -> pa.Table:
        net, seen = Network.start(words.counts), 0
        for _, w in wordscan.runs(table.sort_by("h").column("text").combine_chunks(), lower=True):
            context, token = windows(w, words)
            for i in range(0, len(token), STEP):
                net.step(context[:, i : i + STEP], token[i : i + STEP], RATE / (1 + seen / 2e6) ** 0.5)
                seen += len(token[i : i + STEP])
        weight = -(-seen // 1024)
        fixed = np.rint(np.clip(net.flat, -1000, 1000).astype(float) * FIXED).astype(np.int64) * weight
        starts = range(0, Network.SIZE, PART)
        out = packed(table.column("shard")[0].as_py() // FAN, [fixed[i : i + PART] for i in starts], weight, list(range(len(starts))))
        spare()
        return out.select(names)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("v"))
        weight = sum(table.column("w").to_pylist())
        return packed(table.column("shard")[0].as_py() // FAN, [total], weight, [table.column("part")[0].as_py()]).select(names)

    sums = rows.groupBy("shard").applyInArrow(learn, schema)
    while True:
        sums = sums.groupBy("part", "shard").applyInArrow(add, schema)  # FAN rows a group
        if shards <= FAN:
            break
        shards = -(-shards // FAN)
    net = Network.start(words.counts)
    for r in sums.collect():  # one network
        part = np.frombuffer(r["v"], np.int64)
        if r["w"]:
            net.flat[r["part"] * PART : r["part"] * PART + len(part)] = part / r["w"] / FIXED
    return net


def bytes_of(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the rows up to each end."""
    offsets = np.append(0, ends) * rows.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def read_bytes(values: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows in binary values, and of each row the index of its value."""
    parts = [x or b"" for x in values.to_pylist()]
    return np.frombuffer(b"".join(parts), dtype), np.repeat(np.arange(len(parts)), [len(x) // dtype.itemsize for x in parts])


def add_shares(scored: pa.Table, counts: pa.Table) -> pa.Table:
    """One bucket: rows of documents as they are, and of each run's words the sums of log counts by text."""
    of_doc = scored.filter(pa.compute.greater_equal(scored["_at"], 0))
    words = scored.filter(pa.compute.less(scored["_at"], 0))
    rows, run = read_bytes(words["_bytes"], WORD)
    if not len(rows):
        return of_doc
    h, n = counts["h"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(h)
    h, value = h[order], np.rint(np.log(n[order]) * FINE).astype(np.int64)
    v = np.zeros(len(rows), np.int64)  # a word that the table lacks is met once
    if len(h):
        at = np.minimum(np.searchsorted(h, rows["h"]), len(h) - 1)
        v = np.where(h[at] == rows["h"], value[at], 0)
    key = run.astype(np.int64) << 32 | rows["at"]  # ascending
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out = np.empty(len(first), ADDED)
    out["at"], out["v"] = rows["at"][first], np.add.reduceat(v, first)
    ends = np.searchsorted(run[first], np.arange(words.num_rows), side="right")
    k = words.schema.get_field_index("_bytes")
    return pa.concat_tables([of_doc, words.set_column(k, words.schema.field(k), bytes_of(out, ends))])


def score_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: tuple[Vocabulary, np.ndarray, DataFrame] | None = None) -> DataFrame:
    """``keep`` and n_tokens, log_likelihood and mean_log_likelihood of each document."""
    if model is None:
        words, counts = vocabulary(docs)
        model = words, train(docs, words, keep).flat, counts
    words, flat, counts = model
    kept = docs.select(*keep).schema
    schema = StructType([*kept, *StructType().add("n_tokens", "long").add("log_likelihood", "double").add("mean_log_likelihood", "double")])
    # rows of documents have their place _at in a run of texts; rows with words of a run have -1
    inner = StructType([StructField(f"_k{i}", f.dataType) for i, f in enumerate(kept)]).add("_run", "long").add("_bucket", "long").add("_at", "integer").add("_n", "long").add("_sum", "double").add("_bytes", "binary")
    in_shape = words.counts[words.of_shape]
    buckets = max(1, -(-int(in_shape.sum()) // BUCKET))
    less, is_shape = np.zeros(TOKENS), np.zeros(TOKENS, bool)
    less[words.of_shape] = np.log(np.maximum(in_shape, 1))
    is_shape[words.of_shape] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, number = Network(flat), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, w in wordscan.runs(batch.column(len(keep)), lower=True):
                context, token = windows(w, words)
                log_p = np.concatenate([net.log_p(context[:, k : k + SCORED], token[k : k + SCORED]) for k in range(0, len(token), SCORED)] or [np.zeros(0)])
                upto = np.concatenate([[0.0], np.cumsum(log_p - less[token], dtype=float)])
                n = len(w.first) - 1
                shared = np.flatnonzero(is_shape[token])
                bucket = (w.hashes[shared] >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable") if buckets > 1 << 16 else np.argsort(bucket.astype(np.uint16), kind="stable")
                met, ends = np.unique(bucket, return_counts=True)
                rows = np.empty(len(shared), WORD)
                rows["h"], rows["at"] = w.hashes[shared][order], np.repeat(np.arange(n), np.diff(w.first))[shared][order]
                m = len(met)
                columns = [
                    *[pa.concat_arrays([c.slice(i, n), pa.nulls(m, c.type)]) for c in batch.columns[:-1]],
                    pa.array(np.full(n + m, number)),
                    pa.array(np.append(np.full(n, number % buckets), met)),
                    pa.array(np.append(np.arange(n), np.full(m, -1)).astype(np.int32)),
                    pa.array(np.append(np.diff(w.first), np.zeros(m, np.int64))),
                    pa.array(np.append(upto[w.first[1:]] - upto[w.first[:-1]], np.zeros(m))),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), bytes_of(rows, np.cumsum(ends))]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=inner.names)
                number += 1

    def whole(rows: pa.Table) -> pa.Table:
        of_doc = rows.filter(pa.compute.greater_equal(rows["_at"], 0)).sort_by("_at")
        added, _ = read_bytes(rows["_bytes"], ADDED)
        n, more = of_doc["_n"].to_numpy(), np.zeros(of_doc.num_rows, np.int64)
        np.add.at(more, added["at"], added["v"])
        total = of_doc["_sum"].to_numpy() + more / FINE
        mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), np.nan), mask=n == 0)
        return pa.Table.from_arrays([*of_doc.columns[: len(keep)], pa.array(n), pa.array(total), mean], names=schema.names)

    scored = docs.select(*keep, "text").mapInArrow(sparing(run), inner).groupBy("_bucket")
    # words met once add nothing
    table = counts.where("n > 1").select("h", "n", F.expr(f"shiftrightunsigned(h, 33) % {buckets}L").alias("_bucket")).groupBy("_bucket")
    return scored.cogroup(table).applyInArrow(add_shares, inner).groupBy("_run").applyInArrow(whole, schema)
