"""Token counts with a whole-token shortcut, for a piece vocabulary with byte fallback.

A space (written U+2581 in pieces) never follows another character inside a vocabulary piece, so no merge
crosses the border before a run of spaces, and a text falls into pre-tokens: a run of spaces with what follows.
Offline, once per process, each vocabulary string is merged on its own; those that come out as one token are the
proven whole tokens. A pre-token among them counts one; only the rest is merged, and its count is kept in a
bounded cache. A character outside the vocabulary counts its bytes.

Counting is a map over Arrow batches: no shuffle, memory bounded by a batch and the cache.

Defined cases: a null text is the empty text, with no tokens; a text of spaces counts their runs' tokens; texts
of any length are counted whole; an empty table gives an empty result; repeated rows count alike.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm.common import sparing
from cytoframe.llm.settings import tokenizer_path

MARK = "▁"
CACHE = 300_000
#: Tokens beyond which a text is over the limit.
LIMIT = 4096
RUNS = re.compile(f"{MARK}+[^{MARK}]*")
ODD = re.compile(f"  |^ | $|{MARK}")


class PieceCounter:
    """Counts tokens of texts under a piece model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space after another character: texts don't fall into pre-tokens there")
        self.whole = {p for p in self.score if self.merged(p) == 1}
        #: Of pre-tokens without their leading mark: whole tokens count one.
        self.known = {p[1:]: 1 for p in self.whole if p.startswith(MARK)}
        self.proven = len(self.known)

    def merged(self, piece: str) -> int:
        """Number of tokens of a pre-token, by merging the best-scored pair, the left one of equals, until none is left."""
        score, parts = self.score, list(piece)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                found = score.get(parts[i] + parts[j])
                if found is not None:
                    heapq.heappush(heap, (-found, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if right[i] != j or not parts[i] or not parts[j] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return sum(1 if p in score else len(p.encode()) for p in parts if p)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if ODD.search(text):
            words = [p[1:] for p in RUNS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        known = self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            total = 0
            for w in words:
                c = known.get(w)
                if c is None:
                    c = self.merged(MARK + w)
                    if len(w) < 64:
                        if len(known) > self.proven + CACHE:
                            self.known = known = {p[1:]: 1 for p in self.whole if p.startswith(MARK)}
                        known[w] = c
                total += c
            return total


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each document."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            n = [pieces.count(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(sparing(run), schema)
