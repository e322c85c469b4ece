"""Byte-level BPE by per-prefix dynamic programming, without running merges.

Of every prefix of a pre-token exactly one vocabulary token can come last in its encoding. An Aho-Corasick
automaton (the suffix automaton of the vocabulary) yields the tokens that end at each byte; the one that fits is
the longest whose start is a prefix end and whose pair with that prefix's own last token is compatible, that
is, no merge across their border would have come first. The stored tokens are back-pointers: from the last byte they
give the exact ids.

A text is cut at special tokens, then at single spaces before a character that is not white space, which no
pre-token crosses; ids of such pieces are kept in a bounded cache, so repeated words cost a lookup.

Encoding is a map over Arrow batches: no shuffle, and memory is bounded by a batch and the two caches.

Defined cases: a null text is the empty text, which has no ids; texts of any length are encoded whole; rows that
repeat are encoded alike; an empty table gives an empty result; null ids of documents pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from cytoframe.llm.common import sparing
from cytoframe.llm.settings import tokenizer_path

#: The pre-token pattern of the byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the caches of pieces of text, of pre-tokens and of pairs of tokens: some 130 MB in all.
CACHE, WORDS, PAIRS = 320_000, 80_000, 300_000
#: Texts handled at once.
SLICE = 1024


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (a, b), (r, whole) in self.rank.items():
            self.parts.setdefault(whole, (a, b, r))
        self.pairs: dict[int, bool] = {}
        self.bytes |= {i: t.encode() for t, i in added.items()}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            if i not in added.values() and self.reachable(i):
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def reachable(self, token: int) -> bool:
        """Whether the token's own string encodes as that token: its halves are, and border merges don't forestall it."""
        if token not in self.parts:
            return self.size[token] == 1
        a, b, r = self.parts[token]
        return self.reachable(a) and self.reachable(b) and self.compatible(a, b, r)

    def spine(self, token: int, right: bool, until: float) -> list[tuple[int, float]]:
        """Tokens that stand at an edge of the token while it is built, with the rank of the merge that ends each."""
        out, end = [(token, until)], until
        while token in self.parts:
            a, b, r = self.parts[token]
            token, end = (b if right else a), r
            out.append((token, end))
        return out

    def compatible(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether the strings of a and b, side by side, encode as a, b at least until that rank.

        A merge across the border happens if both of its parts stand there at its rank. Where ranks are equal the
        left one of two places goes first.
        """
        for x, x_end in self.spine(a, True, until):
            for y, y_end in self.spine(b, False, until):
                found = self.rank.get((x, y))
                if found and found[0] < x_end and (found[0] <= y_end if y_end < until else found[0] < until):
                    return False
        return True

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 24 | b)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 24 | b] = self.compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        last: list[int | None] = [None] * (len(piece) + 1)
        size, fits = self.size, self.fits
        for at, token in self.automaton.iter(piece.decode("latin-1")):
            if last[at + 1] is None:
                start = at + 1 - size[token]
                before = last[start]
                if not start or (before is not None and fits(before, token)):
                    last[at + 1] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a text that holds no special token, as little-endian unsigned 32-bit integers, by pre-token."""
        out = []
        for piece in self.pieces.findall(text):
            ids = self.words.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) < 64:
                    if len(self.words) > WORDS:
                        self.words.clear()
                    self.words[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, special tokens included, as little-endian unsigned 32-bit integers."""
        if not self.cut or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        first, *rest = SPACE_BEFORE.split(text) if DOUBLE.search(text) else text.split(" ")
        known = self.known
        try:
            return self.packed(first) + b"".join([known[c] for c in rest])
        except KeyError:
            return self.packed(first) + b"".join([self.known.get(c) or self.piece_ids(c) for c in rest])

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece after a space that the younger cache lacks. The cache has two generations: when the younger is full it becomes the older,
        and what is met again moves up, so that common pieces stay."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.packed(" " + piece)
        if len(piece) < 64:
            if len(self.known) >= CACHE // 2:
                self.older, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


#: A space that starts a piece, and a sign that not all spaces of a text do.
SPACE_BEFORE, DOUBLE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


@cache
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` and n_tokens, ids_sha256, decoded_sha256 (and ids, an array, if asked for) of each text."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = docs.select(*keep).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *((("ids", ArrayType(IntegerType())),) if with_ids else ())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            n, ids, texts, all_ids = [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                code = bpe.encode(text or "")
                n.append(len(code) // 4)
                ids.append(hashlib.sha256(code).hexdigest())
                texts.append(hashlib.sha256(bpe.decode(code).encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(code, dtype="<u4").astype(np.int32))
            more = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                more.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(sparing(run), schema)
