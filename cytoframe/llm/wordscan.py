"""Words of texts as 64-bit hashes, computed with numpy over the bytes of Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes scanned at a time, but for a longer text.
CHUNK = 1 << 18
_rng = np.random.default_rng(20240501)
#: A random number for each byte, and odd factors by a byte's place in its word.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + _rng.integers(0, 2, 256, dtype=U)
_PLACE = _rng.integers(0, 1 << 63, 1 << 12, dtype=U) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a run of texts: where each text's words begin in the arrays, word hashes, and bytes with word starts."""

    first: np.ndarray  # of each text, and the end: index of its first word
    hashes: np.ndarray
    data: np.ndarray  # the bytes of all texts
    text_at: np.ndarray  # of each text, and the end: its first byte
    starts: np.ndarray  # of each word: its first byte
    ends: np.ndarray


def scan(data: np.ndarray, text_at: np.ndarray, lower: bool) -> Words:
    space = IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    inner = text_at[1:-1]
    edge = inner[inner < len(data)]
    before[edge] = True  # a text's first byte begins a word even if the text before doesn't end in a space
    starts = np.flatnonzero(before & ~space)
    # a word ends at the next space, or the next text's first byte
    stop = space.copy()
    stop[edge] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    if len(starts):
        values = _BYTE[LOWER[data] if lower else data]
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))), axis=0) if starts[0] == 0 else None
        if place is None:
            place = np.arange(len(data))
            place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        long = place >= len(_PLACE)
        factor = _PLACE[place % len(_PLACE)]
        if long.any():
            factor = np.where(long, mixed(place.astype(U)) | U(1), factor)
        values = values * factor
        values[space] = 0
        hashes = mixed(np.add.reduceat(values, starts))
    else:
        hashes = np.zeros(0, U)
    return Words(np.searchsorted(starts, text_at), hashes, data, text_at, starts, ends)


def runs(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) of consecutive texts, about CHUNK bytes at a time. Null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        yield i, scan(data[at[i] : at[j]], at[i : j + 1] - at[i], lower)
        i = j


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text; with fewer words, of the whole sequence as one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U)
    if n < width:
        out = U(n)
        with np.errstate(over="ignore"):
            for h in hashes:
                out = mixed(np.atleast_1d(out * U(0x9E3779B97F4A7C15) + h))[0]
        return np.array([out], U)
    out = np.zeros(n - width + 1, U)
    for k in range(width):
        out = out * U(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    return mixed(out)
