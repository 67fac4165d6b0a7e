"""Whole texts as NumPy byte buffers: words, hashes and chunks without a Python object per word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so they never cut a UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .xxh import xxh64

CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` with their bytes and ``hi-lo+1`` offsets; a text longer than ``limit`` comes alone. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and ``len(offs)`` bounds: text i has the words ``bounds[i]:bounds[i+1]``."""
    space = _SPACE[buf]
    first = ~space
    last = first.copy()
    if len(buf):
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < len(buf))]
        after = space.copy()
        after[edges - 1] = True  # a text's end separates words as white space does
        first[1:] &= after[:-1]
        before = space
        before[edges] |= False
        last[:-1] &= before[1:]
        cut = edges[~space[edges - 1]]
        last[cut - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


#: Words of up to this many bytes are their own key.
SHORT = 15
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the words, as two halves: the bytes and the length of a word of up to SHORT bytes, so that
    equal keys are equal words; of a longer word two XXH64 with a mark that no short word has."""
    lens = ends - starts
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    u64 = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))
    lo = u64[starts] & _KEEP[np.minimum(lens, 8)]
    hi = np.zeros(len(lens), np.uint64)
    more = np.flatnonzero(lens > 8)
    hi[more] = u64[starts[more] + 8] & _KEEP[np.minimum(lens[more] - 8, 7)]
    hi |= np.minimum(lens, 255).astype(np.uint64) << np.uint64(56)
    big = np.flatnonzero(lens > SHORT)
    if len(big):
        lo[big] = xxh64(buf, starts[big], ends[big], 1)
        hi[big] = xxh64(buf, starts[big], ends[big], 2) | np.uint64(0xFF << 56)
    return lo, hi


def mixed(lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of both halves; different keys may share them."""
    h = (lo ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = (h ^ hi) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def in_groups(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where in it each key begins."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(mixed(lo, hi), kind="stable")
    differs = lambda: np.concatenate([[True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])])
    m, cut = mixed(lo, hi)[order], differs()
    if (cut[1:] & (m[1:] == m[:-1])).any():  # different keys of like mix may lie interleaved
        order = np.lexsort((lo, hi))
        cut = differs()
    return order, np.flatnonzero(cut)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[i] + arange(lengths[i])``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def single_spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words again, each followed by one space, with their new starts and ends."""
    lens = ends - starts
    new_ends = np.cumsum(lens + 1) - 1
    new_starts = new_ends - lens
    out = buf[np.minimum(ranges(starts, lens + 1), max(len(buf) - 1, 0))] if len(starts) else np.zeros(0, np.uint8)
    out[new_ends] = 0x20
    return out, new_starts, new_ends
