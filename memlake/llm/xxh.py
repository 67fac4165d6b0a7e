"""XXH64 of many byte ranges of one buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

_P = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
_LONG = 256


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, lane):
    return _rot(acc + lane * _P[1], 31) * _P[0]


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of ``buf[starts[i]:ends[i]]``; ranges of one length are hashed together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    u32 = np.ndarray(len(buf) + 1, "<u4", padded, strides=(1,))
    lens = ends - starts
    big = lens > _LONG
    for i in np.flatnonzero(big):
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    small = np.flatnonzero(~big)
    order = small[np.argsort(lens[small].astype(np.uint16), kind="stable")]
    sizes = lens[order]
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for part in np.split(order, cuts):
            if not len(part):
                continue
            n, p = int(lens[part[0]]), starts[part]
            if n >= 32:
                acc = [s + _P[0] + _P[1], s + _P[1], s, s - _P[0]]
                acc = [np.full(len(p), a, np.uint64) for a in acc]
                for _ in range(n // 32):
                    for k in range(4):
                        acc[k] = _round(acc[k], u64[p + 8 * k])
                    p = p + 32
                h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
                for k in range(4):
                    h = (h ^ _round(np.uint64(0), acc[k])) * _P[0] + _P[3]
            else:
                h = np.full(len(p), s + _P[4], np.uint64)
            h = h + np.uint64(n)
            rest = n % 32
            while rest >= 8:
                h = _rot(h ^ _round(np.uint64(0), u64[p]), 27) * _P[0] + _P[3]
                p, rest = p + 8, rest - 8
            if rest >= 4:
                h = _rot(h ^ (u32[p].astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2]
                p, rest = p + 4, rest - 4
            for _ in range(rest):
                h = _rot(h ^ (padded[p].astype(np.uint64) * _P[4]), 11) * _P[0]
                p = p + 1
            h = (h ^ (h >> np.uint64(33))) * _P[1]
            h = (h ^ (h >> np.uint64(29))) * _P[2]
            out[part] = h ^ (h >> np.uint64(32))
    return out
