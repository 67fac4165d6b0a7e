"""Algebra of hyperdimensional bit vectors held as arrays of whole words, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 32  # the upper half of each long stays clear, so that values read the same in every engine


def _total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), -(-dim // WORD_BITS))


def ones(dim: int) -> Column:
    full, rest = divmod(dim, WORD_BITS)
    words = [(1 << WORD_BITS) - 1] * full + ([(1 << rest) - 1] if rest else [])
    return F.array(*(F.lit(w).cast("long") for w in words))


def random_vector(key: Column, dim: int) -> Column:
    """A vector that depends on ``key`` alone, from md5 blocks of 32 bits."""
    n = -(-dim // WORD_BITS)
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), b.cast("string"))), 1, 8), 16, 10).cast("long"))
    rest = dim % WORD_BITS
    if rest:
        words = F.transform(words, lambda w, i: F.when(i == n - 1, w.bitwiseAND((1 << rest) - 1)).otherwise(w))
    return words


def get_bit(v: Column, i: Column) -> Column:
    """Bit ``i``; null outside of the vector."""
    return F.getbit(F.get(v, F.floor(i / WORD_BITS).cast("int")), (i % WORD_BITS).cast("int"))


def flip_bit(v: Column, i: int) -> Column:
    return F.transform(v, lambda w, k: F.when(k == i // WORD_BITS, w.bitwiseXOR(F.lit(1 << (i % WORD_BITS)).cast("long"))).otherwise(w))


def set_bit(v: Column, i: int, on: bool) -> Column:
    mask = F.lit(1 << (i % WORD_BITS)).cast("long")
    return F.transform(v, lambda w, k: F.when(k == i // WORD_BITS, w.bitwiseOR(mask) if on else w.bitwiseAND(F.bitwise_not(mask))).otherwise(w))


def count_ones(v: Column) -> Column:
    return _total(v)


def bind(a: Column, b: Column) -> Column:
    """XOR; its own inverse, so it also unbinds."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def hamming(a: Column, b: Column) -> Column:
    return _total(bind(a, b))


def similarity(a: Column, b: Column, dim: int) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(dim)


def shared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def jaccard(a: Column, b: Column) -> Column:
    either = _total(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, F.lit(0.0)).otherwise(shared(a, b) / either)


def normalized_dot(a: Column, b: Column) -> Column:
    product = count_ones(a) * count_ones(b)
    return F.when(product == 0, F.lit(0.0)).otherwise(shared(a, b) / F.sqrt(product))


def bits_of(v: Column) -> Column:
    """Positions of the set bits."""
    return F.flatten(F.transform(v, lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.getbit(w, i) == 1), lambda i: i + k * WORD_BITS)))


def words_of(positions: Column, dim: int) -> Column:
    """The vector with these bits set."""
    n = -(-dim // WORD_BITS)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.filter(positions, lambda j: F.floor(j / WORD_BITS) == k), F.lit(0).cast("long"), lambda s, j: s.bitwiseOR(F.pow(F.lit(2.0), j % WORD_BITS).cast("long"))))


def rotate(v: Column, places: int, dim: int) -> Column:
    """Bit i moves to (i + places) mod dim."""
    return words_of(F.transform(bits_of(v), lambda j: F.pmod(j + places, F.lit(dim))), dim)


def pack_bytes(v: Column) -> Column:
    """The vector as bytes, least significant bit and byte first."""
    swapped = F.transform(v, lambda w: F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(w, 8 * k).bitwiseAND(255)), 2, "0") for k in range(WORD_BITS // 8))))
    return F.unhex(F.array_join(swapped, ""))


def unpack_bytes(b: Column, dim: int) -> Column:
    """A vector from bytes; short input is padded with zeros, long input cut."""
    n, rest = -(-dim // WORD_BITS), dim % WORD_BITS
    h = F.rpad(F.hex(b), 2 * n * (WORD_BITS // 8), "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.conv(F.concat(*(F.substring(h, k * 8 + 1 + 2 * j, F.lit(2)) for j in range(3, -1, -1))), 16, 10).cast("long"))
    return F.transform(words, lambda w, i: F.when(i == n - 1, w.bitwiseAND((1 << rest) - 1)).otherwise(w)) if rest else words


def display(v: Column, dim: int) -> Column:
    """How a vector is shown: its width and its share of ones, cut to whole percent."""
    share = (count_ones(v) / dim).cast("float") * F.lit(100).cast("float")
    return F.format_string(f"HyperVector[{dim}D, %d%% ones]", share.cast("int"))
