"""Vectors and packed bits as column expressions, and the seeded matrices that encoders share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def negative_squared_l2(a: Column, b: Column) -> Column:
    return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def finite(a: Column, width: int | None = None) -> Column:
    """Whether all components are finite (and there are ``width`` of them); false for null."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(a) > 0)
    return F.coalesce(fine & (F.size(a) == width) if width else fine, F.lit(False))


def sign_bits(a: Column, threshold: float = 0.0) -> Column:
    """1 where a component exceeds the threshold, else 0."""
    return F.transform(a, lambda x: (x > threshold).cast("long"))


def pack(bits: Column, count: int) -> Column:
    """Words of 64 bits, bit i of the signature being bit i % 64 of word i / 64, as two's complement."""
    words = [F.aggregate(F.transform(F.slice(bits, w * 64 + 1, 64), lambda b, i: F.when(b == 1, F.expr("1L")).otherwise(F.expr("0L")) * F.element_at(F.array(*[F.lit(_signed(1 << k)) for k in range(64)]), (i + 1).cast("int"))), F.expr("0L"), lambda s, v: s.bitwiseOR(v)) for w in range((count + 63) // 64)]
    return F.array(*words)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hamming(a: Column, b: Column, words: int) -> Column:
    """Differing bits; unrolled over the words, so that it compiles into one expression."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for w in range(1, words):
        total = total + F.bit_count(a[w].bitwiseXOR(b[w]))
    return total


def mix64(v: np.ndarray) -> np.ndarray:
    """The splitmix finalizer on unsigned 64-bit integers, wrapping around."""
    v = np.asarray(v, np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def hyperplanes(bits: int, width: int, seed: int) -> np.ndarray:
    """A matrix of +1 and -1 that depends on the seed alone."""
    with np.errstate(over="ignore"):
        rows = mix64(np.uint64(seed) ^ (np.arange(bits, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        cells = mix64(rows[:, None] ^ (np.arange(width, dtype=np.uint64)[None, :] + np.uint64(0xBF58476D1CE4E5B9)))
    return np.where(cells & np.uint64(1), 1.0, -1.0)


def hadamard_rows(bits: int, width: int, seed: int) -> np.ndarray:
    """Rows of randomly signed Walsh-Hadamard blocks, as a plain matrix."""
    size = 1 << max(0, (width - 1).bit_length())
    walsh = np.array([[1.0]])
    while len(walsh) < size:
        walsh = np.block([[walsh, walsh], [walsh, -walsh]])
    out = []
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        for k in range((bits + size - 1) // size):
            block = np.uint64(k)
            h = mix64(seed ^ np.uint64(0x6A09E667F3BCC909) ^ (block + np.uint64(0x9E3779B97F4A7C15)))
            signs = np.where(mix64(h ^ (np.arange(width, dtype=np.uint64) + np.uint64(0xBF58476D1CE4E5B9))) & np.uint64(1), 1.0, -1.0)
            first = int(mix64(seed ^ np.uint64(0x3C6EF372FE94F82B) ^ (block + np.uint64(0x94D049BB133111EB)))) & (size - 1)
            step = (int(mix64(seed ^ np.uint64(0xBB67AE8584CAA73B) ^ (block + np.uint64(0x2545F4914F6CDD1D)))) & (size - 1)) | 1
            for w in range(min(size, bits - k * size)):
                out.append(walsh[(first + w * step) & (size - 1), :width] * signs)
    return np.array(out)
