"""MurmurHash 2 (public domain), as a column expression and as array kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published algorithm.
M32, R32 = 0x5BD1E995, 24
M64, R64 = 0xC6A4A7935BD1E995, 47


def murmur2_32_many(text: Column, seeds: list[int]) -> Column:
    """The 32-bit hashes of a text's UTF-8 bytes by several seeds: an array of unsigned numbers in bigints; null for null.

    The bytes are read once for all seeds.  Values used twice are bound as variables of higher-order functions, since Spark
    works out a repeated expression inside them each time.  Products stay below 2**63: each factor is cut to 32 bits, and the
    multiplier has 31.
    """
    low = F.lit(0xFFFFFFFF).cast("bigint")
    bind = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    times = lambda v: (v * F.lit(M32).cast("bigint")).bitwiseAND(low)
    shifted = lambda v, n: v.bitwiseXOR(F.shiftrightunsigned(v, n))
    number = lambda parts: F.conv(F.concat(*parts), 16, 10).cast("bigint")

    def of(digits: Column) -> Column:
        size = (F.length(digits) / 2).cast("int")
        byte = lambda at: F.substr(digits, at * 2 + 1, F.lit(2))
        blocks = F.floor(size / 4).cast("int")
        places = F.slice(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), F.lit(1), blocks)
        words = F.transform(places, lambda i: number([byte(i * 4 + j) for j in (3, 2, 1, 0)]))
        words = F.transform(F.transform(words, times), lambda k: times(shifted(k, R32)))
        rest, at = F.pmod(size, F.lit(4)), blocks * 4
        tail = F.when(rest == 1, number([byte(at)])).when(rest == 2, number([byte(at + 1), byte(at)])).when(rest == 3, number([byte(at + 2), byte(at + 1), byte(at)]))
        # What all seeds share: the size, the mixed words, and the bytes behind them (null if there are none).
        return bind(
            F.struct(size.cast("bigint").alias("n"), words.alias("w"), tail.alias("t")),
            lambda x: F.transform(F.array(*[F.lit(s & 0xFFFFFFFF).cast("bigint") for s in seeds]), lambda seed: finish(x, seed)),
        )

    def finish(x: Column, seed: Column) -> Column:
        h = F.aggregate(x["w"], seed.bitwiseXOR(x["n"]), lambda h, k: times(h).bitwiseXOR(k))
        h = bind(h, lambda v: F.when(x["t"].isNull(), v).otherwise(times(v.bitwiseXOR(x["t"]))))
        return bind(bind(h, lambda v: times(shifted(v, 13))), lambda v: shifted(v, 15))

    return F.when(text.isNotNull(), bind(F.hex(F.encode(text, "UTF-8")), of))


def murmur2_32(text: Column, seed: int = 0) -> Column:
    """The 32-bit hash of a text's UTF-8 bytes, as an unsigned number in a bigint; null for null."""
    return F.get(murmur2_32_many(text, [seed]), F.lit(0))


def murmur2_32_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The 32-bit hashes of spans of a byte array, as uint32."""
    out = np.zeros(len(start), np.uint32)
    m = np.uint32(M32)
    with np.errstate(over="ignore"):
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            s = start[at]
            h = np.full(len(at), (seed ^ int(n)) & 0xFFFFFFFF, np.uint32)
            four = int(n) // 4 * 4
            for j in range(0, four, 4):
                k = data[s + j].astype(np.uint32)
                for b in (1, 2, 3):
                    k |= data[s + j + b].astype(np.uint32) << np.uint32(8 * b)
                k *= m
                k ^= k >> np.uint32(R32)
                h = h * m ^ k * m
            for b in reversed(range(int(n) - four)):
                h ^= data[s + four + b].astype(np.uint32) << np.uint32(8 * b)
            if n > four:
                h *= m
            h ^= h >> np.uint32(13)
            h *= m
            out[at] = h ^ (h >> np.uint32(15))
    return out


def murmur2_64_of(data: bytes, seed: int) -> int:
    """The 64-bit hash of some bytes, as a signed number."""
    full = (1 << 64) - 1
    h = (seed & 0xFFFFFFFF) ^ (len(data) * M64 & full)
    whole = len(data) // 8 * 8
    for j in range(0, whole, 8):
        k = int.from_bytes(data[j : j + 8], "little") * M64 & full
        k = (k ^ k >> R64) * M64 & full
        h = (h ^ k) * M64 & full
    if len(data) > whole:
        h = (h ^ int.from_bytes(data[whole:], "little")) * M64 & full
    h = (h ^ h >> R64) * M64 & full
    h ^= h >> R64
    return h - (1 << 64) if h >> 63 else h


def murmur2_64_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit hashes of spans of a byte array, as uint64."""
    out = np.zeros(len(start), np.uint64)
    m, r = np.uint64(M64), np.uint64(R64)
    with np.errstate(over="ignore"):
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            s = start[at]
            h = np.full(len(at), (seed & 0xFFFFFFFF) ^ (int(n) * M64 & (1 << 64) - 1), np.uint64)
            whole = int(n) // 8 * 8
            word = lambda j, width: sum(data[s + j + b].astype(np.uint64) << np.uint64(8 * b) for b in range(width))  # noqa: E731, B023
            for j in range(0, whole, 8):
                k = word(j, 8) * m
                k = (k ^ k >> r) * m
                h = (h ^ k) * m
            if n > whole:
                h = (h ^ word(whole, int(n) - whole)) * m
            h = (h ^ h >> r) * m
            out[at] = h ^ h >> r
    return out


def murmur2_64(text: Column, seed: int = 0) -> Column:
    """The 64-bit hash of a text's UTF-8 bytes as a signed bigint; null for null.

    Spark has no multiplication that wraps at 64 bits, so this one is a vector UDF over Arrow batches.
    """

    @F.pandas_udf(T.LongType())
    def kernel(values: pd.Series) -> pd.Series:
        there = values.notna().to_numpy()
        raw = [v.encode() for v in values[there]]
        size = np.array([len(r) for r in raw], np.int64)
        h = murmur2_64_spans(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, seed)
        out = pd.array(np.zeros(len(values), np.int64), dtype="Int64")
        out[there] = h.view(np.int64)
        out[~there] = pd.NA
        return pd.Series(out)

    return kernel(text)
