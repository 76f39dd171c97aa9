"""Bloom filters as tables of set bits, and the study of their false positives.

Keys are hashed in Arrow batches.  A filter of up to ``MOST_LOG_BITS`` is at most two megabytes, so it goes to every task
and keys are looked up where they are read; larger ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import col, spread
from ..functions.murmur import murmur2_32_spans

#: Filters beyond so many bits, as a power of two, aren't sent to every task.
MOST_LOG_BITS = 24


def _hashes(texts: pa.Array, k: int) -> np.ndarray:
    """The k hashes of each text, none of them null, by row; the i-th has seed i squared."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(texts), k), np.uint32)
    for i in range(k if len(texts) else 0):
        out[:, i] = murmur2_32_spans(data, ends[:-1], np.diff(ends), i * i)
    return out


def distinct_keys(keys: DataFrame, key: str) -> DataFrame:
    """The different keys that aren't null, as strings."""
    return keys.select(col(key).cast("string").alias(key)).filter(col(key).isNotNull()).distinct()


def key_bits(keys: DataFrame, key: str, log_bits: int, k: int) -> DataFrame:
    """``key``, ``i`` and ``bit`` of the k bits of each different key that isn't null: the low bits of its hashes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _hashes(b.column(0), k).astype(np.int64) & ((1 << log_bits) - 1)
            place, i = np.repeat(np.arange(b.num_rows), k), np.tile(np.arange(k, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place)), pa.array(i), pa.array(bits.ravel())], names=[key, "i", "bit"])

    return distinct_keys(keys, key).mapInArrow(kernel, f"`{key}` string, i int, bit bigint")


def build(keys: DataFrame, key: str, log_bits: int, k: int) -> DataFrame:
    """The filter: its set bits.  Keys needn't be told apart first: each task gives the bits that its keys set, once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.unique(_hashes(b.column(0), k) & np.uint32((1 << log_bits) - 1)))
            if sum(map(len, held)) > 1 << 22:
                held = [np.unique(np.concatenate(held))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).astype(np.int64))], names=["bit"])

    some = spread(keys.select(col(key).cast("string").alias("key")).filter("key is not null"))
    return some.mapInArrow(kernel, "bit bigint").distinct()


def bitmap(filter_bits: DataFrame, log_bits: int) -> np.ndarray:
    """The filter as an array of 64-bit words, packed before it comes to the driver."""
    word = filter_bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(max(1, 1 << log_bits >> 6), np.uint64)
    out[word.column("w").to_numpy()] = word.column("v").to_numpy().view(np.uint64)
    return out


def probe(filter_bits: DataFrame, keys: DataFrame, key: str, log_bits: int, k: int) -> DataFrame:
    """The different keys all of whose bits are set: all members, and some others."""
    if log_bits > MOST_LOG_BITS:
        hit = key_bits(keys, key, log_bits, k).join(filter_bits, "bit")
        return hit.groupBy(key).agg(F.count(F.lit(1)).alias("_set")).filter(F.col("_set") == k).select(key)
    words = bitmap(filter_bits, log_bits)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _hashes(b.column(0), k) & np.uint32((1 << log_bits) - 1)
            found = (words[bits >> np.uint32(6)] >> (bits & np.uint32(63)).astype(np.uint64) & np.uint64(1)).all(axis=1)
            yield b.filter(pa.array(found))

    return distinct_keys(keys, key).mapInArrow(kernel, f"`{key}` string")


def fitting_log_bits(members: DataFrame, key: str, bits_per_key: int = 4) -> int:
    """The size of a filter, as a power of two, that has ``bits_per_key`` bits or up to twice as many for each different key."""
    n = members.agg(F.count_distinct(col(key))).first()[0]
    return max(6, (bits_per_key * n - 1).bit_length())


def others(keys: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """The different keys that are no members."""
    k = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    return k.join(members.select(F.col(member).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def sweep(members: DataFrame, member: str, probes: DataFrame, key: str, log_bits: range, most: int) -> DataFrame:
    """False positives for every size and number of hashes up to ``most``: ``b``, ``k``, ``probes``, ``positives``.

    A bit is set in the filter with k hashes if the first hash that sets it is below k, so the first hash by bit of the
    largest filter serves all k; the smaller sizes have its low bits, so it serves them too.  Tasks give counts only.
    """
    top = max(log_bits)
    if top > MOST_LOG_BITS:
        raise ValueError(f"sizes go up to {MOST_LOG_BITS}")

    def first_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.full(1 << top, most, np.uint8)
        for b in batches:
            bits = _hashes(b.column(0), most) & np.uint32((1 << top) - 1)
            for i in reversed(range(most)):
                first[bits[:, i]] = np.minimum(first[bits[:, i]], i)
        at = np.flatnonzero(first < most)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(first[at].astype(np.int32))], names=["bit", "first"])

    some = spread(members.select(col(member).cast("string").alias("key")).filter("key is not null"))
    found = some.mapInArrow(first_hash, "bit bigint, first int").groupBy("bit").agg(F.min("first").alias("first")).toArrow()
    table = np.full(1 << top, most, np.uint8)
    table[found.column("bit").to_numpy()] = found.column("first").to_numpy()
    tables = {b: table.reshape(-1, 1 << b).min(axis=0) for b in log_bits}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = 0, np.zeros((len(log_bits), most), np.int64)
        for b in batches:
            h = _hashes(b.column(0), most)
            n += b.num_rows
            for j, size in enumerate(log_bits):
                # With k hashes a key is taken for a member if each of its first k bits was first set by one of the first k.
                latest = np.maximum.accumulate(tables[size][h & np.uint32((1 << size) - 1)], axis=1)
                positive[j] += (latest < np.arange(1, most + 1)).sum(axis=0)
        size, k = np.repeat(np.array(log_bits, np.int32), most), np.tile(np.arange(1, most + 1, dtype=np.int32), len(log_bits))
        yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(k), pa.array(np.full(len(k), n, np.int64)), pa.array(positive.ravel())], names=["b", "k", "probes", "positives"])

    counted = distinct_keys(probes, key).mapInArrow(count, "b int, k int, probes bigint, positives bigint")
    return counted.groupBy("b", "k").agg(F.sum("probes").alias("probes"), F.sum("positives").alias("positives")).filter("probes > 0")


def theoretical_rate(m: Column, k: Column, n: Column) -> Column:
    """The expected false-positive rate of m bits, k hashes and n members."""
    one = F.lit(1.0)
    return F.pow(one - F.pow(one - one / m, (k * n).cast("double")), k.cast("double"))
