"""Has a key been seen before?  Scalable Bloom chains instead of all earlier keys.

Keys are spread over shards by hash, so equal keys meet; a shard reads its
records in order and keeps a chain of Bloom filters.  When a layer is full, one
of twice the size and half the error rate is put on top, so the chance that a
new key is taken for an old one stays below a bound that is known at any time.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, cut, shuffle_width
from .arrow import numbers


#: The place of records without one.
LATE = 2**63 - 1


@dataclass(frozen=True)
class ChainParams:
    """``error``: bound of the compounded false-positive rate of a chain, however long it grows."""

    error: float = 1e-6
    first_capacity: int = 4096
    growth: float = 2.0
    tightening: float = 0.5
    fill: float = 0.5  # share of set bits beyond which a layer counts as full


class BloomLayer:
    """A Bloom filter over pairs of 64-bit hashes, with positions by double hashing."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error = capacity, error
        self.k = max(1, math.ceil(math.log2(1 / error)))
        self.m = -(-max(64, math.ceil(capacity * self.k / math.log(2))) // 64) * 64
        self.words = np.zeros(self.m // 64, np.uint64)
        self.keys = self.bits = 0

    def _positions(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        i = np.arange(self.k, dtype=np.uint64)[:, None]
        with np.errstate(over="ignore"):
            return (h[None, :] + i * (g | np.uint64(1))[None, :] + (i * i * i - i) // np.uint64(6)) % np.uint64(self.m)

    def contains(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        p = self._positions(h, g)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        p = np.unique(self._positions(h, g))
        np.bitwise_or.at(self.words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        self.keys += len(h)
        self.bits = int(np.bitwise_count(self.words).sum())


class BloomChain:
    """Layers of growing size and tightening error.  ``bound`` is the compounded chance of a wrong "seen"."""

    def __init__(self, params: ChainParams = ChainParams()):
        self.p, self.layers = params, []

    def _layer(self) -> BloomLayer:
        top = self.layers[-1] if self.layers else None
        if top is None or top.keys >= top.capacity or top.bits > self.p.fill * top.m:
            i = len(self.layers)
            top = BloomLayer(int(self.p.first_capacity * self.p.growth**i), self.p.error * (1 - self.p.tightening) * self.p.tightening**i)
            self.layers.append(top)
        return top

    @property
    def bound(self) -> float:
        return 1 - math.prod(1 - x.error for x in self.layers) if self.layers else 0.0

    @property
    def estimate(self) -> float:
        """The false-positive rate at the present fill."""
        return 1 - math.prod(1 - (x.bits / x.m) ** x.k for x in self.layers) if self.layers else 0.0

    def contains(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(h), bool)
        for x in reversed(self.layers):
            rest = np.flatnonzero(~seen)
            if len(rest):
                seen[rest] = x.contains(h[rest], g[rest])
        return seen

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        """Adds keys that are not in the chain and differ from one another."""
        at = 0
        while at < len(h):
            layer = self._layer()
            n = min(len(h) - at, max(1, layer.capacity - layer.keys), 65536)
            layer.add(h[at : at + n], g[at : at + n])
            at += n

    def see(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """For keys in order: whether each was added before, or occurs earlier in the array; then all are in."""
        order = np.lexsort((g, h))  # stable, so of equal keys the first comes first
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        first = order[new]
        known = self.contains(h[first], g[first])
        # In their own order, so that the layers don't depend on the cut into batches.
        fresh = np.sort(first[~known])
        self.add(h[fresh], g[fresh])
        seen = np.ones(len(h), bool)
        seen[first] = known
        return seen

    def to_bytes(self) -> bytes:
        """The chain as it can be stored; ``from_bytes`` goes on with it."""
        parts = [struct.pack("<i", len(self.layers))]
        for x in self.layers:
            parts += [struct.pack("<qdqq", x.capacity, x.error, x.keys, x.bits), x.words.astype("<u8").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, params: ChainParams) -> BloomChain:
        chain, at = cls(params), 4
        for _ in range(struct.unpack_from("<i", data)[0]):
            capacity, error, keys, bits = struct.unpack_from("<qdqq", data, at)
            layer = BloomLayer(capacity, error)
            at += 32
            layer.words = np.frombuffer(data, "<u8", layer.m // 64, at).astype(np.uint64)
            layer.keys, layer.bits = keys, bits
            at += layer.m // 8
            chain.layers.append(layer)
        return chain


def seen_before(
    df: DataFrame,
    ident: str = "gen_id",
    key: str = "fake_username",
    known: str | None = "real_username",
    params: ChainParams = ChainParams(),
    report: bool = False,
) -> DataFrame:
    """One row per record: its ``ident``, ``seen`` (its key is a value of ``known`` in any record, or the key of one with
    a smaller ``ident``) and ``error_bound``, the chance that a "seen" of that moment is wrong.  A "not seen" never is.

    With ``report`` one row per shard instead: ``shard``, ``layers``, ``keys``, ``bits``, ``share_set``,
    ``error_bound`` and ``error_estimate`` (at the final fill).

    Keys are compared byte for byte.  A null key is never seen and adds nothing; an empty string is a key.  ``ident`` is
    a unique integer; records without one count as later than all.  Repeated rows under a new ``ident`` have been seen.
    An empty table gives no rows; further columns are not looked at.

    Before the shuffle each batch keeps the first record of a key only and decides its later ones by itself, so that a
    key with a large part of all records sends a few of them to its shard.
    """
    lean = _undecided(df, ident, key, known)
    lean = lean.repartition(shuffle_width(df.sparkSession), F.col("_shard")).sortWithinPartitions("_kind", "_id")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = BloomChain(params)
        for b in batches:
            kind, ident_, decided, h, g, _ = (numbers(c) for c in b.columns)
            h, g = h.view(np.uint64), g.view(np.uint64)
            seen = decided == 1
            for which in (0, 1):
                at = np.flatnonzero((kind == which) & (decided == 0))
                if len(at):
                    seen[at] = chain.see(h[at], g[at])
            if not report:
                out = kind == 1
                yield pa.RecordBatch.from_arrays([pa.array(ident_[out]), pa.array(seen[out]), pa.array(np.full(out.sum(), chain.bound))], names=["_id", "seen", "error_bound"])
        if report:
            from pyspark import TaskContext

            ctx = TaskContext.get()
            keys, bits, m = (sum(getattr(x, a) for x in chain.layers) for a in ("keys", "bits", "m"))
            row = [ctx.partitionId() if ctx else 0, len(chain.layers), keys, m, bits / m if m else 0.0, chain.bound, chain.estimate]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=REPORT)

    if report:
        return lean.mapInArrow(chains, "shard int, layers int, keys bigint, bits bigint, share_set double, error_bound double, error_estimate double")
    return lean.mapInArrow(chains, "_id bigint, seen boolean, error_bound double").select(
        F.when(F.col("_id") != LATE, F.col("_id")).alias(ident), "seen", "error_bound"
    )


def _undecided(df: DataFrame, ident: str, key: str, known: str | None) -> DataFrame:
    """Hashes of the keys, known ones (kind 0) and records (1); those that their batch decides are marked."""
    hashes = lambda c: [F.xxhash64(c).alias("_h"), F.xxhash64(F.lit(1), c).alias("_g")]
    late = F.lit(LATE)
    fakes = df.select(F.lit(1).alias("_kind"), F.coalesce(col(ident).cast("bigint"), late).alias("_id"), col(key).isNull().alias("_null"), *hashes(col(key)))
    both = fakes
    if known:
        reals = df.filter(col(known).isNotNull()).select(F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_id"), F.lit(False).alias("_null"), *hashes(col(known)))
        both = reals.unionByName(fakes)

    def first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, ident_, null, h, g = (numbers(c) for c in b.columns)
            order = np.lexsort((ident_, g, h, kind))
            k, x, hh, gg = kind[order], ident_[order], h[order], g[order]
            new = np.ones(len(order), bool)
            new[1:] = (k[1:] != k[:-1]) | (hh[1:] != hh[:-1]) | (gg[1:] != gg[:-1])
            lead = x[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else x
            first = new | (x == lead)  # of records with one ident none is earlier
            decided = np.zeros(len(order), np.int32)
            decided[order] = np.where(first, 0, 1)
            decided[null] = 2
            drop = (kind == 0) & (decided == 1)
            # What is decided goes anywhere; the rest meets its equals.
            shard = np.where(decided == 0, h, ident_)
            out = [kind, ident_, decided, h, g, shard]
            yield pa.RecordBatch.from_arrays([pa.array(c[~drop]) for c in out], names=["_kind", "_id", "_decided", "_h", "_g", "_shard"])

    return both.mapInArrow(first_only, "_kind int, _id bigint, _decided int, _h bigint, _g bigint, _shard bigint")


def seen_in_history(
    df: DataFrame, chains: DataFrame | None, ident: str = "gen_id", key: str = "fake_username", params: ChainParams = ChainParams(), shards: int = 64
) -> tuple[DataFrame, DataFrame]:
    """``seen_before`` for a further batch of records, without any earlier one: their rows, and the chains after them.

    ``chains`` (``shard``, ``chain``) are those that the batch before gave, None at first; kept as a table they are all there
    is of the history.  ``shards`` and ``params`` must stay the same.  Records count as later than all of earlier batches.
    """
    lean = _undecided(df, ident, key, None).withColumn("_s", F.pmod("_shard", F.lit(shards)).cast("int"))
    if chains is None:
        chains = df.sparkSession.createDataFrame([], "shard int, chain binary")
    held = chains.select(F.col("shard").cast("int").alias("_s"), "chain")

    def go_on(shard: tuple, records: pa.Table, history: pa.Table) -> pa.Table:
        kept = history.column("chain").to_pylist()
        chain = BloomChain.from_bytes(kept[0], params) if kept else BloomChain(params)
        records = records.sort_by("_id")
        decided, h, g = (numbers(records.column(c).combine_chunks()) for c in ("_decided", "_h", "_g"))
        seen = decided == 1
        at = np.flatnonzero(decided == 0)
        seen[at] = chain.see(h[at].view(np.uint64), g[at].view(np.uint64))
        n = len(seen)
        return pa.table(
            {
                "_id": pa.concat_arrays([records.column("_id").combine_chunks().cast(pa.int64()), pa.nulls(1, pa.int64())]),
                "seen": pa.array([*seen.tolist(), None], pa.bool_()),
                "error_bound": pa.array(np.full(n + 1, chain.bound)),
                "shard": pa.array(np.full(n + 1, shard[0].as_py(), np.int32)),
                "chain": pa.array([None] * n + [chain.to_bytes()], pa.binary()),
            }
        )

    done = lean.groupBy("_s").cogroup(held.groupBy("_s")).applyInArrow(go_on, "_id bigint, seen boolean, error_bound double, shard int, chain binary")
    done = cut(done)  # rows and chains come from one pass
    rows = done.filter("chain is null").select(F.when(F.col("_id") != LATE, F.col("_id")).alias(ident), "seen", "error_bound")
    return rows, done.filter("chain is not null").select("shard", "chain")


REPORT = ["shard", "layers", "keys", "bits", "share_set", "error_bound", "error_estimate"]
