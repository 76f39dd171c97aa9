"""Near-duplicate texts: exact Jaccard similarity, or MinHash signatures with banded hashing.

Texts whose shingle sets (or signatures) are equal make a class, and classes are
joined by their smallest id, so copies never meet one another in a join.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, cut, spread
from ..functions.murmur import murmur2_32_spans

#: Fixed value: what a signature holds for a text without shingles.
NOTHING = 2147483647


@dataclass(frozen=True)
class ShingleParams:
    """Shingles of ``k`` characters, hashed to ``slots`` numbers."""

    k: int = 5
    slots: int = 1_000_000
    seed: int = 1234

    def __post_init__(self):
        if self.k < 1 or self.slots < 1:
            raise ValueError("k and slots must be at least 1")


@dataclass(frozen=True)
class LshParams:
    """Signatures of ``hashes`` values in ``bands``; pairs agree in ``threshold`` of them.

    ``domain`` is the number of different hash values, that of the shingles' slots if not given.
    """

    hashes: int = 24
    bands: int = 6
    threshold: float = 0.8
    seed: int = 1234
    domain: int | None = None

    def __post_init__(self):
        if not 0 < self.threshold < 1:
            raise ValueError("the threshold must lie between 0 and 1")
        if self.hashes < 1 or self.bands < 1:
            raise ValueError("hashes and bands must be at least 1")

    @property
    def used_bands(self) -> int:
        """The bands, or the next smaller number that divides the hashes."""
        return next(b for b in range(min(self.bands, self.hashes), 0, -1) if self.hashes % b == 0)

    @property
    def required(self) -> int:
        """Values that must agree; the threshold is of single precision."""
        return math.ceil(single(self.threshold) * self.hashes)


def single(t: float) -> float:
    """A threshold as given on a command line, in single precision."""
    return float(np.float32(t))


#: What the table of ``least_prime`` has besides its rule, and the one entry that stands where the rule gives another.
BESIDE_RULE = (3, 89, 2147483647)
INSTEAD_OF_RULE = {1454120821: 1454120779}


def least_prime(n: int) -> int:
    """The smallest number >= n of a table of primes (``prime_table``); its last one where none is as large."""
    table = prime_table()
    return table[min(bisect.bisect_left(table, n), len(table) - 1)]


def _is_prime(n: int) -> bool:
    if n < 2:
        return False
    for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


@functools.cache
def prime_table() -> list[int]:
    """For each sixteenth of a power of two the largest upper twin prime up to it, and the fixed values beside that rule."""
    found = set()
    for i in range(16, 31 * 16 + 1):
        n = math.floor(2 ** (i / 16))
        while n >= 5 and not (_is_prime(n) and _is_prime(n - 2)):
            n -= 1
        if n >= 5:
            found.add(INSTEAD_OF_RULE.get(n, n))
    return sorted(found.union(BESIDE_RULE))


class Draws:
    """The published 48-bit linear congruential generator with 31-bit draws below a bound."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits31(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> 17

    def below(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return bound * self.bits31() >> 31
        while True:
            v = self.bits31()
            if v - v % bound + bound - 1 < 1 << 31:
                return v % bound


def hash_family(p: LshParams, slots: int) -> tuple[list[tuple[int, int]], int, int]:
    """Pairs (a, b), the prime and the domain of the functions ((a x + b) mod prime) mod domain."""
    domain = p.domain or slots
    draw = Draws(p.seed)
    return [(draw.below(NOTHING), draw.below(NOTHING)) for _ in range(p.hashes)], least_prime(domain), domain


def shingle_ids(texts: list[str | None], p: ShingleParams) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle numbers of each text, ascending, one behind the other, and where each text's begin (one more than texts).

    Shingles are of characters (code points) and hashed as UTF-8; texts shorter than ``k``, empty and null ones have none.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    owner = np.searchsorted(ends, chars, side="right")
    behind = np.r_[chars[1:], len(data)]
    last = np.arange(len(chars)) + p.k - 1
    inside = last < len(chars)
    inside[inside] = owner[last[inside]] == owner[inside]
    start, size = chars[inside], behind[last[inside]] - chars[inside]
    h = murmur2_32_spans(data, start, size, p.seed).astype(np.int64)
    h = np.where(h >= 1 << 31, (1 << 32) - h, h) % p.slots  # the size of the signed hash
    key = np.sort(owner[inside].astype(np.int64) * (1 << 32) + h)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key  # sorting beats the hash table of np.unique here
    return key & 0xFFFFFFFF, np.searchsorted(key, np.arange(len(raw) + 1, dtype=np.int64) << 32)


def _pieces(texts: pa.Array, most: int = 150_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have some hundred thousand bytes together, so that a processor's cache holds them, or are one text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a = 0
    while a < len(size):
        b, total = a, 0
        while b < len(size) and (b == a or total + size[b] <= most):
            total += size[b]
            b += 1
        yield a, b
        a = b


def shingles(df: DataFrame, ident: str = "doc_id", text: str = "text", p: ShingleParams = ShingleParams()) -> DataFrame:
    """``ident`` and ``shingles``, the different shingle numbers of the whole text; an empty list for texts shorter than ``k`` and null."""
    src = spread(df.select(col(ident), col(text).cast("string").alias("t")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in _pieces(b.column(1)):
                ids, ends = shingle_ids(b.column(1).slice(x, y - x).to_pylist(), p)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), lists], names=[ident, "shingles"])

    return src.mapInArrow(kernel, f"`{ident}` {df.schema[ident].dataType.simpleString()}, shingles array<int>")


def least_hashes(ids: np.ndarray, begin: np.ndarray, family: list[tuple[int, int]], prime: int, domain: int) -> np.ndarray:
    """By group of numbers (they begin at ``begin``) the least value of each function ((a x + b) mod prime) mod domain.

    Numbers and prime are small enough, as a rule, for products that floating point holds exactly; then the remainder is a
    multiplication by the inverse, which is right to one prime, and a correction where it isn't.
    """
    out = np.zeros((len(begin), len(family)), np.int64)
    small = len(ids) and (int(ids.max()) + 1) * prime < 1 << 53
    x = ids.astype(np.float64 if small else np.uint64)
    v, q = np.empty_like(x), np.empty_like(x)
    for j, (a, b) in enumerate(family):
        if small:
            np.multiply(x, float(a % prime), out=v)
            v += float(b % prime)
            np.floor(np.multiply(v, 1.0 / prime, out=q), out=q)
            q *= float(prime)
            v -= q
            if v.min() < 0 or v.max() >= prime:
                v += prime * (v < 0.0)
                v -= prime * (v >= prime)
        else:
            v = (x * np.uint64(a) + np.uint64(b)) % np.uint64(prime)
        if prime > domain:
            if prime > 2 * domain:
                v %= v.dtype.type(domain)
            else:
                v -= (v >= domain) * v.dtype.type(domain)
        out[:, j] = np.minimum.reduceat(v, begin)
    return out


def signatures(df: DataFrame, ident: str = "doc_id", text: str = "text", s: ShingleParams = ShingleParams(), p: LshParams = LshParams()) -> DataFrame:
    """``ident`` and ``signature``: the least value of each hash function over the text's shingles; 2147483647 without any."""
    family, prime, domain = hash_family(p, s.slots)
    src = spread(df.select(col(ident), col(text).cast("string").alias("t")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in _pieces(b.column(1)):
                ids, ends = shingle_ids(b.column(1).slice(x, y - x).to_pylist(), s)
                out = np.full((y - x, p.hashes), NOTHING, np.int32)
                some = np.flatnonzero(ends[1:] > ends[:-1])
                if len(some):
                    out[some] = least_hashes(ids, ends[some], family, prime, domain)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, p.hashes, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), lists], names=[ident, "signature"])

    return src.mapInArrow(kernel, f"`{ident}` {df.schema[ident].dataType.simpleString()}, signature array<int>")


def classes(df: DataFrame, value: str, ident: str = "doc_id") -> DataFrame:
    """Rows of equal ``value`` as one: ``class_id`` (the smallest ident), ``value`` and ``members``."""
    return df.filter(col(ident).isNotNull()).groupBy(value).agg(F.min(ident).alias("class_id"), F.count(F.lit(1)).alias("members"))


def membership(df: DataFrame, value: str, ident: str = "doc_id") -> DataFrame:
    """``ident`` and ``class_id`` of every row."""
    return df.join(classes(df, value, ident).select(value, "class_id"), value).select(ident, "class_id")


def bands(sig: DataFrame, p: LshParams) -> DataFrame:
    """One row per class and band: ``band``, ``slice``.  Documents without shingles are in bands like others."""
    rows = p.hashes // p.used_bands
    cut_up = F.array(*[F.struct(F.lit(b).alias("band"), F.slice("signature", b * rows + 1, rows).alias("slice")) for b in range(p.used_bands)])
    return sig.select("class_id", F.explode(cut_up).alias("b")).select("class_id", "b.band", "b.slice")


def meetings(rows: DataFrame, ident: str, key: str, carry: Sequence[str] = (), first: str = "true", pair: str = "id1 < id2", block: int = 2048) -> DataFrame:
    """Rows of equal ``key`` two by two: ``id1``, ``id2`` (of ``ident``) and, for each carried column, ``<c>1`` and ``<c>2``.

    ``pair`` says which two meet, and in which order; rows for which ``first`` doesn't hold are never the first.

    Keys that many rows have are split into blocks of about ``block`` rows, and each pair of blocks is a group of its own, so
    no group has more than two blocks whatever a key's share.  Counts are by a hash of the key: 2**20 of them at most.
    """
    part = F.pmod(F.xxhash64(key), F.lit(1 << 20)).cast("int")
    hot = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("_part", F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    rows = rows.withColumn("_part", part).join(F.broadcast(hot), "_part", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))

    def side(i: int) -> DataFrame:
        named = [F.col(ident).alias(f"id{i}"), *[F.col(c).alias(f"{c}{i}") for c in carry]]
        return (rows.filter(first) if i == 1 else rows).select(F.col(key).alias("_key"), own.alias("_x" if i == 1 else "_y"), *named, every.alias("_y" if i == 1 else "_x"))

    met = side(1).join(side(2), ["_key", "_x", "_y"]).filter(pair)
    return met.select("id1", "id2", *[f"{c}{i}" for c in carry for i in (1, 2)])


def lsh_pairs(sig: DataFrame, p: LshParams = LshParams(), strict: bool = False, ident: str = "doc_id") -> DataFrame:
    """Pairs of classes of equal signatures that agree in a band and in the required number of values: ``id1`` < ``id2``
    (the smallest idents of the classes) and ``similarity``, the share of values that agree.

    Without ``strict`` counting stops at the required number, so every pair has the same similarity.  A class joined with
    itself is no pair: ``membership`` has its members, which are similar by 1.  Classes meet by number and a hash of band and
    slice; signatures are fetched for those that met, and compared whole, so a hash that two slices share makes no pair.
    """
    c = cut(classes(sig, "signature", ident))
    slices = bands(c, p).select("class_id", F.xxhash64("band", "slice").alias("at"))
    met = meetings(slices, "class_id", "at").distinct()
    side = lambda i: c.select(F.col("class_id").alias(f"id{i}"), F.col("signature").alias(f"s{i}"))
    agree = F.size(F.filter(F.zip_with("s1", "s2", lambda x, y: x == y), lambda x: x))
    pairs = met.join(side(1), "id1").join(side(2), "id2").withColumn("agree", agree).filter(F.col("agree") >= p.required)
    # Slices of one hash needn't be equal, so a band must agree indeed.
    rows = p.hashes // p.used_bands
    whole = F.exists(F.sequence(F.lit(0), F.lit(p.used_bands - 1)), lambda i: F.slice("s1", i * rows + 1, rows) == F.slice("s2", i * rows + 1, rows))
    share = F.col("agree") if strict else F.lit(p.required)
    return pairs.filter(whole).select("id1", "id2", (share / p.hashes).alias("similarity"))


def band_sizes(sig: DataFrame, p: LshParams = LshParams(), ident: str = "doc_id") -> DataFrame:
    """How many buckets of each band have how many documents: ``band``, ``documents``, ``buckets``."""
    b = bands(sig.select(F.col(ident).alias("class_id"), "signature"), p)
    return b.groupBy("band", "slice").agg(F.count(F.lit(1)).alias("documents")).groupBy("band", "documents").agg(F.count(F.lit(1)).alias("buckets"))


def average_bucket_size(sig: DataFrame, p: LshParams = LshParams(), buckets: int = 2000, ident: str = "doc_id") -> DataFrame:
    """``average``: the entries of all bands by the buckets that each band has, empty ones included.

    Which bucket an entry is in doesn't matter for it, so nothing is hashed or shuffled.
    """
    entries = bands(sig.select(F.col(ident).alias("class_id"), "signature"), p)
    return entries.agg((F.count(F.lit(1)) / (buckets * p.used_bands)).alias("average"))


#: Elements are ordered by how many sets have one of their hash; the table of these counts has so many entries.
COUNTED = 1 << 20
#: Sets of a class of sizes meet in blocks of about so many elements, which a task holds in memory.
BLOCK = 1 << 25
#: Pairs of a group are compared in shares of about so many.
SHARE = 1 << 20
#: The table of counts moves in so many pieces.
PIECES = 64


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each set, ascending, one behind the other, and the sets' sizes."""
    e, size = sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy()).astype(np.int64)
    inner = np.ones(max(0, len(e) - 1), bool)
    inner[(np.cumsum(size)[:-1] - 1)[: len(inner)]] = False
    if len(e) and (e[1:] <= e[:-1])[inner].any():
        row = np.repeat(np.arange(len(size)), size)
        e = e[np.lexsort((e, row))]
    return e, size


def _keys(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of hash of each set, as rows of 16 bytes."""
    raw, ends = e.astype("<i4").view(np.uint8).data, np.cumsum(size) * 4
    found = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)


def _few(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (ident, sets) of some number of elements together, or of one set."""
    ends, a = b.column(1).offsets.to_numpy().astype(np.int64), 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield b.slice(a, z - a)
        a = z


def _pack(values: np.ndarray) -> bytes:
    """Integers compressed, all first bytes before all second ones."""
    return np.int64(values.nbytes).tobytes() + pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    n, width = int(np.frombuffer(raw, np.int64, 1)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of pieces that begin at ``start``, one behind the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass(frozen=True)
class _Sizes:
    """Classes of sizes: a set above the threshold ``t`` to a larger one has the same class or the one before."""

    t: float

    @property
    def bounds(self) -> np.ndarray:
        """The least size of each class."""
        out, ratio = [1], min(max(1 / max(self.t, 1e-9), 1.1), 1 << 31)
        while out[-1] < 1 << 31:
            out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
        return np.array(out, np.int64)

    def more(self, n: np.ndarray) -> np.ndarray:
        """How many elements a set has besides those at which it must meet: so many more are shared, which chance meetings aren't."""
        return np.floor(n * min(0.05, self.t / 4)).astype(np.int64)

    def front(self, n: np.ndarray) -> np.ndarray:
        """How many of its rarest elements a set of ``n`` has where it meets smaller ones."""
        return np.minimum(n, n - np.ceil(n * self.t - 1e-9).astype(np.int64) + 1 + self.more(n))

    def head(self, n: np.ndarray) -> np.ndarray:
        """... where it meets ones as large or larger."""
        return np.minimum(n, n - np.ceil(n * (2 * self.t / (1 + self.t)) - 1e-9).astype(np.int64) + 1 + self.more(n))

    def needed(self, n1, n2):
        """The least number of elements that two sets above the threshold share."""
        return np.ceil((n1 + n2) * (self.t / (1 + self.t)) - 1e-6)


def _counts(sets: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many sets have an element of each hash (``e`` modulo ``COUNTED``), and the elements of all sets of each class of sizes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(COUNTED, np.int64), np.zeros(len(bounds), np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) % COUNTED, minlength=COUNTED)
            n = np.diff(b.column(0).offsets.to_numpy())
            np.add.at(sizes, np.searchsorted(bounds, n, side="right") - 1, n)
        parts = [_pack(x) for x in (*np.split(total, PIECES), sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = functools.reduce(np.add, (_unpack(x, np.int64) for x in t.column("n").to_pylist()))
        return pa.table({"part": t.column("part")[:1].cast(pa.int32()), "n": pa.array([_pack(n)], pa.binary())})

    kind = "part int, n binary"
    t = sets.select("shingles").mapInArrow(kernel, kind).groupBy("part").applyInArrow(add, kind).toArrow()
    got = dict(zip(t.column("part").to_pylist(), t.column("n").to_pylist()))
    if not got:
        return np.zeros(COUNTED, np.int64), np.zeros(len(bounds), np.int64)
    return np.concatenate([_unpack(got[i], np.int64) for i in range(PIECES)]), _unpack(got[PIECES], np.int64)


def _groups(sizes: _Sizes, blocks: np.ndarray, n: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the groups in which they meet others: first each row's own, then every other block of its class, and of the next one if that has any set near enough."""
    bounds, first = sizes.bounds, np.cumsum(blocks) - blocks
    c = np.searchsorted(bounds, n, side="right") - 1
    mine = first[c] + keys[:, :4].copy().view("<u4").ravel() % blocks[c]
    rows, groups = [np.arange(len(n))], [mine]
    for up in (0, 1):
        meets = np.flatnonzero((n >= bounds[c + up] * (sizes.t - 1e-9)) & (blocks[c + up] > 0))
        k = blocks[c[meets] + up]
        r, g = np.repeat(meets, k), _ragged(first[c[meets] + up], k)
        rows.append(r[g != mine[r]])
        groups.append(g[g != mine[r]])
    return np.concatenate(rows), np.concatenate(groups)


def _fronts(sets: DataFrame, sizes: _Sizes, counts: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """The rarest elements of each set for each group of sets in which it meets others, many sets packed to a row.

    A group is a block of the sets of a class of sizes, which smaller ones look up: all of that class and of the one before.
    An element's number is its hash's place by rarity, then the rest of it, so that numbers ascend as elements become common.
    """
    rank = np.empty(COUNTED, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(COUNTED)
    single_ones = int((counts <= 1).sum())  # no two sets share these

    def pack(n: np.ndarray, keys: np.ndarray, begin: np.ndarray, flat: np.ndarray, below: np.ndarray, group: np.ndarray, row: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        size = np.maximum(0, np.where(own, sizes.front(n[row]), sizes.head(n[row])) - below[row])
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            r, k = row[part], size[part]
            v = flat[_ragged(begin[r] + below[r], k)]
            step = np.diff(v, prepend=np.uint32(0))
            at = (np.cumsum(k) - k)[k > 0]
            step[at] = v[at]
            yield int(group[part[0]]), _pack(np.stack([n[r], k, below[r], own[part]], 1).astype(np.int32).ravel()), keys[r].tobytes(), _pack(step)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list[np.ndarray]] = []
            for b in _few(batch):
                e, n = _flat(b.column(1))
                e = e.astype(np.int64)
                rest = (e >> 20) + 2048
                if len(e) and (rest.min() < 0 or rest.max() > 4095):
                    raise ValueError("elements of sets must be integers of 32 bits")
                order = np.sort(np.repeat(np.arange(len(n)), n) << 32 | rank[e % COUNTED].astype(np.int64) << 12 | rest)
                v, begin = (order & 0xFFFFFFFF).astype(np.uint32), np.cumsum(n) - n
                front = sizes.front(n)
                flat = v[_ragged(begin, front)]
                lone = np.r_[0, np.cumsum(flat >> 12 < single_ones)]
                ends = np.cumsum(front)
                got.append([n, _keys(e, n), front, flat, lone[ends] - lone[ends - front]])
            if not got:
                continue
            n, keys, front, flat, below = (np.concatenate(x) for x in zip(*got))
            row, group = _groups(sizes, blocks, n, keys)
            packed = list(zip(*pack(n, keys, np.cumsum(front) - front, flat, below, group, row, np.arange(len(row)) < len(n))))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(packed, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["group", "sets", "keys", "v"])

    return sets.select("class_id", "shingles").mapInArrow(kernel, "group int, sets binary, keys binary, v binary")


def _near(sizes: _Sizes, packed: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's sets that may be above the threshold, by their keys, in shares: those that share enough of their rarest elements.

    Where the shorter list of rarest elements ends, all that two sets share up to there was counted; the rest of what they
    share is no more than either has behind that place.
    """
    t = sizes.t
    parts = [_unpack(x, np.int32).reshape(-1, 4).astype(np.int64) for x in packed.column("sets").to_pylist()]
    raw = packed.column("keys").to_pylist()
    coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), sum(map(len, parts)), [None, pa.py_buffer(b"".join(raw))]).dictionary_encode().indices.to_numpy()
    once = np.zeros(len(coded), bool)
    once[np.unique(coded, return_index=True)[1]] = True  # copies of a set have one key
    once = np.split(once, np.cumsum([len(x) for x in parts])[:-1])

    def elements(i: int) -> np.ndarray:
        step, k = _unpack(packed.column("v")[i].as_py(), np.uint32).astype(np.int64), parts[i][:, 1]
        total = np.cumsum(step)
        begin = np.cumsum(k) - k
        return (total - np.repeat(np.r_[0, total][begin], k)).astype(np.uint32)

    own = [np.flatnonzero((x[:, 3] == 1) & o) for x, o in zip(parts, once)]
    lists, about, keys = [], [], []
    for i, r in enumerate(own):
        k = parts[i][:, 1]
        lists.append(elements(i)[_ragged((np.cumsum(k) - k)[r], k[r])])
        about.append(parts[i][r])
        keys += [raw[i][16 * x : 16 * x + 16] for x in r.tolist()]
    n2, k2, below2 = np.concatenate(about).T[:3] if about else np.zeros((3, 0), np.int64)
    order = np.argsort(n2, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # sets by size
    flat, begin2 = np.concatenate(lists), np.cumsum(k2) - k2
    post = flat.astype(np.uint64) << np.uint64(32) | np.repeat(place, k2).astype(np.uint64)
    post.sort()
    of = (post >> np.uint64(32)).astype(np.uint32)
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    values, begins = of[begins], np.r_[begins, len(of)]
    del of
    post = (post & np.uint64(0xFFFFFFFF)).astype(np.int64)
    by_size, front2 = n2[order], sizes.front(n2)
    out1, out2, told = [], [], 0
    group = packed.column("group")[0].as_py()

    def pairs() -> pa.RecordBatch:
        same = lambda x: pa.array(np.full(len(out1), x, np.int32))
        return pa.RecordBatch.from_arrays([same(group), same(told // SHARE), pa.array(out1, pa.binary()), pa.array(out2, pa.binary())], names=["group", "share", "k1", "k2"])

    for i, x in enumerate(parts):
        v, k = elements(i), x[:, 1]
        begin = np.cumsum(k) - k
        at = np.searchsorted(values, v)
        found = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == v) if len(values) else np.zeros(len(v), bool)
        head = sizes.head(x[:, 0])
        look = np.minimum(k, np.maximum(0, head - x[:, 2]))
        a, z = np.searchsorted(by_size, x[:, 0]), np.searchsorted(by_size, x[:, 0] / max(t - 1e-9, 1e-12), side="right")
        least = 1 + sizes.more(x[:, 0])
        for r in np.flatnonzero(once[i] & (a < z) & (look > 0)).tolist():
            s = slice(begin[r], begin[r] + look[r])
            p = at[s][found[s]]
            if len(p) < least[r]:
                continue
            shared = np.bincount(np.concatenate([post[f:g] for f, g in zip(begins[p].tolist(), begins[p + 1].tolist())]), minlength=len(order))[a[r] : z[r]]
            hit = np.flatnonzero(shared >= least[r])
            if not len(hit):
                continue
            n1, key = int(x[r, 0]), raw[i][16 * r : 16 * r + 16]
            for y, c in zip(order[a[r] + hit].tolist(), shared[hit].tolist()):
                if n2[y] == n1 and key >= keys[y]:
                    continue
                one, two = v[s], flat[begin2[y] : begin2[y] + k2[y]]
                if one[-1] <= two[-1]:
                    left = min(n1 - head[r], n2[y] - below2[y] - np.searchsorted(two, one[-1], side="right"))
                else:
                    left = min(n2[y] - front2[y], n1 - x[r, 2] - np.searchsorted(one, two[-1], side="right"))
                if c + left >= sizes.needed(n1, n2[y]):
                    out1.append(key)
                    out2.append(keys[y])
            if len(out1) > 50_000:
                yield pairs()
                told += len(out1)
                out1, out2 = [], []
    yield pairs()


def _places(keys: np.ndarray, group: np.ndarray, share: np.ndarray) -> np.ndarray:
    """24 bits of a key (by the first eight bytes) in a share of a group."""
    with np.errstate(over="ignore"):
        h = keys ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + share.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64)


def _wanted(near: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the places where a set is in a pair, and how many shares each group has."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, shares = np.zeros(1 << 24, bool), {}
        for b in batches:
            group, share = (b.column(i).to_numpy() for i in (0, 1))
            for i in (2, 3):
                found[_places(np.frombuffer(b"".join(x[:8] for x in b.column(i).to_pylist()), "<u8"), group, share)] = True
            for g, n in zip(group.tolist(), share.tolist()):
                shares[g] = max(shares.get(g, 0), n + 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.full(len(at), -1), [*shares]].astype(np.int32)), pa.array(np.r_[at, [*shares.values()]].astype(np.int32))], names=["group", "n"]
        )

    got = near.mapInArrow(kernel, "group int, n int").distinct().toArrow()
    group, n = got.column("group").to_numpy(), got.column("n").to_numpy()
    bits, shares = np.zeros(1 << 24, bool), np.zeros(int(group.max(initial=-1)) + 1, np.int64)
    bits[n[group < 0]] = True
    np.maximum.at(shares, group[group >= 0], n[group >= 0])
    return np.packbits(bits), shares


def _chosen(sets: DataFrame, sizes: _Sizes, blocks: np.ndarray, bits: np.ndarray, shares: np.ndarray) -> DataFrame:
    """Whole sets, packed, for every share of a group in which they may be in a pair: ``group``, ``share``, ``class_id``, ``key``, ``v``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _few(batch):
                e, n = _flat(b.column(1))
                keys = _keys(e, n)
                row, group = _groups(sizes, blocks, n, keys)
                k = np.where(group < len(shares), shares[np.minimum(group, len(shares) - 1)], 0) if len(shares) else np.zeros(len(group), np.int64)
                row, group, share = np.repeat(row, k), np.repeat(group, k), _ragged(np.zeros(len(k), np.int64), k)
                h = _places(keys[:, :8].copy().view("<u8").ravel()[row], group, share)
                keep = np.flatnonzero(bits[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1)
                row, group, share = row[keep], group[keep], share[keep]
                v, ends = (e.astype(np.int64) + (1 << 31)).astype(np.uint32), np.cumsum(n)
                packed = {x: _pack(np.diff(v[ends[x] - n[x] : ends[x]], prepend=np.uint32(0))) for x in set(row.tolist())}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group.astype(np.int32)), pa.array(share.astype(np.int32)), b.column(0).take(pa.array(row)),
                        pa.array([keys[x].tobytes() for x in row.tolist()], pa.binary()), pa.array([packed[x] for x in row.tolist()], pa.binary()),
                    ],
                    names=["group", "share", "class_id", "key", "v"],
                )

    return sets.mapInArrow(kernel, f"group int, share int, class_id {sets.schema['class_id'].dataType.simpleString()}, key binary, v binary")


def _compared(t: float, kind: pa.DataType, near: pa.Table, found: pa.Table) -> pa.Table:
    """The pairs above the threshold, by the smallest idents of equal sets."""
    least: dict = {}
    whole: dict = {}
    for key, ident, v in zip(*(found.column(x).to_pylist() for x in ("key", "class_id", "v"))):
        if key not in least:
            least[key], whole[key] = ident, v
        elif ident < least[key]:
            least[key] = ident
    whole = {k: np.cumsum(_unpack(v, np.uint32), dtype=np.uint32) for k, v in whole.items()}
    out = []
    for k1, k2 in zip(near.column("k1").to_pylist(), near.column("k2").to_pylist()):
        a, b = whole[k1], whole[k2]
        both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
        similarity = both / (len(a) + len(b) - both)
        if similarity > t:
            x, y = least[k1], least[k2]
            out.append((x, y, similarity) if x < y else (y, x, similarity))
    one, two, similarity = zip(*out) if out else ((), (), ())
    return pa.table({"id1": pa.array(one, kind), "id2": pa.array(two, kind), "similarity": pa.array(similarity, pa.float64())})


def jaccard_pairs(sets: DataFrame, threshold: float = 0.8, ident: str = "doc_id") -> DataFrame:
    """All pairs of classes of equal shingle sets whose Jaccard similarity is above ``threshold``: ``id1`` < ``id2``, ``similarity``.

    Exact, but for the chance that two sets share 128 bits of hash: two sets above it share elements among the rarest of each,
    as many as may be missing and some more.  Only these move, packed, to where sets of like sizes meet; there shared ones are
    counted, and whole sets follow, packed too, for pairs that share enough.  Any order of the elements will do, so it is made of a
    table of bounded size.  Empty sets are in no pair.

    ``sets`` is read three times and never stored, as sets are many times larger than the texts they come from.
    """
    sizes = _Sizes(single(threshold))
    sets = sets.filter((F.size("shingles") > 0) & col(ident).isNotNull()).select(col(ident).alias("class_id"), "shingles")
    counts, elements = _counts(sets, sizes.bounds)
    blocks = -(-elements // BLOCK)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _near(sizes, pa.Table.from_batches(batches))

    def compare(near: pa.Table, found: pa.Table) -> pa.Table:
        return _compared(sizes.t, found.schema.field("class_id").type, near, found)

    near = cut(_fronts(sets, sizes, counts, blocks).groupBy("group").applyInArrow(meet, "group int, share int, k1 binary, k2 binary"))
    found = _chosen(sets, sizes, blocks, *_wanted(near))
    kind = sets.schema["class_id"].dataType.simpleString()
    return near.groupBy("group", "share").cogroup(found.groupBy("group", "share")).applyInArrow(compare, f"id1 {kind}, id2 {kind}, similarity double")


def link_counts(pairs: DataFrame, members: DataFrame, ident: str = "doc_id") -> DataFrame:
    """One row per document: ``ident``, ``class_id``, and ``links``, the other documents it is similar to: its class, and those its class is paired with."""
    size = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("id1").alias("x"), F.col("id2").alias("y")), F.struct(F.col("id2").alias("x"), F.col("id1").alias("y")))).alias("p"))
    beyond = ends.select("p.x", "p.y").join(size.withColumnRenamed("class_id", "y"), "y").groupBy(F.col("x").alias("class_id")).agg(F.sum("n").alias("far"))
    per_class = size.join(beyond, "class_id", "left").select("class_id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return members.join(per_class, "class_id").select(ident, "class_id", "links")
