"""The most similar vectors of every vector: an inverted file with an adaptive dimension scan.

Vectors are put into lists by their nearest centre.  A list is scanned in blocks
of rotated dimensions: after a random rotation the partial squared distance of
the first d of D dimensions tells the whole one up to a factor that a hypothesis
test bounds, so candidates whose partial distance is too large are abandoned
early.  The scan of a vector's own list gives the distance it has to beat
elsewhere, and every list that can hold something nearer is probed: the nearest
ones first, then, by the distance to beat after them, all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import col, cut, ensure_checkpoint_dir


@dataclass(frozen=True)
class KnnParams:
    """``sample`` bounds the vectors that centres are fitted on; every vector is indexed and searched."""

    k: int = 5
    dim: int = 48
    list_size: int = 600  # vectors a list should hold
    many_lists: int = 4096  # number of lists from which it grows with the root of the number of vectors only
    sample: int = 60_000  # vectors that centres are fitted on, or eight for each list, if that is more
    most_sample: int = 500_000
    fit_rounds: int = 8
    probes: int = 24  # lists probed besides a vector's own in the first round, nearest first; the second takes all others that can hold something nearer
    block: int = 12  # rotated dimensions a step of the scan adds
    epsilon: float = 3.0  # deviations of the hypothesis test that abandons a candidate
    dense_share: float = 0.05  # of candidates alive, above which a step is taken for all of them
    part_rows: int = 8192  # members of a list that one task holds
    group_rows: int = 65_536  # members of neighbouring lists that one task of the second round holds
    seed: int = 20


#: Fixed value: bounds are met with so much room for rounding.
SLACK = 1 + 1e-6


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's k-means on a sample; centres that lose all their members move to the sample's worst served vectors.

    Many centres are fitted in two steps: some groups of vectors, and in each group its share of the centres.
    """
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float32)
    lists = max(1, min(lists, len(x)))
    if lists > 4096:
        home, _ = nearest_centre(x, fit_centres(x, int(np.sqrt(lists)), rounds, seed))
        size = np.bincount(home)
        share = np.maximum((size > 0).astype(int), np.floor(lists * size / len(x)).astype(int))
        return np.concatenate([fit_centres(x[home == g], k, rounds, seed) for g, k in enumerate(share) if k])
    centre = x[rng.choice(len(x), lists, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]), np.float32)
    for _ in range(rounds if len(x) else 0):
        home, far = nearest_centre(x, centre)
        size = np.bincount(home, minlength=lists)
        total = np.zeros(centre.shape, np.float64)
        np.add.at(total, home, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre).astype(np.float32)
        if (size == 0).any():
            worst = np.argsort(-far)[: int((size == 0).sum())]
            centre[np.flatnonzero(size == 0)[: len(worst)]] = x[worst]
    return centre


def nearest_centre(x: np.ndarray, centre: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    home, far = np.zeros(len(x), np.int32), np.zeros(len(x), np.float32)
    norm = (centre.astype(np.float32) ** 2).sum(1)
    for a in range(0, len(x), rows):
        d = norm - 2 * (x[a : a + rows] @ centre.T)
        home[a : a + rows] = d.argmin(1)
        far[a : a + rows] = d.min(1) + (x[a : a + rows] ** 2).sum(1)
    return home, far


class AdaptiveScan:
    """The members of one list, ready to be searched.  ``members``: values as given, by row; ``ids``: theirs."""

    def __init__(self, members: np.ndarray, ids: np.ndarray, turn: np.ndarray, p: KnnParams):
        self.p, self.exact, self.ids, self.turn = p, members.astype(np.float64), ids, turn
        self.middle = self.exact.mean(0) if len(members) else np.zeros(p.dim)
        self.rotated = ((self.exact - self.middle) @ turn).astype(np.float32)
        edges = [*range(0, p.dim, p.block), p.dim]
        self.blocks = [(a, b) for a, b in zip(edges[:-1], edges[1:])]
        self.columns = [np.ascontiguousarray(self.rotated[:, a:b]) for a, b in self.blocks]
        self.norms = [(c**2).sum(1) for c in self.columns]

    def search(self, q: np.ndarray, own: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id and squared distance of up to k members nearer than ``reach`` (squared; may be inf)."""
        out = [self._search(q[a : a + 512], own[a : a + 512], reach[a : a + 512], a) for a in range(0, len(q), 512)]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _search(self, q: np.ndarray, own: np.ndarray, reach: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n = self.p, len(self.ids)
        exact = q.astype(np.float64)
        turned = ((exact - self.middle) @ self.turn).astype(np.float32)
        a, b = self.blocks[0]
        head = turned[:, a:b]
        part = (head**2).sum(1)[:, None] + self.norms[0][None, :] - 2 * (head @ self.columns[0].T)
        part[own[:, None] == self.ids[None, :]] = np.inf
        # The k best of the first block bound what can still matter.
        k = min(p.k, n)
        first = np.argpartition(part, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(q), 1))
        there = np.isfinite(np.take_along_axis(part, first, 1))
        known = np.where(there, ((exact[:, None, :] - self.exact[first]) ** 2).sum(2), np.inf)
        bound = np.minimum(reach, known.max(1) if k == p.k else np.inf)
        slack = 1e-4 * (1.0 + (turned**2).sum(1))  # of distances worked out in single precision

        def alive(partial: np.ndarray, d: int, row) -> np.ndarray:
            # The partial distance is never above the whole one, so a factor above 1 would keep what is surely too far.
            factor = min(1.0, d / p.dim * (1 + p.epsilon / np.sqrt(d)) ** 2)
            return partial <= (bound * factor + slack)[row]

        every = np.arange(len(q))[:, None]
        live, step = alive(part, b, every) & np.isfinite(part), 1
        # While many candidates live on, a block is added for all at once; once they are few, for each of them.
        while step < len(self.blocks) and live.mean() > p.dense_share:
            a, b = self.blocks[step]
            head = turned[:, a:b]
            part += (head**2).sum(1)[:, None] + self.norms[step][None, :] - 2 * (head @ self.columns[step].T)
            live &= alive(part, b, every)
            step += 1
        row, cand = np.nonzero(live)
        partial = part[row, cand]
        for (a, b), column in zip(self.blocks[step:], self.columns[step:]):
            partial = partial + ((turned[row, a:b] - column[cand]) ** 2).sum(1)
            keep = alive(partial, b, row)
            row, cand, partial = row[keep], cand[keep], partial[keep]
        dist = ((exact[row] - self.exact[cand]) ** 2).sum(1)
        keep = dist <= reach[row]
        row, ident, dist = row[keep], self.ids[cand[keep]], dist[keep]
        order = np.lexsort((ident, dist, row))
        row, ident, dist = row[order], ident[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < p.k] + shift, ident[place < p.k], dist[place < p.k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32, copy=False)


def _lists(values: np.ndarray) -> pa.Array:
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel(), pa.float32()))


def usable(df: DataFrame, ident: str, vec: str, dim: int) -> DataFrame:
    """Rows (``id``, ``v``) whose vector has ``dim`` finite values, none null."""
    v = col(vec).cast("array<float>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.filter(col(ident).isNotNull() & (F.size(v) == dim) & F.forall(v, finite)).select(col(ident).cast("bigint").alias("id"), v.alias("v"))


def nearest_vectors(df: DataFrame, ident: str = "vec_id", vec: str = "vec_", p: KnnParams = KnnParams()) -> DataFrame:
    """The ``k`` nearest of every usable vector by squared Euclidean distance, ties to the smaller id: rows ``id``,
    ``neighbour``, ``distance`` (squared).

    Usable vectors have exactly ``dim`` values, none null, NaN or infinite; others take no part.  Equal vectors under
    different ids are neighbours of one another at distance 0; they are searched once.  Where fewer than ``k`` others
    are there, all of them come out.  Empty tables give no rows; further columns are not looked at.

    Centres are fitted on at most ``most_sample`` vectors, taken by a hash of the id; the centres (one for eight of these at
    most) are all that goes to every task.  Lists hold ``list_size`` vectors, and beyond ``many_lists`` lists both their number
    and their size grow with the root of the number of vectors.  A list beyond ``part_rows`` members is searched in parts.  No list that can hold
    something nearer is left out: vectors with more than ``probes`` such lists go on to groups of neighbouring lists.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    k, dim = p.k, p.dim
    vectors = usable(df, ident, vec, dim)
    # Equal vectors meet by two hashes and their values, merged before the shuffle; the smallest id stands for all.
    distinct = cut(vectors.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, neighbour bigint, distance double")
    root = int(np.sqrt(n))
    rows = min(p.most_sample, max(p.sample, 8 * root))
    sample = _matrix(distinct.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("v").toArrow().column("v").combine_chunks(), dim)
    lists = int(max(1, min(n // p.list_size, max(p.many_lists, root), len(sample) // 8 or 1)))
    centre = fit_centres(sample, lists, p.fit_rounds, p.seed)
    turn = rotation(dim, p.seed)
    # A list is held in parts, as many as the sample says it will need.
    share = np.bincount(nearest_centre(sample, centre)[0], minlength=len(centre)) / len(sample)
    parts = np.maximum(1, np.ceil(1.1 * share * n / p.part_rows)).astype(np.int64)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, _ = nearest_centre(_matrix(b.column(1), dim), centre)
            with np.errstate(over="ignore"):
                lot = b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            part = (lot % parts[where].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(part), b.column(0), b.column(1)], names=["list", "part", "rep", "v"])

    members = distinct.select("rep", "v").mapInArrow(home, "list int, part int, rep bigint, v array<float>")

    def own_list(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("rep").to_numpy()
        x = _matrix(t.column("v").chunk(0), dim)
        scan = AdaptiveScan(x, ids, turn, p)
        row, near, dist = scan.search(x, ids, np.full(len(x), np.inf))
        count = np.bincount(row, minlength=len(x))
        worst = np.full(len(x), np.inf)
        last = np.cumsum(count) - 1
        full = count >= k
        worst[full] = dist[last[full]]
        own, part = int(t.column("list")[0].as_py()), int(t.column("part")[0].as_py())
        ends, units, unfinished = _probes(x, own, part, worst, centre, parts, p)
        offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
        return pa.table(
            {
                "rep": pa.array(ids),
                "v": _lists(x),
                "reach": pa.array(worst),
                "near": pa.ListArray.from_arrays(offsets, pa.array(near, pa.int64())),
                "dist": pa.ListArray.from_arrays(offsets, pa.array(dist, pa.float64())),
                "probe": pa.ListArray.from_arrays(pa.array(ends), pa.array(units)),
                "list": pa.array(np.full(len(x), own, np.int32)),
                "part": pa.array(np.full(len(x), part, np.int32)),
                "unfinished": pa.array(unfinished),
            }
        )

    first = cut(members.groupBy("list", "part").applyInArrow(own_list, "rep bigint, v array<float>, reach double, near array<bigint>, dist array<double>, probe array<bigint>, list int, part int, unfinished boolean"))
    asked = first.filter(F.size("probe") > 0).select(F.explode("probe").alias("unit"), "rep", "v", "reach")
    # From here on the vectors are read with the list they were found to be in.
    members = first.select(*[F.col(x).alias(x) for x in ("list", "part", "rep", "v")])
    held = members.select((F.col("list").cast("bigint") * (1 << 20) + F.col("part")).alias("unit"), "rep", "v")
    # A list that is asked by many goes to several tasks, each with a share of those that ask: a table of fewer rows than units.
    share = 4 * p.part_rows
    load = asked.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).select("unit", F.ceil(F.col("n") / share).cast("int").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    asked = asked.join(F.broadcast(load), "unit", "left").withColumn("copy", F.pmod(F.xxhash64("rep"), copies).cast("int")).drop("copies")
    held = held.join(F.broadcast(load), "unit", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")

    def other_list(m: pa.Table, q: pa.Table) -> pa.Table:
        if m.num_rows and q.num_rows:
            m, q = m.combine_chunks(), q.combine_chunks()
            scan = AdaptiveScan(_matrix(m.column("v").chunk(0), dim), m.column("rep").to_numpy(), turn, p)
            ids = q.column("rep").to_numpy()
            row, near, dist = scan.search(_matrix(q.column("v").chunk(0), dim), ids, q.column("reach").to_numpy())
            return pa.table({"rep": pa.array(ids[row]), "near": pa.array(near, pa.int64()), "d": pa.array(dist)})
        return pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})

    more = held.groupBy("unit", "copy").cogroup(asked.groupBy("unit", "copy")).applyInArrow(other_list, "rep bigint, near bigint, d double")
    mine = first.select("rep", F.explode(F.arrays_zip("near", "dist")).alias("x")).select("rep", F.col("x.near").alias("near"), F.col("x.dist").alias("d"))
    if first.filter("unfinished").limit(1).count():
        more = cut(more)
        more = more.unionByName(_remaining(first, members, mine.unionByName(more), centre, turn, p))
    found = mine.unionByName(more)

    # The first ids of each set of equal vectors, which other vectors may have as neighbours.
    several = distinct.filter("copies > 1").select("v", "rep", F.ceil(F.col("copies") / p.part_rows).cast("int").alias("shares"))
    # A vector that a large part of all ids have is met in shares, told by a table of hashes: 2**20 rows at most.
    at = F.pmod(F.xxhash64("v"), F.lit(1 << 20)).cast("int")
    hot = F.broadcast(several.filter("shares > 1").groupBy(at.alias("at")).agg(F.max("shares").alias("cut")))
    cut_of, share = F.coalesce("cut", F.lit(1)), F.pmod(F.xxhash64("id"), F.coalesce("cut", F.lit(1))).cast("int")
    several = several.select("v", "rep", at.alias("at")).join(hot, "at", "left")
    each = several.select("v", "rep", F.explode(F.sequence(F.lit(0), cut_of - 1)).alias("share"))
    equal = vectors.withColumn("at", at).join(hot, "at", "left").select("v", "id", share.alias("share")).join(each, ["v", "share"]).select("rep", "id", "share")
    rank = Window.partitionBy("rep").orderBy("id")
    heads = equal.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("head"))
    reach = found.join(heads.select(F.col("rep").alias("near"), "head"), "near", "left").select("rep", F.coalesce("head", "near").alias("neighbour"), "d")
    reach = reach.unionByName(heads.select("rep", F.col("head").alias("neighbour"), F.lit(0.0).alias("d")))
    # At most k * (k + 1) candidates a vector for its own list, each of the first probes and each group of lists.
    best = reach.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "neighbour"))), 1, k + 1).alias("best"))
    alone = distinct.filter("copies = 1").select("rep", F.col("rep").alias("id"), F.lit(0).alias("share"))
    best = best.join(several.filter("cut > 1").select("rep", "cut"), "rep", "left").select("rep", "best", F.explode(F.sequence(F.lit(0), cut_of - 1)).alias("share"))
    return (
        alone.unionByName(equal)
        .join(best, ["rep", "share"])
        .select("id", F.explode(F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("id")), 1, k)).alias("b"))
        .select("id", F.col("b.neighbour").alias("neighbour"), F.col("b.d").alias("distance"))
    )


def _leads(v: np.ndarray, own: np.ndarray, centre: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How far each vector is at least from whatever lies in the lists of the centres ``to``: its distance from the dividing plane between its own centre and theirs."""
    mine, norm = centre[own], (to**2).sum(1)[None, :]
    d = (v**2).sum(1)[:, None] + norm - 2 * v @ to.T
    apart = np.sqrt(np.maximum((mine**2).sum(1)[:, None] + norm - 2 * mine @ to.T, 0))
    lead = d - ((v - mine) ** 2).sum(1)[:, None]
    return np.divide(lead, 2 * apart, out=np.full(lead.shape, -np.inf), where=apart > 0)


def _probes(x: np.ndarray, own: int, part: int, worst: np.ndarray, centre: np.ndarray, parts: np.ndarray, p: KnnParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units (list and part) of the first round for each vector of one list, as ends and units one behind the other, and
    whether further lists can hold something nearer."""
    c = centre.astype(np.float64)
    rest = own * (1 << 20) + np.array([s for s in range(parts[own]) if s != part], np.int64)
    sizes, units, unfinished = [], [np.zeros(0, np.int64)], np.zeros(len(x), bool)
    for a in range(0, len(x), 1024):
        v = x[a : a + 1024].astype(np.float64)
        lead = _leads(v, np.full(len(v), own), c, c)
        lead[:, own] = np.inf
        near = (lead <= (np.sqrt(worst[a : a + 1024]) * SLACK)[:, None]) & (lead < np.inf)
        many = near.sum(1) > p.probes
        if many.any():
            unfinished[a : a + 1024] = many
            nearest = np.argsort(np.where(near[many], lead[many], np.inf), axis=1, kind="stable")[:, : p.probes]
            near[many] = False
            near[np.flatnonzero(many)[:, None], nearest] = True
        row, at = np.nonzero(near)
        k = parts[at]
        first = np.repeat(at * (1 << 20), k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        row = np.r_[np.repeat(row, k), np.repeat(np.arange(len(v)), len(rest))]
        units.append(np.r_[first, np.tile(rest, len(v))][np.argsort(row, kind="stable")])
        sizes.append(np.bincount(row, minlength=len(v)))
    return np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32) if sizes else np.zeros(1, np.int32), np.concatenate(units), unfinished


def _groups(centre: np.ndarray, size: dict[int, int], p: KnnParams) -> dict[int, int]:
    """The group of each unit: neighbouring lists, about ``group_rows`` members together.  ``size``: members by unit."""
    home, _ = nearest_centre(centre, fit_centres(centre, max(1, len(centre) // 64), p.fit_rounds, p.seed))
    out, group, rows = {}, 0, 0
    for unit in sorted(size, key=lambda u: (home[u >> 20], u)):
        if rows and rows + size[unit] > p.group_rows:
            group, rows = group + 1, 0
        out[unit], rows = group, rows + size[unit]
    return out


def _remaining(first: DataFrame, members: DataFrame, found: DataFrame, centre: np.ndarray, turn: np.ndarray, p: KnnParams) -> DataFrame:
    """What the first round left: members of all further lists that can hold something nearer than the k-th found so far.

    A vector goes once to each group of lists that it asks any of, and its distance to beat shrinks from list to list.
    """
    spark, k, dim = first.sparkSession, p.k, p.dim
    c = centre.astype(np.float64)
    unit = F.col("list").cast("bigint") * (1 << 20) + F.col("part")
    # A row for each unit: as many as lists, and one more for each further part_rows members.
    size = {int(r[0]): int(r[1]) for r in members.groupBy(unit).count().collect()}
    group_of = _groups(centre, size, p)
    asks = np.zeros((len(c), max(group_of.values()) + 1), np.float32)
    for u, g in group_of.items():
        asks[u >> 20, g] = 1

    left = first.filter("unfinished").select("rep", "v", "list", F.transform("probe", lambda u: F.shiftright(u, 20).cast("int")).alias("done"))
    known = found.join(left.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("d")), 1, k).alias("known"))
    left = left.join(known, "rep", "left").select("rep", "v", "list", "done", F.coalesce("known", F.array().cast("array<double>")).alias("known"))

    def distances(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """The k distances known so far, infinite where there are fewer."""
        out = np.full((len(column), k), np.inf)
        for i, row in enumerate(column.to_pylist()):
            out[i, : len(row)] = row
        return out

    def asked_lists(v: np.ndarray, own: np.ndarray, done: list, to: np.ndarray) -> np.ndarray:
        """Bounds for the lists ``to``, infinite for those that were scanned already."""
        lead = _leads(v, own, c, c[to])
        place = np.full(len(c), -1)
        place[to] = np.arange(len(to))
        row = np.repeat(np.arange(len(v)), [len(x) + 1 for x in done])
        at = place[np.concatenate([np.r_[o, x].astype(np.int64) for o, x in zip(own, done)])]
        lead[row[at >= 0], at[at >= 0]] = np.inf
        return lead

    every = np.arange(len(c))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                v, own, done = _matrix(b.column(1), dim).astype(np.float64), b.column(2).to_numpy(), b.column(3).to_pylist()
                lead = asked_lists(v, own, done, every)
                near = (lead <= np.sqrt(distances(b.column(4))[:, -1:]) * SLACK) & (lead < np.inf)
                row, group = np.nonzero(near.astype(np.float32) @ asks)
                b = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), *b.columns], names=["group", *b.schema.names])

    asked = cut(left.mapInArrow(ask, "group int, rep bigint, v array<float>, list int, done array<int>, known array<double>"))
    load = {int(r[0]): -(-r[1] // (4 * p.part_rows)) for r in asked.groupBy("group").count().collect()}
    if not load:
        return spark.createDataFrame([], "rep bigint, near bigint, d double")
    # A table of one row for each unit and each share of those that ask its group.
    held = spark.createDataFrame([(u, g, load[g]) for u, g in group_of.items() if g in load], "unit bigint, group int, copies int")
    held = members.select(unit.alias("unit"), "rep", "v").join(F.broadcast(held), "unit").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    shares = spark.createDataFrame(list(load.items()), "group int, copies int")
    asked = asked.join(F.broadcast(shares), "group").withColumn("copy", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int")).drop("copies")

    def scan_group(m: pa.Table, q: pa.Table) -> pa.Table:
        ids_out, near_out, dist_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if m.num_rows and q.num_rows:
            m, q = m.combine_chunks().sort_by("unit"), q.combine_chunks().sort_by("list")
            units, start = np.unique(m.column("unit").to_numpy(), return_index=True)
            x, rep = _matrix(m.column("v"), dim), m.column("rep").to_numpy()
            scans = [AdaptiveScan(x[a:b], rep[a:b], turn, p) for a, b in zip(start, [*start[1:], len(x)])]
            to, which = np.unique(units >> 20, return_inverse=True)
            for a in range(0, q.num_rows, 512):
                b = q.slice(a, 512)
                v, ids, own = _matrix(b.column("v"), dim), b.column("rep").to_numpy(), b.column("list").to_numpy()
                lead = asked_lists(v.astype(np.float64), own, b.column("done").to_pylist(), to)
                before = distances(b.column("known"))
                best, near = np.full(before.shape, np.inf), np.full(before.shape, np.iinfo(np.int64).max)
                reach = before[:, -1].copy()
                for j in np.argsort(lead.min(0)[which], kind="stable"):
                    bound = lead[:, which[j]]
                    sel = np.flatnonzero((bound <= np.sqrt(reach) * SLACK) & (bound < np.inf))
                    if not len(sel):
                        continue
                    row, ident, dist = scans[j].search(v[sel], ids[sel], reach[sel])
                    if not len(row):
                        continue
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    hit, at = np.unique(row, return_inverse=True)
                    new = np.full((len(hit), k), np.inf)
                    who = np.full((len(hit), k), np.iinfo(np.int64).max)
                    new[at, place], who[at, place] = dist, ident
                    hit = sel[hit]
                    d, i = np.concatenate([best[hit], new], 1), np.concatenate([near[hit], who], 1)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best[hit], near[hit] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                    reach[hit] = np.sort(np.concatenate([before[hit], best[hit]], 1), 1)[:, k - 1]
                row, at = np.nonzero(np.isfinite(best) & (best <= reach[:, None]))
                ids_out.append(ids[row])
                near_out.append(near[row, at])
                dist_out.append(best[row, at])
        return pa.table({"rep": pa.array(np.concatenate(ids_out)), "near": pa.array(np.concatenate(near_out)), "d": pa.array(np.concatenate(dist_out))})

    return held.groupBy("group", "copy").cogroup(asked.groupBy("group", "copy")).applyInArrow(scan_group, "rep bigint, near bigint, d double")


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs ``vec_id_1`` < ``vec_id_2`` of which at least one is among the nearest of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("vec_id_1"), F.greatest("id", "neighbour").alias("vec_id_2")).distinct()


def brute_force(x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The exact answer, for tests and for measuring recall."""
    x = x.astype(np.float64)
    rows = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        rows += [(ids[i], ids[j], d[j]) for j in order]
    return pd.DataFrame(rows, columns=["id", "neighbour", "distance"])
