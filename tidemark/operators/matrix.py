"""Matrices as tables of cells or rows: rotation, transposition, and the nearest row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(rows: DataFrame, name: str = "matrix_name", row: str = "row_no", values: str = "vec_") -> DataFrame:
    """``name``, ``i``, ``j``, ``v`` of every cell; null and empty rows have none."""
    return rows.select(F.col(name), F.col(row).alias("i"), F.posexplode(values).alias("j", "v"))


def heights(rows: DataFrame, name: str = "matrix_name", row: str = "row_no") -> DataFrame:
    """Rows of each matrix, by its largest row number."""
    return rows.groupBy(F.col(name)).agg((F.max(row) + 1).alias("height"))


def rotate90(c: DataFrame, height: DataFrame, name: str = "matrix_name") -> DataFrame:
    """The cells turned clockwise: row i of n goes to column n - 1 - i, column j to row j."""
    return c.join(height, name).select(name, F.col("j").alias("i"), (F.col("height") - 1 - F.col("i")).alias("j"), "v")


def rotate90_blocked(c: DataFrame, height: DataFrame, block: int = 10, name: str = "matrix_name") -> DataFrame:
    """The turned matrix in pieces of rows: ``i``, ``block`` (of columns) and ``piece``, its cells in order, ``block`` at most."""
    if block < 1:
        raise ValueError("a block has at least one column")
    turned = rotate90(c, height, name)
    grouped = turned.groupBy(name, "i", F.floor(F.col("j") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("p"))
    return grouped.select(name, "i", "block", F.transform("p", lambda x: x["v"]).alias("piece"))


def sequential(spark, n: int) -> DataFrame:
    """The n by n matrix of 1, 2, 3 ..., row by row, as cells."""
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), F.pmod("id", F.lit(n)).cast("int").alias("j"), (F.col("id") + 1).alias("v"))


def from_columns(c: DataFrame, name: str = "matrix_name") -> DataFrame:
    """The cells of matrices read column by column: rows and columns change places."""
    return c.select(name, F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the nearest of ``y`` by number (-1: none) and its squared distance.

    Distances come from products of blocks; those that rounding can't tell from the least are worked out by difference.
    """
    best, dist = np.full(len(x), -1, np.int64), np.full(len(x), np.nan)
    if not len(y):
        return best, dist
    square = (y * y).sum(1)
    for a in range(0, len(x), rows):
        q = x[a : a + rows]
        d = (q * q).sum(1)[:, None] + square[None, :] - 2 * (q @ y.T)
        d[own[a : a + rows, None] == ids[None, :]] = np.inf
        least = d.min(axis=1)
        room = 1e-9 * (1 + (q * q).sum(1) + square.max())
        row, at = np.nonzero(d <= np.where(np.isfinite(least), least + room, -np.inf)[:, None])
        exact = ((q[row] - y[at]) ** 2).sum(1)
        order = np.lexsort((ids[at], exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        best[a + row[first]], dist[a + row[first]] = ids[at[first]], exact[first]
    return best, dist


def nearest_rows(queries: DataFrame, rows: DataFrame, ident: str, values: str, dim: int, block: int = 8192) -> DataFrame:
    """``ident`` and ``nearest`` of every query: the other row at the least squared distance, ties to the smaller ident.

    Exact, by comparing blocks of queries with blocks of rows; of each pair of blocks one row per query comes out.  Rows that
    don't have ``dim`` values, or have null ones, take no part, and a distance that is no number never wins; -1 where no row is left.
    """
    whole = lambda d: d.filter(F.col(ident).isNotNull() & (F.size(values) == dim) & F.forall(values, lambda x: x.isNotNull())).select(
        F.col(ident).cast("bigint").alias("id"), F.col(values).cast("array<double>").alias("v")
    )
    q, r = whole(queries), whole(rows)
    nq, nr = (max(1, -(-x.count() // block)) for x in (q, r))
    side = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = q.select("id", "v", side(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    r = r.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), side(nr).alias("rb"))

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        flat = lambda t: t.combine_chunks().column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        best, dist = np.full(a.num_rows, -1, np.int64), np.full(a.num_rows, np.nan)
        if a.num_rows and b.num_rows:
            x, y, ids, own = flat(a), flat(b), b.column("id").to_numpy(), a.column("id").to_numpy()
            finite = np.isfinite(y).all(axis=1)
            y, ids = y[finite], ids[finite]
            best, dist = _nearest(np.where(np.isfinite(x).all(axis=1)[:, None], x, np.nan), own, y, ids)
        return pa.table({"id": a.column("id"), "nearest": pa.array(best), "d": pa.array(dist, mask=best < 0)})

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(kernel, "id bigint, nearest bigint, d double")
    one = found.groupBy("id").agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", "nearest"))).alias("b"))
    return one.select(F.col("id").alias(ident), F.coalesce("b.nearest", F.lit(-1).cast("bigint")).alias("nearest"), F.col("b.d").alias("distance"))
