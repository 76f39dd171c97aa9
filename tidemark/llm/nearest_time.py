"""Records of two tables paired with the nearest in time of the same entity.

A stream join with state: both sides of an entity arrive in order of time and
are buffered; a left record is emitted once the watermark (the latest time seen)
has passed its tolerance horizon, and candidates that no waiting or coming left
record can reach are evicted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, present, shuffle_width
from .arrow import changes, numbers

LEFT, RIGHT = 1, 0


def match_sorted(first: np.ndarray, t: np.ndarray, side: np.ndarray, ident: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by entity and time: places of the left rows, the place of each one's right row (-1: none), and the gap.

    ``first`` marks where an entity begins.  Of two right rows equally near, that with the smaller id.
    """
    n = len(t)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(first, at, 0))
    end = np.r_[at[first][1:], n][np.cumsum(first) - 1]
    before = np.maximum.accumulate(np.where(side == RIGHT, at, -1))
    after = np.minimum.accumulate(np.where(side == RIGHT, at, n)[::-1])[::-1]
    left = np.flatnonzero(side == LEFT)
    b, a = before[left], after[left]
    b_ok, a_ok = b >= begin[left], a < end[left]
    far = np.inf
    to_b = np.where(b_ok, np.abs(t[left] - t[np.where(b_ok, b, 0)]), far)
    to_a = np.where(a_ok, np.abs(t[np.where(a_ok, a, 0)] - t[left]), far)
    take_a = (to_a < to_b) | ((to_a == to_b) & a_ok & (ident[np.where(a_ok, a, 0)] < ident[np.where(b_ok, b, 0)]))
    gap = np.where(take_a, to_a, to_b)
    return left, np.where(gap <= tolerance, np.where(take_a, a, b), -1), gap


class NearestState:
    """The two buffers of the entity under way.  ``push`` takes sorted rows and gives what can be emitted; ``finish`` gives the rest."""

    def __init__(self, n_keys: int, tolerance: float):
        self.n_keys, self.tolerance, self.held = n_keys, tolerance, None

    def push(self, rows: pa.Table | None, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left id, right id (masked by gap = inf where there is none) and gap."""
        parts = [x for x in (self.held, rows) if x is not None and x.num_rows]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        table = pa.concat_tables(parts).combine_chunks()
        cols = [c.chunk(0) if c.num_chunks else c for c in table.columns]
        first = changes(cols[: self.n_keys])
        t, side, ident = (numbers(c) for c in cols[self.n_keys :])
        left, right, gap = match_sorted(first, t, side, ident, self.tolerance)
        if last:
            done = np.ones(len(left), bool)
            self.held = None
        else:
            start = np.flatnonzero(first)[-1]
            watermark = t[-1]
            done = (left < start) | (t[left] + self.tolerance < watermark)
            keep = np.zeros(len(t), bool)
            keep[left[~done]] = True
            oldest = min([watermark, *t[left[~done]][:1]]) - self.tolerance
            keep[start:] |= (side[start:] == RIGHT) & (t[start:] >= oldest)
            self.held = table.filter(pa.array(keep))
        found = right[done] >= 0
        return ident[left[done]], np.where(found, ident[np.maximum(right[done], 0)], 0), np.where(found, gap[done], np.inf)


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[str, str]],
    times: tuple[str, str],
    ids: tuple[str, str],
    tolerance: float,
    span: float = 60.0,
) -> DataFrame:
    """One row per row of ``left``: ``left_id``, ``right_id`` of the nearest row of ``right`` with equal keys whose time
    is at most ``tolerance`` away, and ``gap``; both null if there is none.  Ties go to the smaller right id.

    ``times`` are numbers on one axis, as recorded; ``ids`` are integers.  Rows with a null key, or a time that is null
    or NaN, match nothing: left ones come out unmatched, right ones take no part.  Repeated left rows come out as often
    as they are there; right rows with equal time count as the one with the smallest id.  Empty tables are fine, and
    further columns are not looked at.

    An entity is cut into spans of time, to which right rows within the tolerance of an edge belong twice, so that an
    entity with a large part of all rows is worked on by many tasks; right rows of one time are merged before the shuffle.
    """
    n = len(keys)
    width = max(float(span), 8.0 * tolerance)
    names = [f"_k{i}" for i in range(n)]

    def side(df: DataFrame, which: int) -> DataFrame:
        t = present(col(times[which]), df.schema[times[which]].dataType).cast("double")
        return df.select(*[col(k[which]).alias(x) for k, x in zip(keys, names)], t.alias("_t"), col(ids[which]).cast("bigint").alias("_id"))

    whole = F.lit(True)
    for x in [*names, "_t"]:
        whole = whole & F.col(x).isNotNull()
    lefts = side(left, 0)
    lone = lefts.filter(~whole).select(F.col("_id").alias("left_id"), F.lit(None).cast("bigint").alias("right_id"), F.lit(None).cast("double").alias("gap"))
    lefts = lefts.filter(whole).withColumns({"_span": F.floor(F.col("_t") / width), "_side": F.lit(LEFT)})
    spans = F.array_distinct(F.array(*[F.floor((F.col("_t") + d) / width) for d in (-tolerance, 0.0, tolerance)]))
    rights = (
        side(right, 1)
        .filter(whole & F.col("_id").isNotNull())
        .groupBy(*names, "_t")
        .agg(F.min("_id").alias("_id"))
        .withColumns({"_span": F.explode(spans), "_side": F.lit(RIGHT)})
    )
    order = [*names, "_span", "_t", "_side", "_id"]
    both = lefts.select(order).unionByName(rights.select(order))
    both = both.repartition(shuffle_width(left.sparkSession), *names, "_span").sortWithinPartitions(*order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = NearestState(n + 1, tolerance)

        def out(a: np.ndarray, b: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
            none = ~np.isfinite(g)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none), pa.array(g, mask=none)], names=["left_id", "right_id", "gap"])

        for b in batches:
            yield out(*state.push(pa.Table.from_batches([b])))
        yield out(*state.push(None, last=True))

    return both.mapInArrow(kernel, "left_id bigint, right_id bigint, gap double").unionByName(lone)
