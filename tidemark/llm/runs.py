"""Runs of repeated consecutive events, each collapsed into one row.

Events are sorted by entity and order over the whole table and cut into ranges,
so that an entity of any size is read by many tasks.  A state machine goes over
each range and compares every event with the run's anchor, the event before it;
it emits finished runs, and the run at either edge of the range as an open one.
Open runs (two at most per range) are stitched by the same machine.  Ranges are
cut once and leave all their runs in one pass, so no run is lost or doubled
however often a task is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, micros, present, shuffle_width
from .arrow import changes, numbers

#: Stands for a missing value among the whole multiples of the resolution.
GONE = np.iinfo(np.int64).min


class RunMachine:
    """Collapses sorted pieces into runs.  A piece is an event, or a run that is open at an edge.

    Pieces have the keys, first and last value (in steps of the resolution), first and last time, first and last id,
    count, and the first and last range they come from.  ``push`` gives the runs that are finished, ``finish`` the one
    under way.  With ``stitching``, pieces are open runs: two of one range were parted by the range itself.
    """

    def __init__(self, n_keys: int, tolerance: int, max_gap: int | None, stitching: bool = False):
        self.n_keys, self.tolerance, self.max_gap, self.stitching, self.open = n_keys, tolerance, max_gap, stitching, None

    def push(self, rows: pa.Table) -> pa.Table:
        parts = [x for x in (self.open, rows) if x is not None and x.num_rows]
        if not parts:
            return rows
        table = pa.concat_tables(parts).combine_chunks()
        cols = [c.chunk(0) for c in table.columns]
        k = self.n_keys
        v0, v1, t0, t1, i0, i1, n, p0, p1 = (numbers(c) for c in cols[k:])
        new = changes(cols[:k])
        gone = (v0[1:] == GONE) | (v1[:-1] == GONE)
        alike = np.where(gone, v0[1:] == v1[:-1], np.abs(np.where(gone, 0, v0[1:]) - np.where(gone, 0, v1[:-1])) <= self.tolerance)
        if self.max_gap is not None:
            alike &= t0[1:] - t1[:-1] <= self.max_gap
        if self.stitching:
            alike &= p0[1:] != p1[:-1]
        new[1:] |= ~alike
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(n)] - 1
        total = np.add.reduceat(n, start)
        runs = pa.table([c.take(pa.array(start)) for c in cols[:k]] + [pa.array(x) for x in (v0[start], v1[end], t0[start], t1[end], i0[start], i1[end], total, p0[start], p1[end])], schema=table.schema)
        self.open = runs.slice(len(start) - 1)
        return runs.slice(0, len(start) - 1)

    def finish(self) -> pa.Table | None:
        last, self.open = self.open, None
        return last


def collapse_runs(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ident: str,
    value: str,
    tolerance: float = 0.05,
    resolution: float = 0.01,
    min_count: int = 3,
    max_gap_seconds: float | None = None,
) -> DataFrame:
    """One row per maximal run of at least ``min_count`` consecutive events of an entity: the keys, ``first_id``,
    ``last_id``, ``run_length``, ``started_at``, ``ended_at`` (microseconds), ``duration`` (seconds), ``first_value``
    and ``last_value``.

    Events of equal ``keys`` are ordered by ``time`` and the integer ``ident``.  One belongs to the run of the event
    before it if their values, rounded to ``resolution``, differ by at most ``tolerance`` (or both are missing, null or
    NaN) and the gap in time isn't longer than ``max_gap_seconds``.  A null key is a key like others; events without
    time are left out.  Repeated events count each.  An empty table gives no runs; further columns are not looked at.
    """
    n = len(keys)
    steps = F.round(present(col(value), df.schema[value].dataType).cast("double") / resolution).cast("bigint")
    names = [f"_k{i}" for i in range(n)]
    src = df.select(
        *[col(k).alias(x) for k, x in zip(keys, names)],
        F.coalesce(steps, F.lit(int(GONE) + 1) - 1).alias("_v"),
        micros(df, time).alias("_t"),
        col(ident).cast("bigint").alias("_id"),
    ).filter("_t is not null and _id is not null")
    # The value too, so that what a task reads is in one order however often it is read.
    order = [*names, "_t", "_id", "_v"]
    src = src.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    pieces = ["_v0", "_v1", "_t0", "_t1", "_i0", "_i1", "_n", "_p0", "_p1"]
    kinds = [f"{x} {src.schema[x].dataType.simpleString()}" for x in names]
    schema = ", ".join([*kinds, *[f"{p} bigint" for p in pieces], "_open boolean"])
    limit, gap = int(round(tolerance / resolution)), None if max_gap_seconds is None else int(max_gap_seconds * 1e6)

    def marked(t: pa.Table, is_open: bool) -> list[pa.RecordBatch]:
        if not is_open:
            t = t.filter(pa.array(numbers(t.column("_n")) >= min_count))
        return t.append_column("_open", pa.array([is_open] * t.num_rows, pa.bool_())).to_batches()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        machine, at_edge, here = RunMachine(n, limit, gap), True, TaskContext.get().partitionId()
        for b in batches:
            v, t, i = b.column(n), b.column(n + 1), b.column(n + 2)
            one, range_ = pa.array(np.ones(b.num_rows, np.int64)), pa.array(np.full(b.num_rows, here, np.int64))
            events = pa.table([*b.columns[:n], v, v, t, t, i, i, one, range_, range_], names=[*names, *pieces])
            done = machine.push(events) if b.num_rows else events
            if at_edge and done.num_rows:
                yield from marked(done.slice(0, 1), True)
                done, at_edge = done.slice(1), False
            yield from marked(done, False)
        if (last := machine.finish()) is not None:
            yield from marked(last, True)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = RunMachine(n, limit, gap, stitching=True)
        for b in batches:
            is_open = b.column(b.num_columns - 1)
            yield b.filter(pc.invert(is_open))
            yield from marked(machine.push(pa.Table.from_batches([b.filter(is_open)]).drop_columns(["_open"])), False)
        if (last := machine.finish()) is not None:
            yield from marked(last, False)

    # Finished and open runs leave the ranges together, in one shuffle: were they read apart, each reading could cut ranges of
    # its own.  Open ones meet in one task; two per range at most, their number is bounded by that of the ranges.
    found = src.mapInArrow(ranges, schema).withColumn("_to", F.when(~F.col("_open"), F.xxhash64("_i0")))
    found = found.repartition(shuffle_width(df.sparkSession), "_to").drop("_to").sortWithinPartitions("_open", *names, "_t0", "_i0", "_p0", "_v0")
    found = found.mapInArrow(stitch, schema)
    back = lambda v: F.when(F.col(v) != F.lit(int(GONE) + 1) - 1, F.round(F.col(v) * resolution, 9))
    return found.select(
        *[F.col(x).alias(k) for x, k in zip(names, keys)],
        F.col("_i0").alias("first_id"),
        F.col("_i1").alias("last_id"),
        F.col("_n").alias("run_length"),
        F.col("_t0").alias("started_at"),
        F.col("_t1").alias("ended_at"),
        ((F.col("_t1") - F.col("_t0")) / 1e6).alias("duration"),
        back("_v0").alias("first_value"),
        back("_v1").alias("last_value"),
    )
