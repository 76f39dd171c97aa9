"""``nearest_in_time`` on two streams: the same buffers, kept per entity in the query's state store."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..common import col, present
from .nearest_time import LEFT, RIGHT, match_sorted


#: Where a table's time 0 is put on the axis of a stream, in microseconds: a watermark begins at 0, and drops what isn't above it.
ZERO = 1 << 50

#: A record: its time in microseconds, its id, and the number that gaps are measured by.
Record = tuple[int, int, float]


def emit_and_evict(lefts: list[Record], rights: list[Record], watermark: int, reach: int, tolerance: float) -> tuple[list[tuple], list[Record], list[Record]]:
    """What one entity gives when no row before ``watermark`` can come any more: rows (left id, right id or None, gap or None)
    of the left records whose horizon has passed, the left records that wait on, and the right ones still within reach.

    ``reach`` is the tolerance in microseconds, rounding included.
    """
    ready = [x for x in lefts if x[0] + reach < watermark]
    wait = [x for x in lefts if x[0] + reach >= watermark]
    out = []
    if ready:
        rows = sorted([(v, RIGHT, i) for _, i, v in set(rights)] + [(v, LEFT, i) for _, i, v in ready])
        # Of right records of one time the one with the smallest id counts.
        rows = [r for k, r in enumerate(rows) if r[1] == LEFT or k == 0 or rows[k - 1][:2] != r[:2]]
        v, side, ident = (np.array(c) for c in zip(*rows))
        left, right, gap = match_sorted(np.arange(len(v)) == 0, v.astype(float), side, ident, tolerance)
        out = [(int(ident[a]), int(ident[b]) if b >= 0 else None, float(g) if b >= 0 else None) for a, b, g in zip(left, right, gap)]
    oldest = min([watermark, *[x[0] for x in wait]]) - reach
    return out, wait, [x for x in rights if x[0] >= oldest]


def stream_nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    ids: tuple[str, str],
    tolerance_seconds: float,
    lateness: str = "1 minute",
    span_seconds: float = 60.0,
    measure: str | None = None,
) -> DataFrame:
    """``left_id``, ``right_id`` and ``gap`` (seconds) of every left record, in append mode; null if nothing is near enough.

    Both sides have the ``keys`` and an event ``time``; gaps are measured by it, or by the column ``measure``, the same time as a
    number of seconds.  A left record comes out once the watermark, ``lateness`` behind the
    latest time of both sides, has passed its time by the tolerance; records later than the watermark are dropped, as are those
    with a null key, time or id.  State is kept by entity and span of time, so that an entity with a large part of all records
    is worked on by many tasks; right records within the tolerance of a span's edge belong to both.  It holds what lies within
    the tolerance of the waiting records and the watermark.
    """
    reach = math.ceil(tolerance_seconds * 1e6) + 2
    width = F.lit(max(int(span_seconds * 1e6), 8 * reach))
    measured = F.unix_micros(col(time)) / 1e6 if measure is None else col(measure)
    side = lambda df, ident, which: df.select(*[col(k) for k in keys], col(time).alias("_time"), col(ident).cast("bigint").alias("_id"), measured.alias("_v"), F.lit(which).alias("_side"))
    both = side(left, ids[0], LEFT).unionByName(side(right, ids[1], RIGHT))
    both = both.dropna(subset=[*keys, "_time", "_id", "_v"]).withColumn("_t", F.unix_micros("_time")).withWatermark("_time", lateness)
    near = F.array_distinct(F.array(*[F.floor((F.col("_t") + d) / width) for d in (-reach, 0, reach)]))
    both = both.withColumn("_span", F.explode(F.when(F.col("_side") == RIGHT, near).otherwise(F.array(F.floor(F.col("_t") / width)))))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lefts, rights = [], []
        if state.exists:
            lt, li, lv, rt, ri, rv = state.get
            lefts, rights = list(zip(lt, li, lv)), list(zip(rt, ri, rv))
        if not state.hasTimedOut:
            for pdf in batches:
                for t, i, v, s in zip(*(pdf[c].tolist() for c in ("_t", "_id", "_v", "_side"))):
                    (lefts if s == LEFT else rights).append((t, i, v))
        now = state.getCurrentWatermarkMs()
        out, lefts, rights = emit_and_evict(lefts, rights, now * 1000, reach, tolerance_seconds)
        if lefts or rights:
            state.update(tuple([x[k] for x in side] for side in (lefts, rights) for k in range(3)))
            horizon = min([x[0] for x in lefts] or [max(x[0] for x in rights)]) + reach
            state.setTimeoutTimestamp(max(now + 1, horizon // 1000 + 2))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["left_id", "right_id", "gap"]).astype({"left_id": "int64", "right_id": "Int64", "gap": "float64"})

    return both.groupBy(*[col(k) for k in keys], "_span").applyInPandasWithState(
        step,
        "left_id bigint, right_id bigint, gap double",
        "lt array<bigint>, li array<bigint>, lv array<double>, rt array<bigint>, ri array<bigint>, rv array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def tables_as_streams(
    left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], times: tuple[str, str], ids: tuple[str, str], tolerance: float, folder: str, span: float = 60.0
) -> DataFrame:
    """What the stateful join gives for two streams (``left``, ``right``) read to their end: the rows of ``nearest_in_time``,
    but for left records that have no key or time, which are no part of a stream.

    ``times`` are numbers of seconds on one axis, less than 35 years from 0; one of them beyond all others, in a stream of its own, moves the watermark
    past the last record.  Result and state are written into ``folder``, which all executors must share.
    """
    spark = left.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, which: int) -> DataFrame:
        t = present(col(times[which]), df.schema[times[which]].dataType).cast("double")
        return df.select(*[col(k[which]).cast("bigint").alias(x) for k, x in zip(keys, names)], F.timestamp_micros(F.round(t * 1e6).cast("bigint") + F.lit(ZERO)).alias("_at"), col(ids[which]).cast("bigint").alias("_ident"), t.alias("_measure"))

    last = F.timestamp_micros(F.lit(4 * ZERO))
    ends = os.path.join(folder, "end")
    spark.range(1).select(*[F.lit(-1).cast("bigint").alias(x) for x in names], last.alias("_at"), F.lit(-1).cast("bigint").alias("_ident"), F.lit(0.0).alias("_measure")).write.parquet(ends)
    closing = spark.readStream.schema(spark.read.parquet(ends).schema).parquet(ends)
    joined = stream_nearest_in_time(side(left, 0), side(right, 1).unionByName(closing), names, "_at", ("_ident", "_ident"), tolerance, "0 seconds", span, "_measure")
    rows = os.path.join(folder, "rows")
    query = joined.writeStream.format("parquet").outputMode("append").option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start(rows)
    query.awaitTermination()
    return spark.read.schema(joined.schema).parquet(rows)
