"""Ordered records cut into segments, with steps, moving averages, zones and runs.

All windows of a pipeline share one hash partitioning: later ones only add keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import euclid, metres, sound, zone

#: Who moves where: the keys of one player's path, and the order along it.
PATH = ("player_id", "quarter", "game_id")
ORDER = ("recorded_at", "moment_id")
SAME = (*PATH, "x", "y", "game_clock", "shot_clock")


def positions(moments: DataFrame) -> DataFrame:
    """Typed positions in metres; NaN counts as missing."""
    return moments.select(
        "moment_id",
        "player_id",
        "quarter",
        "game_id",
        "event_id",
        "recorded_at",
        metres(F.col("x_loc")).alias("x"),
        metres(F.col("y_loc")).alias("y"),
        sound(F.col("game_clock")).alias("game_clock"),
        sound(F.col("shot_clock")).alias("shot_clock"),
    )


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """Of rows with equal ``keys`` (null equals null) the first by ``order``.

    With ``shared``, a part of the keys, rows are partitioned by these alone, which later windows over them use again.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if shared:
        df = df.repartition(*shared)
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in (*order, *rest)])


def lag_or_self(value: Column, window) -> Column:
    """The value of the row before, or the row's own."""
    return F.coalesce(F.lag(value).over(window), value)


def gap_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str, threshold: float = 15.0, rising_edge: bool = True, name: str = "segment"
) -> DataFrame:
    """Adds the number of gaps so far: a gap is a jump of the clock by more than ``threshold``.

    With ``rising_edge`` a jump right after a jump doesn't count, nor does one on the first row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_jump", F.when(F.abs(F.col(clock) - lag_or_self(F.col(clock), w)) > threshold, 1).otherwise(0))
    starts = F.when((F.col("_jump") == 1) & (F.lag("_jump").over(w) == 0), 1).otherwise(0) if rising_edge else F.col("_jump")
    df = df.withColumn("_starts", starts)
    return df.withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump", "_starts")


def step_distance(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "step") -> DataFrame:
    """Adds the distance from the row before of the same segment; 0 where there is none, null where the row itself has no place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    px, py = F.lag("x").over(w), F.lag("y").over(w)
    return df.withColumns({"_px": px, "_py": py}).withColumn(
        name, F.when(F.col("_px").isNull() | F.col("_py").isNull(), F.lit(0.0)).otherwise(euclid(F.col("x"), F.col("y"), F.col("_px"), F.col("_py")))
    ).drop("_px", "_py")


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 10, name: str = "moving_avg") -> DataFrame:
    """Adds the average of the last ``rows`` rows; missing values count as absent."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)))


def zone_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "run_id") -> DataFrame:
    """Adds the number of changes of ``zone`` so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag("zone").over(w) != F.col("zone"), 1).otherwise(0)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def paths(moments: DataFrame, strict: bool = False) -> DataFrame:
    """Player positions without repeats, with segment and step."""
    p = positions(moments.filter("player_id != -1"))
    p = dedupe_keep_first(p, SAME, ORDER, shared=PATH)
    p = gap_segments(p, PATH, ORDER, "game_clock", rising_edge=not strict)
    return step_distance(p, (*PATH, "segment"), ORDER)


def zoned_paths(moments: DataFrame, strict: bool = False, rate: float = 25.0, most: float = 12.0) -> DataFrame:
    """``paths`` with the moving average of speeds up to ``most``, the zone and the run."""
    p = paths(moments, strict).withColumn("speed", F.col("step") * rate)
    p = p.withColumn("speed", F.when(F.col("speed") <= most, F.col("speed")))
    keys = (*PATH, "segment")
    p = moving_average(p, keys, ORDER, "speed").withColumn("zone", zone(F.col("moving_avg")))
    return zone_runs(p, keys, ORDER)
