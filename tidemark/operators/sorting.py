"""Sorting strings by bytes, with the passes of radix sorts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut
from ..functions.exprs import char_at


def ranked(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds each row's place in the order, from 1 on.

    The table is range-partitioned and sorted; a row's place is its place in its partition and the rows of the partitions
    before, whose counts are a table of as many rows as there are partitions.
    """
    done = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_m"), 33)
    counts = done.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("_p", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return done.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, at + F.col("_before")).drop("_m", "_p", "_before")


def byte_sort(df: DataFrame, value: str, ident: str) -> DataFrame:
    """``ident``, ``value`` and ``place`` in byte order, ties by ``ident``; nulls come last."""
    return ranked(df.select(ident, value), [F.col(value).asc_nulls_last(), F.col(ident)])


def char_histogram(df: DataFrame, value: str, place: int) -> DataFrame:
    """How often each character code stands at a place counted from 0 (-1: the string is shorter)."""
    return df.filter(F.col(value).isNotNull()).groupBy(char_at(F.col(value), place).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def count_sort_starts(df: DataFrame, value: str, place: int) -> DataFrame:
    """The histogram with ``start``, the number of strings with a smaller code: prefix sums over at most a few thousand codes."""
    h = char_histogram(df, value, place)
    return h.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))


def counting_pass(df: DataFrame, value: str, ident: str, place: int) -> DataFrame:
    """One stable pass of a least-significant-digit sort: the order by the character at a place, ties in the order before (``ident``)."""
    rows = df.filter(F.col(value).isNotNull()).select(ident, value, char_at(F.col(value), place).alias("code"))
    return ranked(rows, ["code", ident]).select(ident, "code", "place")
