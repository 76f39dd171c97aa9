"""Sequential hot-deck: missing values filled from the nearest record of the same group.

Records are sorted within their group; a missing value takes the nearest
previous or next observed one.  A group is cut into stretches of time, so that
one that holds a large part of the table is worked on by many tasks; what a
stretch hands to its neighbours is one donor per side.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import col, free_names, micros, missing


def hot_deck_fill(
    df: DataFrame,
    fields: Sequence[str],
    group: Sequence[str],
    time: str,
    tie: str,
    stretch_seconds: float = 600.0,
) -> DataFrame:
    """All rows and columns of ``df`` and, for each field, ``<f>_value`` (observed or filled), ``<f>_filled``
    (true where it was filled) and ``<f>_donor_gap`` (seconds to the donor, null where nothing was filled).

    The donor is the previous or next observed record of equal ``group`` values in order of ``time`` and ``tie``, whichever
    is nearer in time; of both equally near, the previous one.  The result is the same for every ``stretch_seconds``.
    Values count as missing if null or NaN.
    Rows with a null in a group column belong to no group: they give and take nothing.  Rows without time sort first
    and take the previous donor, else the next, with a null gap.  Groups without any observed value stay missing.
    Repeated rows are filled alike.  New columns whose names are taken get a number behind the name.
    """
    names = free_names([x for f in fields for x in (f"{f}_value", f"{f}_filled", f"{f}_donor_gap")], df.columns)
    at, part, grouped, *held = free_names(["_at", "_stretch", "_grouped", *[f"_{s}_{f}" for f in fields for s in ("own", "before", "after")]], df.columns + names)
    before_all, after_all = free_names(["_carry_before", "_carry_after"], df.columns + names + [at, part, grouped, *held])
    own = held[0::3]

    def with_donors(src: DataFrame) -> DataFrame:
        alive = F.lit(True)
        for g in group:
            alive = alive & col(g).isNotNull()
        t = micros(src, time)
        src = src.withColumns({at: t, grouped: alive}).withColumn(part, F.floor(F.col(at) / F.lit(int(stretch_seconds * 1e6))))
        return src.withColumns(
            {o: F.when(F.col(grouped) & ~missing(col(f), df.schema[f].dataType), F.struct(F.col(at).alias("t"), col(f).alias("v"))) for f, o in zip(fields, own)}
        )

    keys = [col(g) for g in group]
    rows = with_donors(df)
    # Both directions look back over their own order: a frame that ends at "unbounded following" would be read anew for every row.
    w = Window.partitionBy(*keys, F.col(part)).rowsBetween(Window.unboundedPreceding, 0)
    up, down = w.orderBy(F.col(at).asc_nulls_first(), col(tie).asc_nulls_first()), w.orderBy(F.col(at).desc_nulls_last(), col(tie).desc_nulls_last())
    rows = rows.withColumns({b: F.last(o, True).over(up) for o, b in zip(own, held[1::3])})
    rows = rows.withColumns({a: F.last(o, True).over(down) for o, a in zip(own, held[2::3])})

    # The first and last donor of each stretch, brought to the stretches around it.
    lean = with_donors(df.select(*dict.fromkeys([*group, *fields, time, tie]))).filter(F.col(grouped))
    n, keyed = len(fields), [F.col(f"_g{i}") for i in range(len(group))]
    place = _place(F.coalesce(F.col(at) - F.col(part) * F.lit(int(stretch_seconds * 1e6)), F.lit(0)), col(tie), df.schema[tie].dataType)
    lean = lean.select(
        *[col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(part).alias("_p"),
        *[F.when(F.col(o).isNotNull(), place).alias(f"_o{i}") for i, o in enumerate(own)],
        *[F.col(o)[x].alias(f"_{x}{i}") for i, o in enumerate(own) for x in ("t", "v")],
    )
    ends = lean.groupBy(*keyed, "_p").agg(
        *[agg(f"_t{i}").alias(f"_{end}_t{i}") for i in range(n) for end, agg in (("first", F.min), ("last", F.max))],
        *[agg(f"_v{i}", f"_o{i}").alias(f"_{end}_v{i}") for i in range(n) for end, agg in (("first", F.min_by), ("last", F.max_by))],
        *[F.count(f"_o{i}").alias(f"_n{i}") for i in range(n)],
    )
    over = Window.partitionBy(*keyed)
    donor = lambda end, i: F.when(F.col(f"_n{i}") > 0, F.struct(F.col(f"_{end}_t{i}").alias("t"), F.col(f"_{end}_v{i}").alias("v")))
    earlier = over.orderBy(F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    later = over.orderBy(F.col("_p").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keyed,
        "_p",
        F.struct(*[F.last(donor("last", i), True).over(earlier).alias(f"f{i}") for i in range(n)]).alias(before_all),
        F.struct(*[F.last(donor("first", i), True).over(later).alias(f"f{i}") for i in range(n)]).alias(after_all),
    )
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & (col(g) == F.col(f"_g{i}"))
    rows = rows.join(carry, same & F.col(part).eqNullSafe(F.col("_p")), "left")

    out = {}
    for i, f in enumerate(fields):
        value, filled, gap = names[3 * i : 3 * i + 3]
        b = F.coalesce(F.col(held[3 * i + 1]), F.col(f"{before_all}.f{i}"))
        a = F.coalesce(F.col(held[3 * i + 2]), F.col(f"{after_all}.f{i}"))
        to_b, to_a = F.col(at) - b["t"], a["t"] - F.col(at)
        nearer = F.when(b.isNull(), a).when(a.isNull(), b).when(to_a.isNotNull() & (to_b.isNull() | (to_a < to_b)), a).otherwise(b)
        gone = missing(col(f), df.schema[f].dataType) & F.col(grouped) & (b.isNotNull() | a.isNotNull())
        out |= {
            value: F.when(gone, nearer["v"]).otherwise(col(f)),
            filled: gone,
            gap: F.when(gone, F.abs(F.col(at) - nearer["t"]) / F.lit(1e6)),
        }
    return rows.select(*[col(c) for c in df.columns], *[v.alias(n) for n, v in out.items()])


def _place(offset: Column, tie: Column, kind: T.DataType) -> Column:
    """Order by ``offset`` (microseconds into a stretch) and ``tie``, nulls first: one decimal for integers, so that aggregates
    by it stay hash aggregates, and a struct for other types."""
    if not isinstance(kind, T.IntegralType):
        return F.struct(offset.alias("t"), tie.alias("tie"))
    wide = lambda v: v.cast("decimal(20,0)")
    low = F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)")
    return (wide(offset) * F.lit(Decimal(1 << 65)).cast("decimal(20,0)")).cast("decimal(38,0)") + (F.coalesce(wide(tie), low) - low)


def filled_cells(filled: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """One row (``key``, field) for each value that ``hot_deck_fill`` filled."""
    return filled.select(
        col(key), F.explode(F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in fields])).alias("field")
    ).filter("field is not null")
