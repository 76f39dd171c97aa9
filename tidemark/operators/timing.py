"""How long operators take: mean and spread over repeated runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.generators import random_strings
from . import matrix, sorting


def works(spark: SparkSession, size: int, blocks: Sequence[int] = (10,)) -> dict[str, Callable[[], DataFrame]]:
    """Rotations of a matrix of ``size`` rows and columns, whole and by blocks, a sort of ``size`` strings, whole and by one
    character, and the search of a row's nearest among ``size`` others."""
    cells = matrix.sequential(spark, size).withColumn("matrix_name", F.lit("m"))
    high = spark.createDataFrame([("m", size)], "matrix_name string, height int")
    strings = random_strings(spark, size)
    rows = cells.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: x["v"].cast("float")).alias("vec")).withColumnRenamed("i", "id")
    return {
        "rotate": lambda: matrix.rotate90(cells, high),
        **{f"rotate-blocked {b}": lambda b=b: matrix.rotate90_blocked(cells, high, b) for b in blocks},
        "sort": lambda: sorting.byte_sort(strings, "s", "id"),
        "sort-pass": lambda: sorting.counting_pass(strings, "s", "id", 0),
        "nearest": lambda: matrix.nearest_rows(rows.filter("id = 0"), rows, "id", "vec", size),
    }


def time_runs(spark: SparkSession, work: dict[str, Callable[[], DataFrame]], repeats: int) -> DataFrame:
    """``work``, ``repeats``, ``rows`` that came out, and the ``mean`` and ``spread`` (of the whole, not a sample) of the
    seconds, after one run that isn't counted."""
    took, rows = [], []
    for name, run in work.items():
        rows.append((name, run().count()))
        for _ in range(repeats):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            took.append((name, time.perf_counter() - start))
    times = spark.createDataFrame(took, "work string, s double").groupBy("work").agg(F.count(F.lit(1)).alias("repeats"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("spread"))
    return spark.createDataFrame(rows, "work string, rows bigint").join(times, "work").select("work", "repeats", "rows", "mean", "spread")
