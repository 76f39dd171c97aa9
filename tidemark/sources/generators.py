"""Seeded generators: every row is a function of the seed and its number, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut
from ..operators.sorting import ranked

#: Fixed value: characters a near miss is made with.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def draw(below: Column | int, *key) -> Column:
    """A number from 0 on below a bound, by hashing the key."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(below) if isinstance(below, int) else below).cast("int")


def random_strings(spark: SparkSession, n: int, seed: int = 1, longest: int = 25) -> DataFrame:
    """``id`` and ``s``, lower-case letters, 1 to ``longest`` of them."""
    size = draw(longest, seed, F.col("id")) + 1
    letters = F.transform(F.sequence(F.lit(1), size), lambda i: F.char(draw(26, seed + 1, F.col("id"), i) + 97))
    return spark.range(n).select("id", F.array_join(letters, "").alias("s"))


def near_misses(names: DataFrame, name: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` different names (``fake``), each one of ``names`` (``real``) with a character replaced, two neighbours swapped, or one appended.

    Tries go on, four times as many each time, until there are ``n``; fewer come out only where four times the tries gave no
    new one.  A near miss may be a real name.
    """
    real = names.select(F.col(name).alias("r")).filter("r is not null and r != ''").distinct()
    numbered = cut(ranked(real, ["r"], "place"))
    count = numbered.count()
    tries, found = 4 * n, -1
    while True:
        made = _misses(numbered, count, tries, seed)
        now = made.limit(n).count()
        if now >= n or now == found:
            return made.orderBy("id").limit(n).select("fake", "real")
        tries, found = 4 * tries, now


def _misses(numbered: DataFrame, count: int, tries: int, seed: int) -> DataFrame:
    """The different near misses of so many tries, each with the number of the first try that made it."""
    ids = numbered.sparkSession.range(tries if count else 0)
    t = ids.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(count, 1))) + 1).join(numbered, "place")
    size = F.length("r")
    at, letter = draw(size, seed + 2, F.col("id")) + 1, F.substr(F.lit(LETTERS), draw(len(LETTERS), seed + 3, F.col("id")) + 1, F.lit(1))
    swap = draw(F.greatest(size - 1, F.lit(1)), seed + 4, F.col("id")) + 1
    part = lambda a, length: F.substr("r", a, length)
    replaced = F.concat(part(F.lit(1), at - 1), letter, part(at + 1, size))
    swapped = F.concat(part(F.lit(1), swap - 1), part(swap + 1, F.lit(1)), part(swap, F.lit(1)), part(swap + 2, size))
    kind = draw(3, seed + 1, F.col("id"))
    made = F.when(kind == 0, replaced).when((kind == 1) & (size > 1), swapped).otherwise(F.concat("r", letter))
    return t.select(made.alias("fake"), "id", F.col("r").alias("real")).groupBy("fake").agg(F.min("id").alias("id"), F.min_by("real", "id").alias("real"))
