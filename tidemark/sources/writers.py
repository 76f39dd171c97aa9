"""Writers.  Single-file exports are for small results; large ones go to Parquet."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_single_csv(df: DataFrame, path: str, sep: str = " ") -> None:
    """One file without header, replacing what was there."""
    df.coalesce(1).write.mode("overwrite").option("header", False).option("sep", sep).csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs by falling similarity, ties by their ids, separated by tabs."""
    pairs.select("id1", "id2", "similarity").orderBy(F.desc("similarity"), "id1", "id2").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, in folders by the values of some columns if given."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def result_line(*values) -> str:
    """A result for the console: values joined by commas behind a word."""
    return ",".join(["RESULT", *map(str, values)])


def binary_matrix(values: np.ndarray) -> bytes:
    """The content of a file that ``read_binary_matrix`` reads."""
    return struct.pack("<ii", *values.shape) + np.ascontiguousarray(values, "<f4").tobytes()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of some bytes, on any file system that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
