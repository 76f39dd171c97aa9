"""Readers.  Every path may be a file, a folder or a glob on any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV with a header, all columns as strings; columns are taken by their place, so no job reads the header first."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("header", True).option("sep", sep).option("enforceSchema", True).schema(schema).csv(path)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The named columns cast leniently: what doesn't cast becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def in_file_order(lines: DataFrame) -> list[Column]:
    """The order of a scan's rows in their files: by file, block and place in the block; the scan mustn't be shuffled before."""
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def first_lines(spark: SparkSession, path: str, n: int, name: str = "value") -> DataFrame:
    """The first ``n`` lines, by their place in the files: ``place`` (from 1 on) and the line."""
    lines = spark.read.text(path)
    file, block, at = in_file_order(lines)
    top = lines.select(file.alias("_f"), block.alias("_b"), at.alias("_m"), "value").orderBy("_f", "_b", "_m").limit(n)
    return top.select(F.row_number().over(Window.orderBy("_f", "_b", "_m")).cast("bigint").alias("place"), F.col("value").alias(name))


def read_tsv_documents(spark: SparkSession, path: str, strict: bool = True, first: int | None = None) -> DataFrame:
    """Tab-separated lines without header or quoting: the second field is ``doc_id``, the third ``text``.

    Lines with fewer fields, or whose second isn't a number, fail the query; without ``strict`` they are left out.
    With ``first``, that many lines from the beginning are read.
    """
    parts = F.split(F.col("value"), "\t", -1)
    ident = F.get(parts, F.lit(1)).try_cast("bigint")
    good = (F.size(parts) >= 3) & ident.isNotNull()
    lines = spark.read.text(path) if first is None else first_lines(spark, path, first)
    if strict:
        ident = F.when(good, ident).otherwise(F.raise_error(F.concat(F.lit("not a document line: "), F.substring("value", 1, 80))).cast("bigint"))
    else:
        lines = lines.filter(good)
    return lines.select(ident.alias("doc_id"), F.get(parts, F.lit(2)).alias("text"))


def read_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One row per line."""
    return spark.read.text(path).select(F.col("value").alias(name))


def read_text_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of numbers separated by blanks, a line per matrix row, as cells: ``file``, ``i``, ``j``, ``v`` (null for what is no number).

    A file is one matrix, read whole: lines have no order otherwise.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("i", "line"))
    cells = lines.select("file", "i", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "t")).filter("t != ''")
    return cells.select("file", "i", "j", F.col("t").try_cast("double").alias("v"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a size and a file name: ``n``, ``file``; blank lines are left out."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter("trim(value) != ''").select(F.get(parts, F.lit(0)).try_cast("int").alias("n"), F.get(parts, F.lit(1)).alias("file"))


def read_listed_matrices(spark: SparkSession, manifest: str) -> DataFrame:
    """The square text matrices that a manifest lists, whose files lie beside it: ``n``, ``file``, ``i``, ``j``, ``v``.

    Cells outside n by n are left out; a file that isn't listed is not read.
    """
    listed = read_manifest(spark, manifest).filter("n is not null and file is not null")
    folder = manifest.rsplit("/", 1)[0]
    files = [r["file"] for r in listed.select("file").distinct().toLocalIterator()]  # a list of names, kept by hand
    if not files:
        return spark.createDataFrame([], "n int, file string, i int, j int, v double")
    cells = read_text_matrix(spark, [f"{folder}/{f}" for f in files]).withColumn("file", F.substring_index("file", "/", -1))
    named = listed.withColumn("base", F.substring_index("file", "/", -1))
    return cells.join(F.broadcast(named.select("n", "base")), F.col("file") == F.col("base")).filter("i < n and j < n").select("n", "file", "i", "j", "v")


def read_binary_matrix(spark: SparkSession, path: str, by_columns: bool = False) -> DataFrame:
    """Little-endian files of two int32 (rows, columns) and float32 values row by row: ``file``, ``row_no``, ``vec_``.

    With ``by_columns`` the columns come out as rows.  A file shorter than it says fails the query.
    """

    def kernel(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows, cols = (int(x) for x in np.frombuffer(content[:8], "<i4"))
                values = np.frombuffer(content, "<f4", count=rows * cols, offset=8).reshape(rows, cols)
                values = values.T if by_columns else values
                yield pd.DataFrame({"file": name, "row_no": np.arange(len(values), dtype=np.int32), "vec_": [v.tolist() for v in values]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, "file string, row_no int, vec_ array<float>")


def literals(spark: SparkSession, values: Sequence, name: str, kind: str = "string") -> DataFrame:
    """A table of a few given values."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
