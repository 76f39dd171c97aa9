"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_1``, ``name_2`` ... if a column of that name (in any case) is there already."""
    low = {t.lower() for t in taken}
    if name.lower() not in low:
        return name
    i = 1
    while f"{name}_{i}".lower() in low:
        i += 1
    return f"{name}_{i}"


def free_names(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """``free_name`` for several names, which stay different from one another."""
    out: list[str] = []
    taken = list(taken)
    for n in names:
        out.append(free_name(n, taken + out))
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing(c: Column, kind: T.DataType) -> Column:
    """True for null, and for NaN where the type has it."""
    return (c.isNull() | F.isnan(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def present(c: Column, kind: T.DataType) -> Column:
    """The value, or null where it is missing."""
    return F.when(~missing(c, kind), c)


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp (with or without zone) as microseconds, a number of seconds times a million, as bigint."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
            return F.unix_micros(col(name).cast("timestamp"))  # exact without daylight saving, and much cheaper than the difference
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(name))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name))
    return F.round(col(name).cast("double") * 1e6).cast("bigint")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).  A temporary one is made only where none is set and
    driver and executors are one machine, as in tests; elsewhere that would lose rows, so it is an error."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not told and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not told:
            told = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, told, ignore_errors=True)
        sc.setCheckpointDir(told)
    return told or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit repartition: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Plans of these nodes only have as many partitions as their files or stored pieces, which takes no job to tell.
NARROW = {"Project", "Filter", "LogicalRelation", "Relation", "LogicalRDD", "LocalRelation", "RelationV2", "DataSourceV2ScanRelation", "SubqueryAlias"}


def _nodes(plan) -> Iterable[str]:
    yield plan.nodeName().split(" ")[0]
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, dealt out to all; others, as any large one, are left as they are.

    For kernels that spend far more on a row than its shuffle costs.  Runs no job.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    if not NARROW.issuperset(_nodes(df._jdf.queryExecution().optimizedPlan())):
        return df
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
