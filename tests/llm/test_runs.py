import math
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from tidemark.llm.runs import collapse_runs

T0 = datetime(2030, 1, 1)


def brute(rows, min_count=3, gap=None):
    out, by = set(), {}
    for i, k, t, v in rows:
        if t is not None:
            by.setdefault(k, []).append((t, i, None if v is None or v != v else round(v * 100)))
    for k, events in by.items():
        events.sort()
        run = [events[0]]
        for e in [*events[1:], None]:
            if e is not None:
                a, b = run[-1][2], e[2]
                near = (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 5)
                if near and (gap is None or (e[0] - run[-1][0]).total_seconds() <= gap):
                    run.append(e)
                    continue
            if len(run) >= min_count:
                out.add((k, run[0][1], run[-1][1], len(run), (run[-1][0] - run[0][0]).total_seconds()))
            run = [e]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, k int, t timestamp_ntz, v double").repartition(3)
    got = collapse_runs(df, ["k"], "t", "id", "v", **kw).collect()
    return {(r.k, r.first_id, r.last_id, r.run_length, r.duration) for r in got}


@pytest.mark.parametrize("batch", [1, 5, 10000])
@pytest.mark.parametrize("width", [1, 4, 13])
def test_against_brute_force_over_ranges(spark, batch, width):
    rng = random.Random(batch * 100 + width)
    rows, v = [], 10.0
    for i in range(500):
        if rng.random() < 0.3:
            v = rng.choice([None, math.nan, round(rng.uniform(0, 24), 2), 10.0, 10.05, 10.1])
        rows.append((i, rng.choice([None, 1]) if i % 2 else 7, T0 + timedelta(milliseconds=400 * (i // 2)), v))
    rng.shuffle(rows)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert run(spark, rows) == brute(rows)
        assert run(spark, rows, min_count=2, max_gap_seconds=0.5) == brute(rows, 2, 0.5)
    finally:
        for k, x in keep.items():
            spark.conf.set(k, x)


def test_one_run_over_all_ranges_and_none(spark):
    rows = [(i, 1, T0 + timedelta(seconds=i), 3.0) for i in range(300)]
    assert run(spark, rows) == {(1, 0, 299, 300, 299.0)}
    assert run(spark, []) == set()
    assert run(spark, [(1, 1, None, 3.0)] * 5) == set()
    assert run(spark, [(1, 1, T0, 3.0)] * 3) == {(1, 1, 1, 3, 0.0)}


def _events(n, seed):
    rng, rows, v = random.Random(seed), [], 10.0
    for i in range(n):
        if rng.random() < 0.15:
            v = rng.choice([None, math.nan, round(rng.uniform(0, 24), 2), 10.0, 10.05])
        # A third of all rows are one entity's.
        rows.append((i, 7 if i % 3 == 0 else rng.randrange(5), T0 + timedelta(milliseconds=400 * (i // 2)), v))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, reuse", [(3, "false"), (16, "true"), (16, "false"), (200, "false")])
def test_no_run_is_lost_or_doubled_whether_exchanges_are_reused(spark, width, reuse):
    rows = _events(3000, width)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        df = spark.createDataFrame(rows, "id bigint, k int, t timestamp_ntz, v double").repartition(9)
        got = [(r.k, r.first_id, r.last_id, r.run_length, r.duration) for r in collapse_runs(df, ["k"], "t", "id", "v").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    finally:
        for k, x in keep.items():
            spark.conf.set(k, x)


KILLED = """
import os, sys
sys.path[:0] = [{root!r}, {root!r} + "/tests/llm", {root!r} + "/tests"]
from pyspark import TaskContext
from pyspark.sql import SparkSession
import tidemark
import test_runs as T
from tidemark.llm import runs as R

class Dying(R.RunMachine):
    def finish(self):
        # The worker of every third task dies in its first attempt, after it gave part of its rows.
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 3 == 1:
            os._exit(1)
        return super().finish()

R.RunMachine = Dying
spark = (SparkSession.builder.master("local[4, 4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16")
         .config("spark.sql.exchange.reuse", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
rows = T._events(3000, 1)
df = spark.createDataFrame(rows, "id bigint, k int, t timestamp_ntz, v double").repartition(9)
got = [(r.k, r.first_id, r.last_id, r.run_length, r.duration) for r in R.collapse_runs(df, ["k"], "t", "id", "v").collect()]
assert len(got) == len(set(got)) and set(got) == T.brute(rows), (len(got), len(T.brute(rows)))
print("whole", len(got))
"""


def test_killed_tasks_lose_and_double_nothing():
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=root)], capture_output=True, text=True, timeout=300)
    assert "whole" in done.stdout, done.stderr[-3000:]
    assert "Lost task" in done.stderr
