import math
import random

import pytest

from tidemark.llm.nearest_time import nearest_in_time


def brute(left, right, tolerance):
    out = {}
    for i, k, t in left:
        c = [(abs(t - u), j) for j, q, u in right if t is not None and u is not None and t == t and u == u and k is not None and q == k and abs(t - u) <= tolerance]
        out[i] = min(c)[::-1] if c else (None, None)
    return out


def run(spark, left, right, tolerance=1.5, **kw):
    a = spark.createDataFrame(left, "lid bigint, k int, t double").repartition(3)
    b = spark.createDataFrame(right, "rid bigint, q int, t double").repartition(3)
    got = nearest_in_time(a, b, [("k", "q")], ("t", "t"), ("lid", "rid"), tolerance, **kw).collect()
    return {r.left_id: (r.right_id, r.gap) for r in got}


@pytest.mark.parametrize("span", [12.0, 60.0])
def test_against_brute_force(spark, span):
    rng = random.Random(4)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, math.nan, round(rng.uniform(-50, 200), 1)]) if i % 5 == 0 else round(rng.uniform(-50, 200), 1)) for i in range(400)]
    right = [(1000 + i, rng.choice([1, 1, 2, None]), None if i % 50 == 0 else round(rng.uniform(-50, 200), 1)) for i in range(300)]
    assert run(spark, left, right, span=span) == brute(left, right, 1.5)


def test_ties_and_empty(spark):
    assert run(spark, [(1, 1, 10.0)], [(9, 1, 11.0), (5, 1, 9.0), (4, 1, 11.0), (3, 2, 10.0)]) == {1: (4, 1.0)}
    assert run(spark, [(1, 1, 10.0)], []) == {1: (None, None)}
    assert run(spark, [], [(1, 1, 10.0)]) == {}


def test_small_batches_keep_state(spark):
    rng = random.Random(5)
    left = [(i, 1, round(rng.uniform(0, 30), 2)) for i in range(200)]
    right = [(1000 + i, 1, round(rng.uniform(0, 30), 2)) for i in range(200)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert run(spark, left, right) == brute(left, right, 1.5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
