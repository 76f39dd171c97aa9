import math
import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.hotdeck import filled_cells, hot_deck_fill

T0 = datetime(2030, 1, 1)
SCHEMA = "id bigint, g int, t timestamp_ntz, v double, v_value string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return hot_deck_fill(df, ["v"], ["g"], "t", "id", **kw)


def test_nearest_and_gap(spark):
    rows = [(1, 1, T0, 5.0, "x"), (2, 1, T0 + timedelta(seconds=3), None, "x"), (3, 1, T0 + timedelta(seconds=4), 7.0, "x"), (4, 1, T0 + timedelta(seconds=2), math.nan, "x")]
    got = {r.id: (r["v_value_1"], r.v_filled, r.v_donor_gap) for r in run(spark, rows).collect()}
    # The column v_value was there, so the new one has a number; at an equal distance the previous record is the donor.
    assert got == {1: (5.0, False, None), 2: (7.0, True, 1.0), 3: (7.0, False, None), 4: (5.0, True, 2.0)}


def test_no_donor_null_group_and_null_time(spark):
    rows = [(1, None, T0, None, ""), (2, None, T0, 3.0, ""), (3, 2, T0, None, ""), (4, 3, None, None, ""), (5, 3, T0, 4.0, ""), (5, 3, T0, 4.0, "")]
    got = [(r.id, r["v_value_1"], r.v_filled, r.v_donor_gap) for r in run(spark, rows).orderBy("id").collect()]
    assert got == [(1, None, False, None), (2, 3.0, False, None), (3, None, False, None), (4, 4.0, True, None), (5, 4.0, False, None), (5, 4.0, False, None)]


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_against_brute_force_over_many_stretches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), T0 + timedelta(seconds=rng.randrange(0, 4000)), float(i) if rng.random() < 0.1 else None, "") for i in range(600)]
    got = {r.id: (r["v_value_1"], r.v_donor_gap) for r in run(spark, rows, stretch_seconds=100).filter("v_filled").collect()}
    donors = {g: [(r[2], r[3]) for r in rows if r[1] == g and r[3] is not None] for g in (1, 2, 3)}
    for i, g, t, v, _ in rows:
        if v is None and donors[g]:
            best = min(abs((t - d).total_seconds()) for d, _ in donors[g])
            assert got[i][1] == best
            assert got[i][0] in {x for d, x in donors[g] if abs((t - d).total_seconds()) == best}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_the_donor_does_not_depend_on_the_stretches(spark, kind):
    # Donors of one instant at the edge of a stretch; 2**62 and beyond, negative and null ties.
    ties = [5, -3, 2**62, -(2**62), None, 17] if kind == "bigint" else ["b", "a", "ö", "", None, "c"]
    rows = [(None, x, 1, T0 + timedelta(seconds=s), float(10 * s + i)) for s in (0, 2999, 7000) for i, x in enumerate(ties)]
    rows += [(i, ties[0], 1, T0 + timedelta(seconds=s), None) for i, s in enumerate((1, 1499, 1500, 3000, 3001, 4999, 5001, 6999, 9000))]
    df = spark.createDataFrame(rows, f"row int, id {kind}, g int, t timestamp_ntz, v double").repartition(3)
    donors = sorted((r for r in rows if r[4] is not None), key=lambda r: (r[3], r[1] is not None, (r[1].encode() if kind == "string" else r[1]) if r[1] is not None else 0))
    want = {}
    for r in rows:
        if r[4] is None:
            before, after = [d for d in donors if d[3] < r[3]][-1:], [d for d in donors if d[3] > r[3]][:1]
            gap = lambda d, r=r: abs((d[3] - r[3]).total_seconds())
            want[r[0]] = (after if not before or (after and gap(after[0]) < gap(before[0])) else before)[0][4]
    for stretch in (1.0, 600.0, 1000.0, 2148.0, 1e6, 3e9):
        got = hot_deck_fill(df, ["v"], ["g"], "t", "id", stretch_seconds=stretch).filter("v_filled").collect()
        assert {r.row: r.v_value for r in got} == want, stretch


def test_cells(spark):
    rows = [(1, 1, T0, 5.0, ""), (2, 1, T0, None, "")]
    assert [tuple(r) for r in filled_cells(run(spark, rows), ["v"], "id").collect()] == [(2, "v")]
