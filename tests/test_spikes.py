import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators.spikes import ClockModel, flagged_cells, judge_frames, spike_flags

FIELDS = ["game_clock", "shot_clock"]


def clocks(n=120, dt=0.4, stop=(), reset=None, seed=1, sd=0.03):
    """Two clocks of one stretch: they stand still in the frames ``stop``; the shot clock is set to 24 at a frame."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) * dt
    g, s, run = np.zeros(n), np.zeros(n), 0.0
    left = 20.0
    for i in range(n):
        if i and not (stop and stop[0] <= i < stop[1]):
            run += dt
            left -= dt
        if reset == i:
            left = 24.0
        g[i], s[i] = 600 - run, left
    if not stop:
        g, s = g + rng.normal(0, sd, n), s + rng.normal(0, sd, n)
    return t, np.round(g, 2), np.round(np.clip(s, 0, 24), 2)


def judge(t, g, s):
    spikes, stuck = judge_frames(t, [g, s], [0.05, 0.05], FIELDS, ClockModel())
    return [list(np.flatnonzero(x)) for x in (*spikes, *stuck)]


def test_clean_dead_ball_and_reset():
    assert judge(*clocks(n=45)) == [[], [], [], []]
    assert judge(*clocks(n=45, stop=(10, 25))) == [[], [], [], []]
    assert judge(*clocks(n=60, reset=30)) == [[], [], [], []]


@pytest.mark.parametrize("at", [0, 1, 10, 20, 43, 44])
@pytest.mark.parametrize("off", [-3.0, 2.5])
def test_spikes(at, off):
    t, g, s = clocks(n=45)
    g[at] += off
    assert judge(t, g, s) == [[at], [], [], []]


def test_two_frames_and_both_clocks():
    t, g, s = clocks(n=45)
    g[10:12] += 2.0
    s[20] += 3.0
    assert judge(t, g, s) == [[10, 11], [20], [], []]


def test_spike_beside_a_reset():
    t, g, s = clocks(n=60, reset=30)
    s[32] -= 4.0
    assert judge(t, g, s) == [[], [32], [], []]


def test_stuck():
    t, g, s = clocks(n=45)
    s[15:26] = s[14]
    assert judge(t, g, s) == [[], [], [], list(range(15, 26))]
    t, g, s = clocks(n=45)
    g[15:20] = g[14]  # two seconds only
    assert judge(t, g, s)[2] == []


def test_rows(spark):
    t0 = datetime(2030, 1, 1)
    t, g, s = clocks(n=40)
    g[12] += 3.0
    rows = []
    for i in range(40):
        for p in range(4):
            rows.append([len(rows), 7, 1, t0 + timedelta(seconds=float(t[i])), float(g[i]), float(s[i])])
    rows[20][5] = -1.0  # one row of a frame
    rows[33][4] += 5.0
    rows[45][4] = None
    rows[46][5] = math.nan
    rows += [[1000, None, 1, t0, 800.0, 3.0], [1001, 7, 1, None, 5.0, 30.0]]
    schema = "moment_id bigint, game_id int, quarter int, recorded_at timestamp_ntz, game_clock double, shot_clock double"
    df = spark.createDataFrame([tuple(r) for r in rows], schema).repartition(3)
    got = {(r.moment_id, r.field): r.fault for r in flagged_cells(spike_flags(df), FIELDS, "moment_id").collect()}
    want = {(i, "game_clock"): "spike" for i in range(48, 52)}
    want |= {(20, "shot_clock"): "range", (33, "game_clock"): "row", (1000, "game_clock"): "range", (1001, "shot_clock"): "range"}
    assert got == want
    clash = df.withColumn("game_clock_fault", df.quarter)
    assert "game_clock_fault_1" in spike_flags(clash).columns
    assert spike_flags(df.limit(0)).count() == 0
