"""Implausible readings of count-down clocks, judged by a Kalman filter per source.

The rows of one instant share a frame, so a frame's reading is what most of its
rows show; a row that shows something else is off by itself.  Frames are small
in number next to rows: they alone pass through the filter, in overlapping
stretches of time of one source, and what they show comes back to the rows by
one equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import col, free_names, micros, present


@dataclass(frozen=True)
class ClockModel:
    """What is known of the clocks: ``limits`` by field, and the values a clock may be set to anew (``resets``)."""

    limits: dict[str, tuple[float, float]] = field(default_factory=lambda: {"game_clock": (0.0, 720.0), "shot_clock": (0.0, 24.0)})
    resets: dict[str, tuple[float, ...]] = field(default_factory=lambda: {"shot_clock": (14.0, 24.0)})
    threshold: float = 6.0  # standardised innovations beyond this are spikes
    spike_frames: int = 2  # a spike lasts that many frames at most; what stays longer is a new level
    stuck_seconds: float = 3.0
    gap_seconds: float = 5.0  # a longer silence starts the filter anew
    least_spread: float = 0.02  # of a clock's readings, in its own unit
    clock_speed: float = 1.0  # units a second while the clock runs
    drift: float = 0.1  # variance that a frame adds to what is known of a clock, as a share of that of its readings
    still: float = 0.005  # innovations of a clock that shows the same again are below this
    stretch_seconds: float = 1800.0
    overlap_seconds: float = 30.0


def _resolution(z: np.ndarray) -> float:
    """The step of a clock's display: 1, 0.1 or 0.01."""
    z = z[np.isfinite(z)]
    for step in (1.0, 0.1):
        if len(z) and np.mean(np.abs(z / step - np.round(z / step)) < 0.001 / step) > 0.95:
            return step
    return 0.01


def _stuck(t: np.ndarray, z: np.ndarray, other: np.ndarray, m: ClockModel, limit: tuple[float, float]) -> np.ndarray:
    """Frames in which the innovations of ``z`` vanish under a filter that takes the clock to stand still, while those of ``other`` don't.

    Under that filter the prediction is the reading before, so the innovation is the difference of neighbouring readings.
    """
    out = np.zeros(len(t), bool)
    at = np.flatnonzero(np.isfinite(z))
    if len(at) < 3:
        return out
    v = np.round(z[at], 2)
    e = np.diff(v, prepend=np.nan)
    squares = np.r_[0.0, np.cumsum(np.where(np.isfinite(e), e * e, 0.0))]
    # Windows of the stuck time that end at each reading: the sum of squared innovations behind their first one.
    begin = np.searchsorted(t[at], t[at] - m.stuck_seconds + 1e-6, side="right") - 1
    vanished = (begin >= 0) & (squares[1:] - squares[np.maximum(begin, 0) + 1] < m.still**2)
    quiet = np.abs(e) < m.still
    starts = np.flatnonzero(~quiet)
    ends = np.r_[starts[1:], len(at)] - 1
    for a, b in zip(starts, ends):
        if not vanished[a : b + 1].any() or not limit[0] <= v[a] <= limit[1]:
            continue
        i, j = at[a], at[b]
        there = i + np.flatnonzero(np.isfinite(other[i : j + 1]))
        if len(there) < 2:
            continue
        # The part of the stretch in which the other clock's innovations don't vanish; still ends of more than a coarse step are a dead ball.
        drop = -np.diff(np.round(other[there], 2))
        moved = np.flatnonzero(drop > m.still)
        if not len(moved):
            continue
        first, last = there[moved[0]], there[moved[-1] + 1]
        first = i if t[first] - t[i] < 1.5 else first
        last = j if t[j] - t[last] < 1.5 else last
        span = t[last] - t[first]
        step = t[there[1:]] - t[there[:-1]]
        ran = np.minimum(np.maximum(drop, 0), np.maximum(1.5, 2 * step) * m.clock_speed).sum()
        if span >= m.stuck_seconds - 1e-6 and ran >= 0.5 * span * m.clock_speed:
            out[i : j + 1] |= np.isfinite(z[i : j + 1]) & (t[i : j + 1] > t[first]) & (t[i : j + 1] <= t[last])
    return out


class _Filter:
    """One pass over the frames of one unbroken stretch; ``sign`` is -1 forward in time, and 1 for the pass back."""

    def __init__(self, model: ClockModel, spread: list[float], steps: list[float], resets: list[tuple[float, ...]]):
        self.m, self.r, self.steps, self.resets = model, [s * s for s in spread], steps, resets

    def run(self, t: list[float], z: list[list[float]], held: list[list[bool]], back: bool = False) -> list[list[bool]]:
        """Flags by clock.  ``z``: readings by clock, NaN if missing; ``held``: readings that update nothing.

        All clocks run and stand still together.  At each frame the part of the time that they ran is the one that suits
        their readings best; it moves every clock's state on, that of a missing or withheld reading too.
        """
        m, n, clocks = self.m, len(t), range(len(z))
        flags = [[False] * n for _ in clocks]
        x: list[float | None] = [None for _ in clocks]
        p = [0.0 for _ in clocks]
        waiting: list[list[int]] = [[] for _ in clocks]
        sign, limit, share = (1.0 if back else -1.0), m.threshold * m.threshold, 1.0
        for i in range(n):
            dt = abs(t[i] - t[i - 1]) * m.clock_speed if i else 0.0
            here = [c for c in clocks if z[c][i] == z[c][i] and not held[c][i]]
            known = [c for c in here if x[c] is not None]
            if known and dt > 0:
                tries = [(1.0, 0.0), (0.0, 0.0)] + [(min(1.0, max(0.0, sign * (z[c][i] - x[c]) / dt)), 1.0) for c in known]
                best, last = None, share
                for s, cost in tries:
                    cost += 2.0 * abs(s - last)
                    for c in known:
                        e = z[c][i] - (x[c] + sign * s * dt)
                        # A clock that may just have been set anew says less of whether the clocks run.
                        cost += min(e * e / (p[c] + self.r[c]), 0.4 * limit if self._at_reset(c, z[c][i]) else limit)
                    if best is None or cost < best:
                        best, share = cost, s
            for c in clocks:
                if x[c] is not None:
                    x[c] += sign * share * dt
                    # Where no clock tells whether it ran, any part of the time is as likely.
                    p[c] += m.drift * self.r[c] + (0.0 if known else dt * dt / 12)
            for c in here:
                if x[c] is None:
                    x[c], p[c] = z[c][i], self.r[c]
                    continue
                e = z[c][i] - x[c]
                if e * e <= limit * (p[c] + self.r[c]):
                    gain = p[c] / (p[c] + self.r[c])
                    x[c], p[c] = x[c] + gain * e, (1 - gain) * p[c]
                    waiting[c] = []
                    continue
                flags[c][i] = True
                waiting[c].append(i)
                level = self._new_level(c, waiting[c], t, z[c], back, last=i == n - 1)
                if level:
                    for j in level:
                        flags[c][j] = False
                    x[c], p[c] = z[c][i], self.r[c]
                    waiting[c] = []
        return flags

    def _agree(self, c: int, t: list[float], z: list[float], i: int, j: int) -> bool:
        """Whether two readings can be of one clock that ran some part of the time between them."""
        slack = self.m.threshold * (2 * self.r[c]) ** 0.5
        a, b = (i, j) if t[i] <= t[j] else (j, i)
        return -slack - self.m.clock_speed * (t[b] - t[a]) <= z[b] - z[a] <= slack

    def _at_reset(self, c: int, v: float) -> bool:
        return any(-(self.steps[c] + 1.0) <= v - r <= 4 * self.r[c] ** 0.5 for r in self.resets[c])

    def _new_level(self, c: int, w: list[int], t: list[float], z: list[float], back: bool, last: bool) -> list[int]:
        """The waiting frames that make up a new level: more of them in agreement than a spike has, or fewer at a value the clock is set to."""
        enough = len(w) > self.m.spike_frames
        parts = [[w[0]]]
        for j in w[1:]:
            if self._agree(c, t, z, parts[-1][-1], j):
                parts[-1].append(j)
            else:
                parts.append([j])
        # Set anew once or more, each time to a value it is set to.
        if not back and (enough or last) and all(self._at_reset(c, z[part[0]]) for part in parts):
            return w
        level = [j for j in w if self._agree(c, t, z, j, w[-1])]
        if len(level) > self.m.spike_frames:
            return level
        return level if last and not back and self._at_reset(c, z[level[0]]) else []


def _first_sound(f: _Filter, c: int, t: list[float], z: list[float]) -> int | None:
    """The first frame that agrees with most of the next few."""
    there = [i for i in range(len(t)) if z[i] == z[i]][:12]
    for k, i in enumerate(there):
        ahead = there[k + 1 : k + 6]
        if not ahead or 2 * sum(f._agree(c, t, z, i, j) for j in ahead) > len(ahead) or len(ahead) < 2:
            return i
    return there[0] if there else None


def judge_frames(t: np.ndarray, z: list[np.ndarray], spread: Sequence[float], fields: Sequence[str], m: ClockModel) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spike and stuck flags by clock, for frames of one source in order of time (seconds)."""
    n = len(t)
    spikes, stuck = [np.zeros(n, bool) for _ in z], [np.zeros(n, bool) for _ in z]
    cuts = np.r_[0, 1 + np.flatnonzero(np.diff(t) > m.gap_seconds), n]
    steps = [_resolution(v) for v in z]
    for a, b in zip(cuts[:-1], cuts[1:]):
        tt, part = t[a:b], [np.where((v[a:b] >= m.limits[f][0]) & (v[a:b] <= m.limits[f][1]), v[a:b], np.nan) for v, f in zip(z, fields)]
        raw = [v[a:b] for v in z]
        for c, f in enumerate(fields):
            for o in range(len(z)):
                if o != c:
                    stuck[c][a:b] |= _stuck(tt, raw[c], part[o], m, m.limits[f])
        filt = _Filter(m, list(spread), steps, [m.resets.get(f, ()) for f in fields])
        tl, zl = tt.tolist(), [v.tolist() for v in part]
        held = [stuck[c][a:b].tolist() for c in range(len(z))]
        begin = [_first_sound(filt, c, tl, zl[c]) for c in range(len(z))]
        early = [[i < (begin[c] or 0) for i in range(b - a)] for c in range(len(z))]
        forward = filt.run(tl, zl, [[h or e for h, e in zip(held[c], early[c])] for c in range(len(z))])
        for c in range(len(z)):
            spikes[c][a:b] |= np.array(forward[c], bool)
        if any(begin):
            upto = max(x or 0 for x in begin) + 6
            back = filt.run(tl[:upto][::-1], [v[:upto][::-1] for v in zl], [h[:upto][::-1] for h in held], back=True)
            for c in range(len(z)):
                for i in range(min(upto, b - a)):
                    if early[c][i] and back[c][min(upto, b - a) - 1 - i]:
                        spikes[c][a + i] = True
    return spikes, stuck


def spike_flags(
    df: DataFrame,
    source: str = "game_id",
    part: str = "quarter",
    time: str = "recorded_at",
    model: ClockModel = ClockModel(),
) -> DataFrame:
    """All rows and columns of ``df`` and, for each clock, ``<f>_fault``: null for a reading that is plausible or
    missing, else ``range``, ``spike``, ``stuck`` or ``row`` (it differs from what the other rows of its frame show).

    ``range``: outside the clock's limits.  ``spike``: the frame's innovation, standardised by the filter's variance
    with the source's own spread of readings, is beyond the threshold for one or two frames; such readings update
    nothing.  A level that stays, or a shot clock set to 14 or 24, is no spike.  ``stuck``: for three seconds or more
    the innovations of one clock vanish under a filter that takes it to stand still, while those of the other don't; the
    first frame isn't marked.  ``row``: the rows of a frame copy one reading, so their spread about it is none and any difference is a fault.
    Copies of a wrong row are marked like it.  Null and NaN readings are never marked.  Rows with a null in ``source``,
    ``part`` or ``time`` belong to no frame and are judged by range only; an empty table gives none.
    New columns whose names are taken get a number behind the name.
    """
    fields = list(model.limits)
    names = free_names([f"{f}_fault" for f in fields], df.columns)
    frames = _frames(df, fields, source, part, time, model)
    verdict = _verdicts(frames, fields, model)
    named = df.select("*", micros(df, time).alias(tmp := free_names(["_at"], df.columns)[0]))
    joined = named.join(
        verdict, (col(source) == F.col("_source")) & (col(part) == F.col("_part")) & (F.col(tmp) == F.col("_t")), "left"
    )
    out = []
    for i, f in enumerate(fields):
        v, (low, high) = present(col(f), df.schema[f].dataType), model.limits[f]
        same = F.abs(v - F.col(f"_z{i}")) < 0.005
        out.append(
            F.when(v.isNull(), None)
            .when((v < low) | (v > high), "range")
            .when(same & F.col(f"_stuck{i}"), "stuck")
            .when(same & F.col(f"_spike{i}"), "spike")
            .when(~same & (F.col(f"_n{i}") > 1), "row")
        )
    return joined.select(*[col(c) for c in df.columns], *[o.cast("string").alias(n) for o, n in zip(out, names)])


def _frames(df: DataFrame, fields: list[str], source: str, part: str, time: str, m: ClockModel) -> DataFrame:
    """One row per frame: what most of its rows show, for each clock, and how many show it."""
    rows = df.select(
        col(source).alias("_source"), col(part).alias("_part"), micros(df, time).alias("_t"), *[present(col(f), df.schema[f].dataType).cast("double").alias(f"_v{i}") for i, f in enumerate(fields)]
    ).filter("_source is not null and _part is not null and _t is not null")
    vs = [f"_v{i}" for i in range(len(fields))]
    shown = rows.groupBy("_source", "_part", "_t", *vs).agg(F.count(F.lit(1)).alias("_k"))
    # Of readings shown equally often, the smaller; the order is a number, so that the aggregate stays a hash aggregate.
    agg = []
    for i, v in enumerate(vs):
        low, high = m.limits[fields[i]]
        sound = (F.col(v) >= low) & (F.col(v) <= high)
        rank = F.col("_k").cast("double") + F.when(sound, 0.5 - F.col(v) / (4 * high)).otherwise(0.0)
        rank = F.when(F.col(v).isNotNull(), rank)
        agg += [F.max_by(v, rank).alias(f"_z{i}"), F.max(F.when(F.col(v).isNotNull(), F.col("_k"))).alias(f"_n{i}")]
    return shown.groupBy("_source", "_part", "_t").agg(*agg)


def _spread(frames: DataFrame, fields: list[str], m: ClockModel) -> DataFrame:
    """The usual spread of each source's readings about a running clock, from pairs of neighbouring frames."""
    bucket = F.floor(F.col("_t") / F.lit(int(m.stretch_seconds * 1e6)))
    w = Window.partitionBy("_source", "_part", "_bucket").orderBy("_t")
    dt = (F.col("_t") - F.lag("_t").over(w)) / 1e6
    moved: list[Column] = []
    for i in range(len(fields)):
        fall = F.lag(f"_z{i}").over(w) - F.col(f"_z{i}")
        moved.append(F.when((dt < m.gap_seconds) & (F.abs(fall - dt * m.clock_speed) < 2.0) & (fall != 0), F.abs(fall - dt * m.clock_speed)).alias(f"_d{i}"))
    return (
        frames.withColumn("_bucket", bucket)
        .select("_source", *moved)
        .groupBy("_source")
        .agg(*[F.coalesce(F.percentile_approx(f"_d{i}", 0.5, 1000), F.lit(0.0)).alias(f"_s{i}") for i in range(len(fields))])
    )


def _verdicts(frames: DataFrame, fields: list[str], m: ClockModel) -> DataFrame:
    """Flags of every frame, each from the stretch of time it lies in; a stretch also sees some seconds to both sides."""
    n = len(fields)
    size, edge = int(m.stretch_seconds * 1e6), int(m.overlap_seconds * 1e6)
    spread = _spread(frames, fields, m).withColumnRenamed("_source", "_of")
    near = F.array_distinct(F.transform(F.array(F.col("_t") - edge, F.col("_t"), F.col("_t") + edge), lambda t: F.floor(t / F.lit(size))))
    spans = frames.withColumn("_span", F.explode(near)).join(spread, F.col("_source") == F.col("_of")).drop("_of")
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = f"_source {kinds['_source']}, _part {kinds['_part']}, _t bigint, " + ", ".join(f"_z{i} double, _n{i} bigint, _spike{i} boolean, _stuck{i} boolean" for i in range(n))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable")
        t = pdf["_t"].to_numpy()
        z = [pdf[f"_z{i}"].to_numpy(float, na_value=np.nan) for i in range(n)]
        # The median of a difference of two readings is 0.95 of their own spread.
        spread = [max(m.least_spread, float(pdf[f"_s{i}"].iloc[0]) / 0.95, _resolution(z[i]) * 0.41 if _resolution(z[i]) > 0.05 else 0.0) for i in range(n)]
        spikes, stuck = judge_frames(t / 1e6, z, spread, fields, m)
        own = t // size == pdf["_span"].to_numpy()
        out = pdf[["_source", "_part", "_t"]].copy()
        for i in range(n):
            out[f"_z{i}"], out[f"_n{i}"], out[f"_spike{i}"], out[f"_stuck{i}"] = z[i], pdf[f"_n{i}"], spikes[i], stuck[i]
        return out[own]

    return spans.groupBy("_source", "_part", "_span").applyInPandas(kernel, schema)


def flagged_cells(flagged: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """One row (``key``, field, fault) for each reading that ``spike_flags`` marked."""
    cells = F.array(*[F.when(F.col(f"{f}_fault").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}_fault").alias("fault"))) for f in fields])
    return flagged.select(col(key), F.explode(cells).alias("c")).filter("c is not null").select(key, "c.field", "c.fault")
