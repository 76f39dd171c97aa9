"""Queries of the stream operators, run over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import load
from ..operators.segments import paths
from ..streaming.sessions import gap_sessions, speed_windows
from .tracking import PATHS_SQL

QUERIES = {
    "gap_sessions": lambda s, d: gap_sessions(load(s, d, "events"), "user_id", "ts", "value", "6 hours").select(
        "user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "n", F.round("total", 2).alias("total")
    ),
    "speed_windows": lambda s, d: speed_windows(paths(load(s, d, "moments")), "player_id", "recorded_at", "step").select(
        "player_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.round("metres", 4).alias("metres")
    ),
}

_GAP = 6 * 3600 * 1_000_000

ORACLES = {
    "gap_sessions": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE ts IS NOT NULL),
    f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {_GAP} THEN 0 ELSE 1 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT user_id, min(t) AS start, max(t) + {_GAP} AS "end", count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, k""",
    "speed_windows": f"""{PATHS_SQL}, w AS (SELECT player_id, step, epoch_us(recorded_at) // 5000000 * 5000000 - unnest([0, 5000000]) AS start FROM p)
    SELECT player_id, start, round(sum(step), 4) AS metres FROM w GROUP BY 1, 2""",
}
