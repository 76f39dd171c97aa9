"""Tracking queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import load
from ..functions.exprs import FAST_ABOVE, FOOT, HOOPS, SLOW_BELOW, clock_seconds, hoop_distance, rebound_count
from ..operators import segments as S
from ..operators import tracking as T


WIDE = 7.0


def _m(spark, d):
    return load(spark, d, "moments")


def _e(spark, d):
    return load(spark, d, "play_events")


def _r(name: str, places: int = 4):
    return F.round(name, places).alias(name)


QUERIES = {
    "distance": lambda s, d: T.distance(_m(s, d), load(s, d, "minutes_played")),
    "distance_strict": lambda s, d: T.distance(_m(s, d), load(s, d, "minutes_played"), strict=True),
    "minutes_by_player": lambda s, d: T.minutes(load(s, d, "minutes_played")).select("player_id", _r("minutes")),
    "deduplicated_positions": lambda s, d: S.dedupe_keep_first(S.positions(_m(s, d)), S.SAME, S.ORDER, S.PATH).select("moment_id", "player_id", _r("x"), _r("y")),
    "gap_segments": lambda s, d: S.paths(_m(s, d)).select("moment_id", "segment"),
    "gap_segments_strict": lambda s, d: S.paths(_m(s, d), strict=True).select("moment_id", "segment"),
    "step_distance": lambda s, d: S.paths(_m(s, d)).select("moment_id", _r("step")),
    "moving_average": lambda s, d: S.zoned_paths(_m(s, d)).select("moment_id", _r("moving_avg")),
    "zones": lambda s, d: S.zoned_paths(_m(s, d)).groupBy("player_id", "zone").agg(F.count(F.lit(1)).alias("n")),
    "zone_runs": lambda s, d: S.zoned_paths(_m(s, d)).select("moment_id", "run_id"),
    "speed_zones": lambda s, d: T.speed_zones(_m(s, d)),
    "speed_zones_strict": lambda s, d: T.speed_zones(_m(s, d), strict=True),
    "rebound_events": lambda s, d: T.rebound_events(_e(s, d)),
    "rebounds_by_game": lambda s, d: T.rebounds_by_game(_e(s, d)),
    "team_rebounds": lambda s, d: T.team_rebounds(_e(s, d)).select("team_id", _r("rebounds")),
    "shot_clock_context": lambda s, d: T.shot_clock_context(T.rebound_moments(_m(s, d), _e(s, d)), (*S.PATH, "eventnum")).select(
        "moment_id", "play_id", "none_so_far", "before", "next_known"
    ),
    "rebound_candidates": lambda s, d: T.rebound_candidates(_m(s, d), _e(s, d)).select("moment_id", "play_id"),
    "rebound_candidates_strict": lambda s, d: T.rebound_candidates(_m(s, d), _e(s, d), strict=True).select("moment_id", "play_id"),
    "located_rebounds": lambda s, d: T.located_rebounds(_m(s, d), _e(s, d)).select("play_id", "moment_id", "quarter", _r("to_ball"), _r("to_hoop")),
    "player_rebounds": lambda s, d: T.player_rebounds(_m(s, d), _e(s, d)).select("player_id", "off", "def", _r("farthest")),
    "player_rebounds_strict": lambda s, d: T.player_rebounds(_m(s, d), _e(s, d), strict=True).select("player_id", "off", "def", _r("farthest")),
    "missing_rebounds": lambda s, d: T.missing_rebounds(_m(s, d), _e(s, d)),
    # The same with a reach of seven metres: in the test tables nobody holds the ball.
    "located_rebounds_wide": lambda s, d: T.located_rebounds(_m(s, d), _e(s, d), reach=WIDE).select("play_id", "moment_id", "quarter", _r("to_ball"), _r("to_hoop")),
    "located_rebounds_wide_strict": lambda s, d: T.located_rebounds(_m(s, d), _e(s, d), True, WIDE).select("play_id", "moment_id", "quarter", _r("to_ball"), _r("to_hoop")),
    "player_rebounds_wide": lambda s, d: T.player_rebounds(_m(s, d), _e(s, d), reach=WIDE).select("player_id", "off", "def", _r("farthest")),
    "player_rebounds_wide_strict": lambda s, d: T.player_rebounds(_m(s, d), _e(s, d), True, WIDE).select("player_id", "off", "def", _r("farthest")),
    "missing_rebounds_wide": lambda s, d: T.missing_rebounds(_m(s, d), _e(s, d), reach=WIDE),
    "event_moments": lambda s, d: T.event_moments(_m(s, d), _e(s, d)),
    "event_moments_in_range": lambda s, d: T.event_moments(_m(s, d), _e(s, d), within=5.0),
    "clock_text": lambda s, d: _e(s, d).select("play_id", clock_seconds(F.col("pctimestring")).alias("seconds")),
    "description_counts": lambda s, d: _e(s, d).select(
        "play_id", *[rebound_count(F.coalesce("homedescription", "visitordescription"), i).alias(n) for i, n in ((1, "off"), (2, "def"))]
    ),
    "hoop_distance": lambda s, d: S.positions(_m(s, d)).select("moment_id", F.round(hoop_distance(F.col("x"), F.col("y")), 4).alias("to_hoop")),
}

_num = lambda c: f"CASE WHEN NOT isnan({c}) THEN CAST({c} AS DOUBLE) END"
_POS = f"""pos AS (SELECT moment_id, player_id, quarter, game_id, event_id, recorded_at, {_num('x_loc')} * {FOOT} AS x, {_num('y_loc')} * {FOOT} AS y,
    {_num('game_clock')} AS game_clock, {_num('shot_clock')} AS shot_clock FROM moments)"""
_DEDUPE = """SELECT * FROM pos {where} QUALIFY row_number() OVER (PARTITION BY player_id, quarter, game_id, x, y, game_clock, shot_clock ORDER BY recorded_at, moment_id) = 1"""


def _paths(strict: bool) -> str:
    starts = "jump" if strict else "CASE WHEN jump = 1 AND lag(jump) OVER w = 0 THEN 1 ELSE 0 END"
    return f"""WITH {_POS},
    ded AS ({_DEDUPE.format(where='WHERE player_id <> -1')}),
    j AS (SELECT *, CASE WHEN abs(game_clock - coalesce(lag(game_clock) OVER w, game_clock)) > 15 THEN 1 ELSE 0 END AS jump FROM ded
          WINDOW w AS (PARTITION BY player_id, quarter, game_id ORDER BY recorded_at, moment_id)),
    f AS (SELECT *, {starts} AS starts FROM j WINDOW w AS (PARTITION BY player_id, quarter, game_id ORDER BY recorded_at, moment_id)),
    g AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY player_id, quarter, game_id ORDER BY recorded_at, moment_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f),
    l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM g WINDOW w AS (PARTITION BY player_id, quarter, game_id, segment ORDER BY recorded_at, moment_id)),
    p AS (SELECT *, CASE WHEN px IS NULL OR py IS NULL THEN 0.0 ELSE sqrt(pow(x - px, 2) + pow(y - py, 2)) END AS step FROM l)"""


#: Positions with segment and step, as the table p.
PATHS_SQL = _paths(False)


def _zoned(strict: bool) -> str:
    w = "(PARTITION BY player_id, quarter, game_id, segment ORDER BY recorded_at, moment_id"
    return f"""{_paths(strict)},
    v AS (SELECT *, CASE WHEN step * 25 <= 12 THEN step * 25 END AS speed FROM p),
    a AS (SELECT *, avg(speed) OVER {w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS moving_avg FROM v),
    z AS (SELECT *, CASE WHEN moving_avg < {SLOW_BELOW} THEN 'slow' WHEN moving_avg > {FAST_ABOVE} THEN 'fast' ELSE 'normal' END AS zone FROM a),
    c AS (SELECT *, CASE WHEN lag(zone) OVER w2 <> zone THEN 1 ELSE 0 END AS changed, lag(zone) OVER w2 IS NULL AS is_first FROM z WINDOW w2 AS {w})),
    r AS (SELECT *, CAST(sum(changed) OVER {w} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c)"""


def _distance(strict: bool) -> str:
    return f"""{_paths(strict)}, run AS (SELECT player_id, sum(step) AS metres FROM p GROUP BY 1),
    mins AS (SELECT player_id, sum(sec) / 60 AS minutes FROM minutes_played WHERE sec IS NOT NULL AND NOT isnan(sec) GROUP BY 1)
    SELECT player_id, CASE WHEN minutes <> 0 THEN round_even(coalesce(metres, 0) * 12 / minutes, 0) END AS distance FROM mins LEFT JOIN run USING (player_id)"""


def _speed_zones(strict: bool) -> str:
    runs = "CAST(sum(CASE WHEN changed = 1 OR is_first THEN 1 ELSE 0 END) AS BIGINT)" if strict else "count(DISTINCT run_id)"
    return f"""{_zoned(strict)}, got AS (SELECT player_id, zone, {runs} AS runs, round(sum(step), 2) AS metres FROM r GROUP BY 1, 2),
    grid AS (SELECT player_id, zone FROM (SELECT DISTINCT player_id FROM r) CROSS JOIN (VALUES ('slow'), ('normal'), ('fast')) AS t(zone))
    SELECT player_id, zone, coalesce(runs, 0) AS runs, coalesce(metres, 0) AS metres FROM grid LEFT JOIN got USING (player_id, zone)"""


_TEXT = "coalesce(homedescription, visitordescription)"
_COUNT = "TRY_CAST(regexp_extract({t}, '\\(Off:(\\d+) Def:(\\d+)\\)', {i}) AS INTEGER)"
_REB = f"""reb AS (SELECT play_id, game_id, eventnum, player1_id, player1_team_id AS team_id, {_COUNT.format(t=_TEXT, i=1)} AS off, {_COUNT.format(t=_TEXT, i=2)} AS def
    FROM play_events WHERE eventmsgtype = 4 AND player1_team_id IS NOT NULL),
    byg AS (SELECT player1_id, game_id, max(off) AS off, max(def) AS def, min(team_id) AS team_id FROM reb GROUP BY 1, 2)"""


def _hoop(x: str, y: str) -> str:
    return "least(" + ", ".join(f"sqrt(pow({x} - {hx}, 2) + pow({y} - {hy}, 2))" for hx, hy in HOOPS) + ")"


def _context(strict: bool) -> str:
    part = "PARTITION BY player_id, quarter, game_id, eventnum"
    order = "ORDER BY recorded_at, moment_id"
    so_far = f"count(shot_clock) OVER ({part})" if strict else f"count(shot_clock) OVER ({part} {order} ROWS UNBOUNDED PRECEDING)"
    return f"""WITH {_POS}, {_REB},
    ev AS (SELECT game_id, eventnum, player1_id, min(play_id) AS play_id FROM reb GROUP BY 1, 2, 3),
    rm AS (SELECT pos.*, eventnum, play_id FROM pos JOIN ev ON pos.game_id = ev.game_id AND event_id = eventnum AND player_id = player1_id WHERE player_id <> -1),
    ctx AS (SELECT *, {so_far} = 0 AS none_so_far, lag(shot_clock) OVER ({part} {order}) AS before,
            first_value(shot_clock IGNORE NULLS) OVER ({part} {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_known FROM rm),
    cand AS (SELECT * FROM ctx WHERE (shot_clock <= 24 AND shot_clock > 23 AND (before <> 24 OR before IS NULL)) OR (none_so_far AND game_clock < 24)
             OR (shot_clock IS NULL AND before IS NOT NULL AND game_clock < 24 AND next_known IS NULL))"""


def _located(strict: bool, reach: float = 1.0) -> str:
    order = "to_ball, recorded_at, moment_id, ball_id" if strict else "recorded_at, moment_id, to_ball, ball_id"
    return f"""{_context(strict)},
    near AS (SELECT cand.*, b.moment_id AS ball_id, sqrt(pow(cand.x - b.x, 2) + pow(cand.y - b.y, 2)) AS to_ball, {_hoop('cand.x', 'cand.y')} AS to_hoop
             FROM cand JOIN pos b ON b.player_id = -1 AND cand.game_id = b.game_id AND cand.quarter = b.quarter AND cand.event_id = b.event_id
             AND cand.game_clock = b.game_clock AND cand.shot_clock IS NOT DISTINCT FROM b.shot_clock
             WHERE sqrt(pow(cand.x - b.x, 2) + pow(cand.y - b.y, 2)) <= {reach}),
    loc AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY player_id, quarter, game_id, eventnum ORDER BY {order}) = 1)"""


def _players(strict: bool, reach: float = 1.0) -> str:
    return f"""{_located(strict, reach)}, tot AS (SELECT player1_id AS player_id, CAST(sum(off) AS BIGINT) AS off, CAST(sum(def) AS BIGINT) AS def FROM byg GROUP BY 1)
    SELECT player_id, tot.off, tot.def, round(max(to_hoop), 4) AS farthest FROM tot JOIN loc USING (player_id) GROUP BY 1, 2, 3"""


def _missing(reach: float) -> str:
    return f"""{_located(False, reach)} SELECT play_id, game_id, eventnum, player1_id FROM reb
    WHERE NOT EXISTS (SELECT 1 FROM loc WHERE loc.game_id = reb.game_id AND loc.eventnum = reb.eventnum)"""


def _places(strict: bool) -> str:
    return f"{_located(strict, WIDE)} SELECT play_id, moment_id, quarter, round(to_ball, 4) AS to_ball, round(to_hoop, 4) AS to_hoop FROM loc"


_EM = "FROM play_events e JOIN moments m ON m.game_id = e.game_id AND m.event_id = e.eventnum AND m.player_id = e.player1_id"

ORACLES = {
    "distance": _distance(False),
    "distance_strict": _distance(True),
    "minutes_by_player": "SELECT player_id, round(sum(sec) / 60, 4) AS minutes FROM minutes_played WHERE sec IS NOT NULL AND NOT isnan(sec) GROUP BY 1",
    "deduplicated_positions": f"WITH {_POS} SELECT moment_id, player_id, round(x, 4) AS x, round(y, 4) AS y FROM ({_DEDUPE.format(where='')})",
    "gap_segments": f"{_paths(False)} SELECT moment_id, segment FROM p",
    "gap_segments_strict": f"{_paths(True)} SELECT moment_id, segment FROM p",
    "step_distance": f"{_paths(False)} SELECT moment_id, round(step, 4) AS step FROM p",
    "moving_average": f"{_zoned(False)} SELECT moment_id, round(moving_avg, 4) AS moving_avg FROM r",
    "zones": f"{_zoned(False)} SELECT player_id, zone, count(*) AS n FROM r GROUP BY 1, 2",
    "zone_runs": f"{_zoned(False)} SELECT moment_id, run_id FROM r",
    "speed_zones": _speed_zones(False),
    "speed_zones_strict": _speed_zones(True),
    "rebound_events": f"WITH {_REB} SELECT play_id, game_id, eventnum, player1_id, team_id, off, def FROM reb",
    "rebounds_by_game": f"WITH {_REB} SELECT * FROM byg",
    "team_rebounds": f"""WITH {_REB}, g AS (SELECT team_id, game_id, sum(off) AS off, sum(def) AS def FROM byg GROUP BY 1, 2)
    SELECT team_id, round(avg(off + def), 4) AS rebounds FROM g GROUP BY 1""",
    "shot_clock_context": f"{_context(False)} SELECT moment_id, play_id, none_so_far, before, next_known FROM ctx",
    "rebound_candidates": f"{_context(False)} SELECT moment_id, play_id FROM cand",
    "rebound_candidates_strict": f"{_context(True)} SELECT moment_id, play_id FROM cand",
    "located_rebounds": f"{_located(False)} SELECT play_id, moment_id, quarter, round(to_ball, 4) AS to_ball, round(to_hoop, 4) AS to_hoop FROM loc",
    "player_rebounds": _players(False),
    "player_rebounds_strict": _players(True),
    "missing_rebounds": _missing(1.0),
    "located_rebounds_wide": _places(False),
    "located_rebounds_wide_strict": _places(True),
    "player_rebounds_wide": _players(False, WIDE),
    "player_rebounds_wide_strict": _players(True, WIDE),
    "missing_rebounds_wide": _missing(WIDE),
    "event_moments": f"SELECT play_id, moment_id {_EM}",
    "event_moments_in_range": f"SELECT play_id, moment_id {_EM} WHERE NOT isnan(m.game_clock) AND abs(m.game_clock - e.game_clock) <= 5",
    "clock_text": "SELECT play_id, CAST(TRY_CAST(split_part(pctimestring, ':', 1) AS INTEGER) * 60 + TRY_CAST(split_part(pctimestring, ':', 2) AS INTEGER) AS DOUBLE) AS seconds FROM play_events",
    "description_counts": f"SELECT play_id, {_COUNT.format(t=_TEXT, i=1)} AS off, {_COUNT.format(t=_TEXT, i=2)} AS def FROM play_events",
    "hoop_distance": f"WITH {_POS} SELECT moment_id, round({_hoop('x', 'y')}, 4) AS to_hoop FROM pos",
}
