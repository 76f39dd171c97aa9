"""The tracking pipelines: distance, speed zones and rebounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ZONES, euclid, hoop_distance, rebound_count, sound
from .segments import ORDER, PATH, paths, positions, zoned_paths


def minutes(minutes_played: DataFrame) -> DataFrame:
    """Minutes of each player over all of their rows with a known time."""
    sec = sound(F.col("sec"))
    return minutes_played.filter(sec.isNotNull()).groupBy("player_id").agg((F.sum(sec) / 60).alias("minutes"))


def distance(moments: DataFrame, minutes_played: DataFrame, strict: bool = False) -> DataFrame:
    """Metres per 12 minutes of play, rounded half to even: ``player_id``, ``distance``; 0 for players never tracked, null without minutes."""
    run = paths(moments, strict).groupBy("player_id").agg(F.sum("step").alias("metres"))
    out = minutes(minutes_played).join(run, "player_id", "left")
    return out.select("player_id", F.bround(F.try_divide(F.coalesce("metres", F.lit(0.0)) * 12, F.col("minutes")), 0).alias("distance"))


def densify(keys: DataFrame, values: tuple[str, ...] = ZONES, name: str = "zone") -> DataFrame:
    """Each row of ``keys`` with each of a few literal values."""
    return keys.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def speed_zones(moments: DataFrame, strict: bool = False) -> DataFrame:
    """Runs and metres per player and zone, zeros for zones never reached: ``player_id``, ``zone``, ``runs``, ``metres``.

    Otherwise the runs of a player and zone are counted by their number within a segment, so that equal numbers of different
    segments count once; with ``strict`` every run counts.
    """
    z = zoned_paths(moments, strict)
    # One pass per player: the zones are few, so runs and metres fold into one row per player, zone and run number first.
    if strict:
        w = Window.partitionBy(*PATH, "segment").orderBy(*ORDER)
        z = z.withColumn("begins", F.coalesce(F.lag("run_id").over(w) != F.col("run_id"), F.lit(True)))
        got = z.groupBy("player_id", "zone").agg(F.count_if("begins").alias("runs"), F.round(F.sum("step"), 2).alias("metres"))
    else:
        by_run = z.groupBy("player_id", "zone", "run_id").agg(F.sum("step").alias("s"))
        got = by_run.groupBy("player_id", "zone").agg(F.count("run_id").alias("runs"), F.round(F.sum("s"), 2).alias("metres"))
    players = got.groupBy("player_id").agg(F.collect_list(F.struct("zone", "runs", "metres")).alias("got"))
    one = F.filter("got", lambda g: g["zone"] == F.col("zone"))
    out = densify(players).withColumn("one", F.get(one, F.lit(0)))
    return out.select("player_id", "zone", F.coalesce("one.runs", F.lit(0).cast("bigint")).alias("runs"), F.coalesce("one.metres", F.lit(0.0)).alias("metres"))


def rebound_events(play_events: DataFrame) -> DataFrame:
    """Rebounds credited to a team, with the player's totals so far in the game."""
    text = F.coalesce("homedescription", "visitordescription")
    return play_events.filter((F.col("eventmsgtype") == 4) & F.col("player1_team_id").isNotNull()).select(
        "play_id", "game_id", "eventnum", "player1_id", F.col("player1_team_id").alias("team_id"), rebound_count(text, 1).alias("off"), rebound_count(text, 2).alias("def")
    )


def rebounds_by_game(play_events: DataFrame) -> DataFrame:
    """Totals of each player and game; they rise in the course of a game, so the largest holds."""
    return rebound_events(play_events).groupBy("player1_id", "game_id").agg(F.max("off").alias("off"), F.max("def").alias("def"), F.min("team_id").alias("team_id"))


def team_rebounds(play_events: DataFrame) -> DataFrame:
    """Average rebounds of each team's games: ``team_id``, ``rebounds``; a game where one kind is unknown doesn't count."""
    per_game = rebounds_by_game(play_events).groupBy("team_id", "game_id").agg(F.sum("off").alias("off"), F.sum("def").alias("def"))
    return per_game.groupBy("team_id").agg(F.avg(F.col("off") + F.col("def")).alias("rebounds"))


def shot_clock_context(rows: DataFrame, keys: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Adds ``none_so_far`` (no shot clock up to this row; with ``strict``, none at all), ``before`` and ``next_known``."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ORDER])
    count = F.count("shot_clock").over(Window.partitionBy(*keys) if strict else w.rowsBetween(Window.unboundedPreceding, 0))
    # The next known value is the last known one of the reversed order, which reads every row once.
    return rows.withColumns({"none_so_far": count == 0, "before": F.lag("shot_clock").over(w)}).withColumn(
        "next_known", F.last("shot_clock", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    )


def rebound_moments(moments: DataFrame, play_events: DataFrame) -> DataFrame:
    """Positions of the rebounding player in the moments of the rebound's event.  Repeated events count once."""
    e = rebound_events(play_events).groupBy("game_id", "eventnum", "player1_id").agg(F.min("play_id").alias("play_id"))
    e = e.select(F.col("game_id").alias("e_game"), "eventnum", "player1_id", "play_id")
    m = positions(moments.filter("player_id != -1"))
    return m.join(e, (m.game_id == e.e_game) & (m.event_id == e.eventnum) & (m.player_id == e.player1_id)).drop("e_game", "player1_id")


def rebound_candidates(moments: DataFrame, play_events: DataFrame, strict: bool = False) -> DataFrame:
    """Moments at which the ball may have been caught: the shot clock has just been set to 24, or is off late in a quarter."""
    m = shot_clock_context(rebound_moments(moments, play_events), (*PATH, "eventnum"), strict)
    sc, late = F.col("shot_clock"), F.col("game_clock") < 24
    reset = (sc <= 24) & (sc > 23) & ((F.col("before") != 24) | F.col("before").isNull())
    gone = sc.isNull() & F.col("before").isNotNull() & late & F.col("next_known").isNull()
    return m.filter(reset | (F.col("none_so_far") & late) | gone)


def located_rebounds(moments: DataFrame, play_events: DataFrame, strict: bool = False, reach: float = 1.0) -> DataFrame:
    """One candidate per player and event within ``reach`` metres of the ball: the earliest, or with ``strict`` the one nearest to it."""
    c = rebound_candidates(moments, play_events, strict)
    b = positions(moments.filter("player_id = -1")).select(
        F.col("moment_id").alias("ball_id"), F.col("game_id").alias("b_game"), F.col("quarter").alias("b_quarter"), F.col("event_id").alias("b_event"),
        F.col("game_clock").alias("b_clock"), F.col("shot_clock").alias("b_shot"), F.col("x").alias("bx"), F.col("y").alias("by"),
    )
    at = (c.game_id == b.b_game) & (c.quarter == b.b_quarter) & (c.event_id == b.b_event) & (c.game_clock == b.b_clock) & c.shot_clock.eqNullSafe(b.b_shot)
    near = c.join(b, at).withColumn("to_ball", euclid(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).filter(F.col("to_ball") <= reach)
    order = ["to_ball", *ORDER, "ball_id"] if strict else [*ORDER, "to_ball", "ball_id"]
    w = Window.partitionBy(*PATH, "eventnum").orderBy(*order)
    first = near.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return first.select("play_id", "game_id", "eventnum", "player_id", "quarter", "moment_id", "to_ball", hoop_distance(F.col("x"), F.col("y")).alias("to_hoop"))


def player_rebounds(moments: DataFrame, play_events: DataFrame, strict: bool = False, reach: float = 1.0) -> DataFrame:
    """``player_id``, ``off``, ``def`` and ``farthest`` (metres); players without a located rebound don't come out."""
    total = rebounds_by_game(play_events).groupBy(F.col("player1_id").alias("player_id")).agg(F.sum("off").alias("off"), F.sum("def").alias("def"))
    far = located_rebounds(moments, play_events, strict, reach).groupBy("player_id").agg(F.max("to_hoop").alias("farthest"))
    return total.join(far, "player_id")


def missing_rebounds(moments: DataFrame, play_events: DataFrame, strict: bool = False, reach: float = 1.0) -> DataFrame:
    """Rebounds that no moment was found for."""
    return rebound_events(play_events).join(located_rebounds(moments, play_events, strict, reach), ["game_id", "eventnum"], "left_anti").select("play_id", "game_id", "eventnum", "player1_id")


def event_moments(moments: DataFrame, play_events: DataFrame, within: float | None = None) -> DataFrame:
    """Events with the moments of the same game, event and player; with ``within``, only those whose clocks are that near."""
    e = play_events.select("play_id", F.col("game_id").alias("e_game"), "eventnum", "player1_id", sound(F.col("game_clock")).alias("e_clock"))
    m = moments.select("moment_id", "game_id", "event_id", "player_id", sound(F.col("game_clock")).alias("game_clock"))
    at = (m.game_id == e.e_game) & (m.event_id == e.eventnum) & (m.player_id == e.player1_id)
    if within is not None:
        at = at & (F.abs(m.game_clock - e.e_clock) <= within)
    return e.join(m, at).select("play_id", "moment_id")
