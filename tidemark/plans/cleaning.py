"""Queries of the general data-cleaning operators, on the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..common import load
from ..operators.hotdeck import filled_cells, hot_deck_fill
from ..operators.rejects import parse_lines, rejected_lines, valid_lines
from ..operators.spikes import flagged_cells, spike_flags

Query = Callable[[SparkSession, str], DataFrame]
CLOCKS = ("game_clock", "shot_clock")
EVENT = ("game_id", "quarter", "event_id")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(load(spark, d, "raw_play_events"), "line", ["line_id", "source_file"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that fail."""
    return rejected_lines(_parsed(spark, d)).select("line_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Lines that fail, with file and reason."""
    return rejected_lines(_parsed(spark, d), ["line_id", "source_file"])


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed events."""
    return valid_lines(_parsed(spark, d)).drop("source_file")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return hot_deck_fill(load(spark, d, "moments"), CLOCKS, EVENT, "recorded_at", "moment_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells that were filled."""
    return filled_cells(_filled(spark, d), CLOCKS, "moment_id")


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """Both clocks of every row, with mark and distance of the donor."""
    new = [f"{f}_{x}" for f in CLOCKS for x in ("value", "filled", "donor_gap")]
    return _filled(spark, d).select("moment_id", *new)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that the clock cannot have shown."""
    return p4_faults(spark, d).select("moment_id", "field")


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    """Readings that the clock cannot have shown, with the kind of fault."""
    return flagged_cells(spike_flags(load(spark, d, "moments")), CLOCKS, "moment_id")


def p4_range(spark: SparkSession, d: str) -> DataFrame:
    """Readings outside what the clock can show."""
    return p4_faults(spark, d).filter("fault = 'range'").select("moment_id", "field")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p1_events": p1_events,
    "p3_found": p3_found,
    "p3_filled": p3_filled,
    "p4_found": p4_found,
    "p4_faults": p4_faults,
    "p4_range": p4_range,
}

#: How a field of a split line looks to the SQL: quotes around it taken off, doubled ones made single, then blanks taken off.
_BARE = "trim(CASE WHEN f[{i}] LIKE '\"%' THEN replace(substring(f[{i}], 2, length(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END, chr(32) || chr(9) || chr(10) || chr(13))"
_LINES = f"""
    WITH split AS (
        SELECT *, CASE WHEN regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*')
                       THEN list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda x: x) END AS f
        FROM raw_play_events
    ), bare AS (
        SELECT line_id, source_file, line, f, len(f) AS n, {_BARE.format(i=2)} AS num, {_BARE.format(i=5)} AS clock, {_BARE.format(i=9)} AS team FROM split
    ), judged AS (
        SELECT *,
               coalesce(regexp_full_match(num, '0*[1-9][0-9]{{0,3}}'), false) AS num_ok,
               coalesce(regexp_full_match(clock, '(0?[0-9]|1[01]):[0-5][0-9]|12:00'), false) AS clock_ok,
               coalesce(regexp_full_match(team, '([0-9]{{5}}(\\.0)?)?'), false) AS team_ok
        FROM bare
    )"""
_REASON = """CASE WHEN line IS NULL THEN 'null line' WHEN f IS NULL THEN 'quoting' WHEN n <> 9 THEN 'fields: ' || n
    ELSE concat_ws('; ', CASE WHEN NOT num_ok THEN 'eventnum' END, CASE WHEN NOT clock_ok THEN 'pctimestring' END, CASE WHEN NOT team_ok THEN 'player1_team_id' END) END"""
_GONE = "({f} IS NULL OR isnan({f}))"


def _filled_sql() -> str:
    w = "PARTITION BY game_id, quarter, event_id ORDER BY recorded_at, moment_id"
    near, out = [], ["moment_id"]
    for f in CLOCKS:
        at, seen = f"CASE WHEN NOT {_GONE.format(f=f)} THEN epoch_us(recorded_at) END", f"CASE WHEN NOT {_GONE.format(f=f)} THEN {f} END"
        for x, name in ((at, "t"), (seen, "v")):
            near.append(f"last_value({x} IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS {f}_{name}0")
            near.append(f"first_value({x} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {f}_{name}1")
        filled = f"({_GONE.format(f=f)} AND ({f}_t0 IS NOT NULL OR {f}_t1 IS NOT NULL))"
        later = f"({f}_t0 IS NULL OR {f}_t1 - epoch_us(recorded_at) < epoch_us(recorded_at) - {f}_t0)"
        pick = lambda x, f=f, later=later: f"CASE WHEN {later} THEN {f}_{x}1 ELSE {f}_{x}0 END"
        out += [
            f"CASE WHEN {filled} THEN {pick('v')} ELSE {f} END AS {f}_value",
            f"{filled} AS {f}_filled",
            f"CASE WHEN {filled} THEN abs(epoch_us(recorded_at) - ({pick('t')})) / 1e6 END AS {f}_donor_gap",
        ]
    return f"WITH n AS (SELECT *, {', '.join(near)} FROM moments) SELECT {', '.join(out)} FROM n"


ORACLES: dict[str, str] = {
    "p4_range": """
    SELECT moment_id, 'game_clock' AS field FROM moments WHERE NOT isnan(game_clock) AND NOT game_clock BETWEEN 0 AND 720
    UNION ALL SELECT moment_id, 'shot_clock' FROM moments WHERE NOT isnan(shot_clock) AND NOT shot_clock BETWEEN 0 AND 24""",
    "p3_filled": _filled_sql(),
    "p1_found": f"{_LINES} SELECT line_id FROM judged WHERE f IS NULL OR n <> 9 OR NOT (num_ok AND clock_ok AND team_ok)",
    "p1_reasons": f"{_LINES} SELECT line_id, source_file, {_REASON} AS reject_reason FROM judged WHERE f IS NULL OR n <> 9 OR NOT (num_ok AND clock_ok AND team_ok)",
    "p1_events": f"""{_LINES}
    SELECT line_id,
           {", ".join(f"TRY_CAST(regexp_extract({_BARE.format(i=i)}, '^0*([0-9]{{1,9}})(?:\\.0)?$', 1) AS INTEGER) AS {c}" for i, c in ((1, "game_id"), (2, "eventnum"), (3, "eventmsgtype"), (4, "period"), (8, "player1_id"), (9, "player1_team_id")))},
           clock AS pctimestring,
           {", ".join(f"CASE WHEN f[{i}] LIKE '\"%' THEN replace(substring(f[{i}], 2, length(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END AS {c}" for i, c in ((6, "homedescription"), (7, "visitordescription")))}
    FROM judged WHERE n = 9 AND num_ok AND clock_ok AND team_ok""",
    "p3_found": " UNION ALL ".join(
        f"""SELECT moment_id, '{f}' AS field FROM moments JOIN (
            SELECT game_id, quarter, event_id FROM moments WHERE NOT {_GONE.format(f=f)} GROUP BY ALL) USING (game_id, quarter, event_id)
        WHERE {_GONE.format(f=f)}"""
        for f in CLOCKS
    ),
}
