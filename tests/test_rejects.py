import pytest
from pyspark.sql import functions as F

from tidemark.operators.rejects import parse_lines, rejected_lines, valid_lines

GOOD = "9400000,4,2,1,11:22,MISS a shot,,7000239,51008"
CASES = [
    (GOOD, None),
    ('0009400000,"4",2,1, 1:22 ,"a, ""b""",,7000239,"51008.0"', None),
    ("9400000, 0161 ,2,1,12:00,,,,", None),
    (None, "null line"),
    ("", "fields: 1"),
    ("   ", "fields: 1"),
    (GOOD + ",", "fields: 10"),
    ("a,b", "fields: 2"),
    ('9400000,4,2,1,11:22,MI"SS,,7000239,51008', "quoting"),
    ('9400000,4,2,1,11:22,"open,,7000239,51008', "quoting"),
    ('9400000,4,2,1,11:22,"a"b,,7000239,51008', "quoting"),
    ("9400000,0,2,1,11:22,,,7000239,51008", "eventnum"),
    ("9400000,10000,2,1,11:22,,,7000239,51008", "eventnum"),
    ("9400000,-4,2,1,11:22,,,7000239,51008", "eventnum"),
    ("9400000,4,2,1,11:60,,,7000239,51008", "pctimestring"),
    ("9400000,4,2,1,12:01,,,7000239,51008", "pctimestring"),
    ("9400000,4,2,1,1:2,,,7000239,51008", "pctimestring"),
    ("9400000,4,2,1,11:22,,,7000239,5100", "player1_team_id"),
    ("9400000,4,2,1,11:22,,,7000239,51008.5", "player1_team_id"),
    ("x,?,2,1,?,,,7000239,?", "eventnum; pctimestring; player1_team_id"),
    ("9400000,4,2,1,11:22,two\nlines,a\rb,7000239,51008\r\n", None),
    ("9400000,4,2,1,11:22,ünï ☃," + "y" * 100_000 + ",7000239,51008", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, line) for i, (line, _) in enumerate(CASES)] * 2
    return parse_lines(spark.createDataFrame(rows, "line_id bigint, line string").repartition(3)).cache()


def test_reasons(parsed):
    got = parsed.groupBy("line_id").agg(F.first("reject_reason").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.line_id: (r.r, r.n) for r in got} == {i: (why, 2) for i, (_, why) in enumerate(CASES)}


def test_types(parsed):
    row = valid_lines(parsed).filter("line_id = 1").first()
    assert (row.game_id, row.eventnum, row.pctimestring, row.homedescription, row.visitordescription, row.player1_id, row.player1_team_id) == (9400000, 4, "1:22", 'a, "b"', "", 7000239, 51008)
    row = valid_lines(parsed).filter("line_id = 2").first()
    assert (row.eventnum, row.player1_id, row.player1_team_id) == (161, None, None)
    row = valid_lines(parsed).filter("line_id = 20").first()
    assert (row.homedescription, row.visitordescription) == ("two\nlines", "a\rb")
    assert len(valid_lines(parsed).filter("line_id = 21").first().visitordescription) == 100_000


def test_rejected(parsed):
    assert rejected_lines(parsed).filter("line_id = 5").first().reject_reason == "fields: 1"
    assert valid_lines(parsed).count() + rejected_lines(parsed).count() == parsed.count()


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, GOOD, "mine", "too")], "line_id int, line string, period string, reject_reason string")
    out = parse_lines(df, keep=["line_id", "period", "reject_reason"])
    assert {"period", "period_1", "reject_reason", "reject_reason_1"} <= set(out.columns)
    row = out.first()
    assert (row.period, row.period_1, row.reject_reason, row.reject_reason_1) == ("mine", 1, "too", None)
    assert parse_lines(df.limit(0)).count() == 0


def test_control_characters_and_line_ends_are_kept(spark):
    odd = ["ab\x1ecd", "a\x1fb\nc", "x\r\ny\x1e", "".join(map(chr, [*range(1, 34), *range(35, 44)])), "\ue000\n\ue001", "\x01\x02", "\u2028 \x85"]
    rows = [(i, f'9400000,4,2,1,11:22,"{t}",,7000239,51008') for i, t in enumerate(odd)]
    got = {r.line_id: (r.homedescription, r.reject_reason) for r in parse_lines(spark.createDataFrame(rows, "line_id bigint, line string").coalesce(1)).collect()}
    assert got == {i: (t, None) for i, t in enumerate(odd)}
