"""The pipelines from a command line: ``python -m tidemark COMMAND ...`` (``--help`` tells more)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .common import cut
from .operators import bloom, similarity, timing, tracking
from .sources import generators, readers, writers

MOMENTS = ["moment_id", "player_id", "quarter", "game_id", "x_loc", "y_loc", "game_clock", "shot_clock", "event_id", "recorded_at"]
EVENTS = ["play_id", "game_id", "eventnum", "eventmsgtype", "period", "pctimestring", "homedescription", "visitordescription", "player1_id", "player1_team_id", "game_clock"]
TYPES = {c: "int" for c in ("player_id", "quarter", "game_id", "event_id", "eventnum", "eventmsgtype", "period", "player1_id", "player1_team_id")}
TYPES |= {"x_loc": "float", "y_loc": "float", "game_clock": "double", "shot_clock": "double", "sec": "double", "moment_id": "bigint", "play_id": "bigint", "recorded_at": "timestamp_ntz"}


def table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet table, or CSV files with a header and these columns."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return readers.cast_columns(readers.read_strings(spark, path, columns), {c: TYPES[c] for c in columns if c in TYPES})


def similar(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = readers.read_tsv_documents(spark, a.input, first=a.documents or None)
    s = similarity.ShingleParams(a.shingle_length, a.shingles, a.seed)
    if a.method == "bf":
        sets, value = cut(similarity.shingles(docs, p=s)), "shingles"
        pairs = similarity.jaccard_pairs(sets, a.threshold)
    else:
        p = similarity.LshParams(a.hashes, a.bands, a.threshold, a.seed)
        if p.used_bands != a.bands:
            print(f"{a.hashes} hashes can't be cut into {a.bands} bands; {p.used_bands} are used")
        sets, value = cut(similarity.signatures(docs, s=s, p=p)), "signature"
        pairs = similarity.lsh_pairs(sets, p, a.strict)
    # Pairs are of classes of equal documents, named by the smallest id; who is in which class stands beside them.
    writers.write_pairs(pairs, f"{a.output}/pairs")
    writers.write_table(similarity.membership(sets, value), f"{a.output}/classes")


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    m = table(spark, a.moments, MOMENTS)
    if a.command == "distance":
        out = tracking.distance(m, table(spark, a.other, ["player_id", "team_id", "sec", "games"]), a.strict).orderBy("player_id")
    elif a.command == "zones":
        out = tracking.speed_zones(m, a.strict).orderBy("player_id", "zone")
    elif a.command == "rebounds":
        out = tracking.player_rebounds(m, table(spark, a.other, EVENTS), a.strict).orderBy("player_id")
    else:
        out = tracking.team_rebounds(table(spark, a.other, EVENTS)).orderBy("team_id")
    writers.write_single_csv(out, a.output)


def names(spark: SparkSession, a: argparse.Namespace) -> None:
    real = readers.read_lines(spark, a.names, "name")
    if a.command == "fakes":
        writers.write_lines(generators.near_misses(real, "name", a.count, a.seed), "fake", a.output)
        return
    probes = readers.read_lines(spark, a.probes, "name")
    print(bloom.probe(bloom.build(real, "name", a.bits, a.hashes), bloom.others(probes, "name", real, "name"), "name", a.bits, a.hashes).count())


def timed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mean and spread of the seconds of a rotation, a sort or a search."""
    work = {k: w for k, w in timing.works(spark, a.size, [a.block]).items() if k.split(" ")[0] == a.what}
    for row in timing.time_runs(spark, work, a.repeats).collect():
        print(writers.result_line(a.what, a.size, f"{row['mean']:.6f}", f"{row['spread']:.6f}"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("similar", help="pairs of similar documents of a TSV file")
    s.add_argument("method", choices=["bf", "lsh"])
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--threshold", type=float, required=True)
    s.add_argument("--shingle-length", type=int, required=True)
    for name, default in (("documents", 0), ("shingles", 1000), ("seed", 1234), ("hashes", 24), ("bands", 6)):
        s.add_argument(f"--{name}", type=int, default=default)
    s.add_argument("--strict", action="store_true", help="report the true share of agreeing values")
    s.set_defaults(run=similar)
    for name in ("distance", "zones", "rebounds", "teams"):
        t = sub.add_parser(name)
        t.add_argument("moments")
        t.add_argument("output")
        t.add_argument("--other", help="the table of minutes, or of events")
        t.add_argument("--strict", action="store_true")
        t.set_defaults(run=track)
    f = sub.add_parser("fakes", help="near misses of a list of names")
    f.add_argument("names")
    f.add_argument("output")
    f.add_argument("--count", type=int, default=100)
    f.add_argument("--seed", type=int, default=1)
    f.set_defaults(run=names)
    b = sub.add_parser("bloom", help="count the false positives of a filter")
    b.add_argument("names")
    b.add_argument("probes")
    b.add_argument("--bits", type=int, default=14, help="the filter has two to that power")
    b.add_argument("--hashes", type=int, default=4)
    b.set_defaults(run=names)
    t = sub.add_parser("time", help="time an operator")
    t.add_argument("what", choices=["rotate", "rotate-blocked", "sort", "nearest"])
    t.add_argument("--size", type=int, default=100)
    t.add_argument("--block", type=int, default=10)
    t.add_argument("--repeats", type=int, default=5)
    t.set_defaults(run=timed)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
