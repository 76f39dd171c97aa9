from datetime import datetime, timedelta

from tidemark.streaming.sessions import gap_sessions, speed_windows

T0 = datetime(2030, 1, 1)


def at(*seconds, key=1):
    return [(key, T0 + timedelta(seconds=s), float(s)) for s in seconds]


def streamed(spark, tmp_path, batches, make, name):
    """Each batch is a file; the stream reads one file at a time, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k int, t timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    src = spark.readStream.schema("k int, t timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = make(src).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_sessions_of_a_table(spark):
    df = spark.createDataFrame(at(0, 5, 40, 50) + at(3, key=2) + [(3, None, 1.0)], "k int, t timestamp, v double")
    got = sorted((r.k, r.n, r.total) for r in gap_sessions(df, "k", "t", "v").collect())
    assert got == [(1, 2, 5.0), (1, 2, 90.0), (2, 1, 3.0)]


def test_sessions_of_a_stream_close_behind_the_watermark(spark, tmp_path):
    got = streamed(spark, tmp_path, [at(0, 5), at(12, 40), at(500), at(501), at(3), at(900), at(901)], lambda s: gap_sessions(s, "k", "t", "v"), "sessions")
    # The event at 3 s comes after the watermark has passed its session; that of 900 s hasn't closed yet.
    assert sorted((r.n, r.total) for r in got.collect()) == [(1, 40.0), (2, 1001.0), (3, 17.0)]


def test_windows(spark, tmp_path):
    df = spark.createDataFrame(at(1, 6), "k int, t timestamp, v double")
    assert sorted((r.start.second, r.metres) for r in speed_windows(df, "k", "t", "v").collect()) == [(0, 7.0), (5, 6.0), (55, 1.0)]
    got = streamed(spark, tmp_path, [at(1, 6), at(200), at(400)], lambda s: speed_windows(s, "k", "t", "v"), "windows")
    assert {(r.start.second, r.metres) for r in got.collect()} >= {(0, 7.0), (5, 6.0), (55, 1.0)}
