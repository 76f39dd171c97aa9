import random
from datetime import datetime, timedelta

from tidemark.llm.nearest_stream import emit_and_evict, stream_nearest_in_time, tables_as_streams
from tidemark.llm.nearest_time import nearest_in_time

T0 = datetime(2030, 1, 1)
SECOND = 1_000_000


def test_emission_and_eviction():
    at = lambda *rows: [(t, i, t / 1e6) for t, i in rows]
    out, lefts, rights = emit_and_evict(at((10, 1), (50, 2)), at((7, 9), (13, 8), (13, 5), (60, 4), (2, 3)), 30, 5, 5e-6)
    assert out[0][:2] == (1, 5) and abs(out[0][2] - 3e-6) < 1e-12 and len(out) == 1 and lefts == at((50, 2)) and rights == at((60, 4))
    assert emit_and_evict(at((10, 1)), [], 30, 5, 5e-6)[0] == [(1, None, None)]
    assert emit_and_evict([], at((29, 1), (24, 2)), 30, 5, 5e-6) == ([], [], at((29, 1)))


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rng = random.Random(8)
    schema = "k int, t timestamp, id bigint"
    rows = {s: [(rng.choice([1, 1, 2]), T0 + timedelta(milliseconds=rng.randrange(0, 60_000)), i + (1000 if s == "r" else 0)) for i in range(120)] for s in "lr"}
    end = [(9, T0 + timedelta(hours=h), 9000 + h) for h in (1, 2, 3)]
    for s in "lr":
        for j in range(4):
            part = [r for r in rows[s] if j * 15_000 <= (r[1] - T0).total_seconds() * 1000 < (j + 1) * 15_000]
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / s / str(j)))
        for j, e in enumerate(end):
            spark.createDataFrame([e], schema).coalesce(1).write.parquet(str(tmp_path / s / f"e{j}"))
    read = lambda s: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / s))
    # Spans of four seconds, so that a third of all records are near an edge.
    joined = stream_nearest_in_time(read("l"), read("r"), ["k"], "t", ("id", "id"), 0.5, "2 minutes", 4.0)
    q = joined.writeStream.outputMode("append").format("memory").queryName("nearest").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.left_id: r.right_id for r in spark.table("nearest").collect() if r.left_id < 1000}
    want = {}
    for k, t, i in rows["l"]:
        c = [(abs((t - u).total_seconds()), j) for q, u, j in rows["r"] if q == k and abs((t - u).total_seconds()) <= 0.5]
        want[i] = min(c)[1] if c else None
    assert got == want


def test_tables_as_streams_give_what_tables_give(spark, tmp_path):
    rng = random.Random(3)
    left = [(i, rng.choice([1, 1, 2, None]), rng.choice([None, float("nan"), 700.0]) if i % 9 == 0 else round(rng.uniform(-5, 300), 3)) for i in range(300)]
    right = [(1000 + i, rng.choice([1, 1, 2, None]), None if i % 50 == 0 else round(rng.uniform(-5, 300), 2)) for i in range(400)] + [(999, 1, 10.0), (998, 1, 10.0)]
    schemas = {"a": "lid bigint, k int, t double", "b": "rid bigint, q int, t double"}
    for s, rows in (("a", left), ("b", right)):
        spark.createDataFrame(rows, schemas[s]).repartition(3).write.parquet(str(tmp_path / s))
    args = ([("k", "q")], ("t", "t"), ("lid", "rid"), 1.5)
    want = {tuple(r) for r in nearest_in_time(*[spark.read.parquet(str(tmp_path / s)) for s in "ab"], *args).collect()}
    streams = [spark.readStream.schema(schemas[s]).parquet(str(tmp_path / s)) for s in "ab"]
    got = {tuple(r) for r in tables_as_streams(*streams, *args, str(tmp_path / "out")).collect()}
    there = {i for i, k, t in left if k is not None and t is not None and t == t}
    assert got == {r for r in want if r[0] in there} and {r[0] for r in got} == there
