import numpy as np
import pytest

from tidemark.sources import generators as G
from tidemark.sources import readers as R
from tidemark.sources import writers as W


def test_csv_by_glob(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n2,b\n")
    (tmp_path / "b.csv").write_text("x,y\nbad,c\n")
    df = R.cast_columns(R.read_strings(spark, f"{tmp_path}/*.csv", ["x", "y"]), {"x": "int"})
    assert sorted(map(tuple, df.collect()), key=str) == [(1, None), (2, "b"), (None, "c")]


def test_tsv_documents(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('7\t1\tsay "hi"\tnow\n8\t2\t\t\n')
    assert sorted(map(tuple, R.read_tsv_documents(spark, str(path)).collect())) == [(1, 'say "hi"'), (2, "")]
    path.write_text("7\t1\tok\tnow\nshort\n7\tx\tno number\t\n")
    assert [tuple(r) for r in R.read_tsv_documents(spark, str(path), strict=False).collect()] == [(1, "ok")]
    with pytest.raises(Exception, match="not a document line"):
        R.read_tsv_documents(spark, str(path)).collect()


def test_matrices(spark, tmp_path):
    (tmp_path / "m2.txt").write_text("1 2\n3  x\n")
    (tmp_path / "manifest").write_text("2 m2.txt \n\n3 m3.txt\n")
    assert sorted((r.i, r.j, r.v) for r in R.read_text_matrix(spark, str(tmp_path / "m2.txt")).collect() if r.v) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]
    assert [tuple(r) for r in R.read_manifest(spark, str(tmp_path / "manifest")).collect()] == [(2, "m2.txt"), (3, "m3.txt")]
    m = np.arange(6, dtype=np.float32).reshape(2, 3)
    W.write_bytes(spark, str(tmp_path / "m.bin"), W.binary_matrix(m))
    for by_columns, want in ((False, m), (True, m.T)):
        rows = {r.row_no: r.vec_ for r in R.read_binary_matrix(spark, str(tmp_path / "m.bin"), by_columns).collect()}
        assert [rows[i] for i in range(len(want))] == want.tolist()


def test_writers(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.9), (1, 9, 0.5)], "id1 int, id2 int, similarity double")
    W.write_pairs(pairs, str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("part-*")
    assert file.read_text() == "3\t4\t0.9\n1\t2\t0.5\n1\t9\t0.5\n"
    W.write_single_csv(pairs.orderBy("id1", "id2"), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("part-*")
    assert file.read_text() == "1 2 0.5\n1 9 0.5\n3 4 0.9\n"
    W.write_lines(pairs.limit(1), "id1", str(tmp_path / "l"))
    assert [r.value for r in R.read_lines(spark, str(tmp_path / "l")).collect()] == ["1"]
    W.write_table(pairs, str(tmp_path / "t"), ("id1",))
    assert spark.read.parquet(str(tmp_path / "t")).filter("id1 = 1").count() == 2
    assert W.result_line("m", 3, 4) == "RESULT,m,3,4"


def test_generators(spark):
    a, b = (sorted(map(tuple, G.random_strings(spark, 200, 3).repartition(n).collect())) for n in (1, 5))
    assert a == b and all(1 <= len(s) <= 25 and s.isalpha() and s.islower() for _, s in a)
    names = spark.createDataFrame([("alpha",), ("be",), ("c",), (None,)], "n string")
    fakes = [r.fake for r in G.near_misses(names, "n", 30).collect()]
    assert len(set(fakes)) == 30
    for f in fakes:
        assert any(abs(len(f) - len(n)) <= 1 and (sum(x != y for x, y in zip(f, n)) <= 2) for n in ("alpha", "be", "c"))
    assert G.near_misses(names.limit(0), "n", 5).count() == 0
    assert [r.zone for r in R.literals(spark, ("slow", "fast"), "zone").collect()] == ["slow", "fast"]


def test_near_misses_go_on_until_there_are_enough(spark):
    one = spark.createDataFrame([("ab",)], "r string")
    # Of one name of two letters 62 replacements a place, one swap and 62 appended letters can be made.
    assert G.near_misses(one, "r", 150).count() == 150
    assert 180 <= G.near_misses(one, "r", 5000).count() <= 187
    assert G.near_misses(one.limit(0), "r", 5).count() == 0


def test_first_lines_are_those_of_the_file(spark, tmp_path):
    (tmp_path / "t").write_text("".join(f"u\t{1000 - i}\ttext {i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
        assert [tuple(r) for r in R.first_lines(spark, str(tmp_path / "t"), 3).orderBy("place").collect()] == [(i + 1, f"u\t{1000 - i}\ttext {i}") for i in range(3)]
        docs = R.read_tsv_documents(spark, str(tmp_path / "t"), first=300).collect()
        assert sorted(r.doc_id for r in docs) == list(range(701, 1001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
