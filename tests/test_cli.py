import pytest

from tidemark.__main__ import main


def only(folder):
    (file,) = folder.glob("part-*")
    return file.read_text().splitlines()


def test_similar(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    (tmp_path / "docs.tsv").write_text(f"1\t10\t{text}\tx\n1\t11\t{text} from here\tx\n1\t12\tquite another text without much in common\tx\n")
    for method in ("bf", "lsh"):
        main(["similar", method, str(tmp_path / "docs.tsv"), str(tmp_path / method), "--threshold", "0.5", "--shingle-length", "5", "--shingles", "100000"])
        (line,) = only(tmp_path / method / "pairs")
        assert line.startswith("10\t11\t")
        assert spark.read.parquet(str(tmp_path / method / "classes")).count() == 3


def test_tracking(spark, data, tmp_path):
    moments = f"{data}/moments.parquet"
    main(["distance", moments, str(tmp_path / "d"), "--other", f"{data}/minutes_played.parquet"])
    main(["zones", moments, str(tmp_path / "z"), "--strict"])
    main(["teams", moments, str(tmp_path / "t"), "--other", f"{data}/play_events.parquet"])
    assert len(only(tmp_path / "z")) % 3 == 0 and len(only(tmp_path / "d")) > 300 and only(tmp_path / "t")


def test_names_and_timing(spark, tmp_path, capsys):
    (tmp_path / "names").write_text("alpha\nbeta\ngamma\n")
    main(["fakes", str(tmp_path / "names"), str(tmp_path / "f"), "--count", "20"])
    main(["bloom", str(tmp_path / "names"), str(tmp_path / "f"), "--bits", "12"])
    assert capsys.readouterr().out.strip().isdigit()
    for what in ("rotate", "rotate-blocked", "sort", "nearest"):
        main(["time", what, "--size", "12", "--repeats", "1"])
        assert capsys.readouterr().out.startswith(f"RESULT,{what},12,")
    with pytest.raises(SystemExit):
        main(["time", "nothing"])
