import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.textstats import COLUMNS, Judge, LETTERS, OrderModel, Vocabulary, _autocorrelation, ProseParams, count_pairs, text_hash, text_statistics, span_hashes

COMMON = {"en": frozenset("the of and to in a is that it was for on with as at by but be from this have not or had they were we you all there if so more when who no what about up out then because after".split()), "de": frozenset("der die das und in den von zu mit ist nicht".split())}
SENTENCE = "It was a long night for the guests, but they had no answer to the late run in the second half."
PROSE = SENTENCE + " We talked about the match after that, and all of us were sure that it had been fair. Then there was the walk home in the rain."
CASES = [
    ("prose", PROSE),
    ("prose", PROSE.upper()),
    ("prose", PROSE.replace(".", "").replace(",", "").lower()),
    ("prose", PROSE + "\n\n- salt\n- bread\n- tea"),
    ("prose", PROSE + "\nname,points\nann,3\nbo,4"),
    ("prose", "Great win. Wow!"),
    ("prose", "実験を15回繰り返したが、結果はほとんど変わらなかった。"),
    ("prose", "Der Trainer war nicht zufrieden mit der Abwehr, und das Spiel ist in den letzten Minuten von den Gästen gedreht worden."),
    ("list", "- salt\n- bread\n- tea\n- milk and honey\n- oil"),
    ("list", "1) one thing\n2) another thing\n3) a third thing\n4) the fourth"),
    ("list", SENTENCE + "\n" + "\n".join(f"{i}. item number {i} of the day" for i in range(9))),
    ("list", "salt, bread, tea, milk, honey, oil, green apples, pears"),
    ("list", "Anna\nBert\nCarla Z\nDora\nEmil\nFranz\nGerd"),
    ("list", "cache line: 32\nhash seed: 5\nwindow width: 99\nblock size: 12"),
    ("list", "Q1 11:22 shot missed by Anna\nQ1 11:02 rebound by Bert\nQ1 10:55 shot made by Carla"),
    ("table", "name   min   pts\nAnna    3     4\nBert    5     6\nCarl    7     8"),
    ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"),
    ("table", '{"a": "1", "b": "2"}\n{"a": "3", "b": "4"}\n{"a": "5", "b": ""}'),
    ("table", "1.5 2.5 -3\n4.5 5 6\n7 8 9.25"),
    ("table", "a;x y;3\nb;z;4\nc;w w;5"),
    ("junk", "ha " * 30),
    ("junk", SENTENCE + (" " + SENTENCE) * 12),
    ("junk", "T h e h o m e c r o w d w a s l o u d t o n i g h t a n d t h e n q u i e t"),
    ("junk", "#win #live #free #bet #hoops #otters #go"),
    ("junk", "%^&*( )(*&^ $#@! ~~~ {}|[] <>?? ++=="),
    ("junk", "9agh2KCwrUkWZXNhcOJ9CrLNJT2SPMvcuaQAAViFhcCgw4pPPYH0UU0eMwJ5AXeI4aNlZOBqo5jujrLKZ2bsdpE5N0XdR7ms9"),
    ("junk", "2a e2 7c d2 a5 98 c6 ce 33 c4 ef 01 75 e7 38 b9 4b ad"),
    ("junk", "\n".join(PROSE.split())),
    ("junk", "the of was long and a for to the in had it that of and is the by but the on with the to of a at was and the"),
    ("junk", "hjdp gsuodrihr rtpikfq lwqqtq leaiglkluk wtjuo tqfddspqpl wferrsfq ajllj purpgk"),
    ("junk", '<div class="r1"><span id=5></span><br/></div>\n<div class="r2"><span id=6></span><br/></div>'),
    ("blank", ""),
    ("blank", " \n\t "),
    ("blank", None),
]




@pytest.fixture(scope="module")
def measure(data):
    """Statistics of one text, by the pairs that all test documents have."""
    import pyarrow.parquet as pq

    v = Vocabulary.of(COMMON, 1000)
    pairs = count_pairs(iter([pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist()]), v)
    judge = Judge(v, *[OrderModel.of(size, keys, n, ProseParams().order_strength) for size, (_, keys, n) in zip((LETTERS, v.size), pairs)])

    def one(text):
        # Among others, so that texts mustn't touch one another.
        got = judge.measure([PROSE, None, text, "- a b\n- c d", ""])
        assert got["kind"][[0, 1, 3, 4]].tolist() == ["prose", "blank", "list", "blank"]
        return {k: x[2] for k, x in got.items()}

    return one


@pytest.mark.parametrize("i", range(len(CASES)))
def test_kinds(i, measure):
    kind, text = CASES[i]
    assert measure(text)["kind"] == kind


def test_numbers(measure):
    m = measure("The cat sat. On 3 mats!\n\nno end here")
    assert (m["n_words"], m["n_lines"], m["punctuated_lines"], m["symbol_ratio"]) == (9, 2, 0.5, 0.0)
    assert m["mean_word_length"] == sum(map(len, "The cat sat On 3 mats no end here".split())) / 9
    assert m["common_words"] == 3 / 9


def test_whole_table(spark, data):
    rows = [(i, t, "x") for i, (_, t) in enumerate(CASES)] + [(0, CASES[0][1], "x"), (99, PROSE * 2000, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string").repartition(3)
    # Among other documents, whose pairs tell what order is.
    others = spark.read.parquet(f"{data}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("z").alias("kind"))
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")
    out = text_statistics(df.unionByName(others), common).filter("doc_id < 1000")
    assert out.columns == ["doc_id", *COLUMNS] and out.count() == len(rows)
    got = {r.doc_id: r.kind for r in out.collect()}
    assert [(i, got[i]) for i, (kind, _) in enumerate(CASES) if got[i] != kind] == []
    assert text_statistics(df.limit(0), common).count() == 0
    assert text_statistics(df, common.limit(0)).count() == len(rows)


def _passage(sentences, end=". "):
    """Sentences that are all different, of many words."""
    word = lambda i: "bdfgklmnprst"[i % 12] + "aeiou"[i % 5] + "lmnrst"[i // 7 % 6] + "aeo"[i // 42 % 3] + "bdgkmnt"[i % 7] + "eiou"[i // 126 % 4] + "nrsl"[i // 504 % 4]
    one = "the {} of {} was {} and {} had {} by the {} with {}"
    return end.join(one.format(*[word(7 * i + j) for j in range(7)]) for i in range(sentences)) + end


@pytest.mark.parametrize("sentences", [20, 40, 300])
@pytest.mark.parametrize("end", [". ", " "])
def test_long_passages_repeated(sentences, end, measure):
    text = _passage(sentences, end)
    assert measure(text)["kind"] == "prose"
    assert measure(text * 8)["kind"] == "junk"
    assert measure(text * 2)["kind"] == "prose"


def test_outlines_told_by_indentation_alone(measure):
    items = _passage(12, "\n").splitlines()
    for end in (".", ""):
        outline = "\n".join(("    " if i % 3 else "") + x.capitalize() + " and went on with the other guests of the day" + end for i, x in enumerate(items))
        assert min(map(len, outline.splitlines())) > 64
        assert measure(outline)["kind"] == "list"
        assert measure(outline.replace("    ", ""))["kind"] == "prose"
    # The same words as paragraphs with indented first lines, wrapped.
    words = (PROSE + " " + _passage(30)).split()
    wrapped = "\n".join(("    " if i % 4 == 0 else "") + " ".join(words[16 * i : 16 * i + 16]) for i in range(len(words) // 16))
    assert measure(wrapped)["kind"] == "prose"


def test_two_columns_told_by_their_place(measure):
    items = _passage(8, "\n").splitlines()
    table = "\n".join(f"{x.split()[1] + ' guests':<24}{x}." for x in items)
    assert measure(table)["kind"] == "table"
    assert measure("\n".join(f"{x.split()[1]:<{8 + 3 * i}}{x}." for i, x in enumerate(items)))["kind"] == "prose"
    bars = "\n".join(f"{x.split()[1] + ' guests':<24}| {x}." for x in items)
    assert measure(bars)["kind"] == "table"


@pytest.mark.parametrize("row", ["12 34 56", "１２ ３４ ５６", "١٢ ٣٤ ٥٦", "%12 %34 %56", "/1 /2 /3"])
def test_numbers_of_any_digits_make_a_table(row, measure):
    assert measure("\n".join([row] * 2 + [row.replace(" ", " 7")]))["kind"] == "table"


def test_hashes_of_spans_are_those_of_words():
    points = np.array([ord(c) for c in "ab the xthe the"], np.int32)
    h = span_hashes(points, np.array([3, 8, 12, 0, 15]), np.array([6, 11, 15, 2, 15]))
    assert h[0] == h[1] == h[2] == text_hash("The") and h[3] == text_hash("AB") and len(set(h.tolist())) == 3
    assert text_hash("ΛΟΓΟΣ") == text_hash("λόγος".replace("ό", "ο"))


@pytest.mark.parametrize("lag", [1, 2, 5, 9, 40])
def test_periods_are_found_at_every_lag(lag):
    rng = np.random.default_rng(lag)
    shape = rng.permutation(lag + 1)[:lag] if lag > 1 else np.array([3])
    x = np.tile(shape, 4 + 12 // lag).astype(float)
    assert _autocorrelation(x, ProseParams()) > 0.9
    noise = [_autocorrelation(rng.normal(size=60), ProseParams()) for _ in range(50)]
    assert np.mean([r > 0.6 for r in noise]) < 0.05


def test_pieces_of_any_cut_give_the_same(data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist()
    judge = Judge(Vocabulary.of(COMMON, 1000))
    whole = judge.measure(texts)
    for cut in (1, 7):
        parts = [judge.measure(texts[i : i + cut]) for i in range(0, len(texts), cut)]
        for k in COLUMNS:
            assert np.concatenate([x[k] for x in parts]).tolist() == whole[k].tolist(), k
    assert all(len(x) == 0 for x in judge.measure([]).values())
