"""Hand-worked cases of the tracking, similarity, sketch, matrix and sorting operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import char_at, clock_seconds, hoop_distance, jaccard, rebound_count, zone
from tidemark.functions.murmur import murmur2_32, murmur2_32_many, murmur2_64, murmur2_64_of
from tidemark.operators import bloom, matrix, segments, sorting
from tidemark.operators import similarity as S
from tidemark.operators.tracking import shot_clock_context


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def path(spark, clock):
    return spark.createDataFrame([(1, i, float(c)) for i, c in enumerate(clock)], "p int, o int, clock double")


def test_gaps(spark):
    df = path(spark, [100, 99, 60, 20, 19])
    assert [r[0] for r in values(segments.gap_segments(df, ["p"], ["o"], "clock").orderBy("o"), "segment")] == [0, 0, 1, 1, 1]
    assert [r[0] for r in values(segments.gap_segments(df, ["p"], ["o"], "clock", rising_edge=False).orderBy("o"), "segment")] == [0, 0, 1, 2, 2]


def test_steps_and_average(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0), (2, 3, 9.0, 9.0), (2, 4, None, 9.0)], "s int, o int, x double, y double")
    assert [r[0] for r in values(segments.step_distance(df, ["s"], ["o"]).orderBy("o"), "step")] == [0, 5, 0, 0, None]
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 13)], "p int, o int, v double")
    assert [r[0] for r in values(segments.moving_average(df, ["p"], ["o"], "v").orderBy("o"), "moving_avg")][9:] == [5.5, 6.5, 7.5]


def test_zones_and_runs(spark):
    df = spark.createDataFrame([(1.99,), (2.0,), (7.0,), (7.01,), (None,)], "v double")
    assert [r[0] for r in values(df.select(zone(F.col("v")).alias("z")), "z")] == ["slow", "normal", "normal", "fast", "normal"]
    df = spark.createDataFrame([(1, i, z) for i, z in enumerate(["slow", "fast", "slow"])], "p int, o int, zone string")
    assert [r[0] for r in values(segments.zone_runs(df, ["p"], ["o"]).orderBy("o"), "run_id")] == [0, 1, 2]


def test_shot_clock_context(spark):
    def ctx(clocks, strict=False):
        rows = [(1, i, i, v) for i, v in enumerate(clocks)]
        df = spark.createDataFrame(rows, "k int, recorded_at int, moment_id int, shot_clock double")
        return values(shot_clock_context(df, ("k",), strict).orderBy("moment_id"), "none_so_far", "before", "next_known")

    assert [r[0] for r in ctx([None, 24.0, None])] == [True, False, False]
    assert [r[0] for r in ctx([None, 24.0, None], strict=True)] == [False] * 3
    assert [r[2] for r in ctx([24.0, None, None])] == [None] * 3
    assert [r[2] for r in ctx([24.0, None, 20.0])] == [20.0, 20.0, None]


def test_scalars(spark):
    df = spark.createDataFrame([("X REBOUND (Off:2 Def:11)", "11:05"), ("Team Rebound", "x:1"), (None, None)], "d string, c string")
    assert values(df.select(rebound_count(F.col("d"), 1).alias("o"), rebound_count(F.col("d"), 2).alias("f"), clock_seconds(F.col("c")).alias("s")), "*") == [(2, 11, 665.0), (None, None, None), (None, None, None)]
    df = spark.createDataFrame([(1.6764, 7.62), (14.3256, 7.62)], "x double, y double")
    assert [round(r[0], 4) for r in values(df.select(hoop_distance(F.col("x"), F.col("y"))), "*")] == [0, 12.6492]
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in values(df.select(jaccard(F.col("a"), F.col("b"))), "*")] == [0.5, None]
    df = spark.createDataFrame([("ab",), ("",)], "s string")
    assert [r[0] for r in values(df.select(char_at(F.col("s"), 1)), "*")] == [98, -1]


def scalar_murmur(data, seed):
    m, h = 0x5BD1E995, (seed ^ len(data)) & 0xFFFFFFFF
    i = 0
    while len(data) - i >= 4:
        k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
        k = (k ^ k >> 24) * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ k
        i += 4
    if len(data) > i:
        h = (h ^ int.from_bytes(data[i:], "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_murmur(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcdefghi", "ünïcode ☃ 😀", "x" * 1000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, one, two, many, wide in values(df, "i", murmur2_32(F.col("t"), 7), murmur2_32(F.col("t"), 0), murmur2_32_many(F.col("t"), [0, 7]), murmur2_64(F.col("t"), 7)):
        t = texts[i]
        want = [None if t is None else scalar_murmur(t.encode(), s) for s in (7, 0)]
        assert [one, two] == want
        assert (many if t is None else [many[1], many[0]]) == (None if t is None else want)
        assert wide == (None if t is None else murmur2_64_of(t.encode(), 7))
    ids, ends = S.shingle_ids(["ab", None, "abcabc", "ünï"], S.ShingleParams(3, 1000, 5))
    hashed = lambda g: (lambda h: (1 << 32) - h if h >> 31 else h)(scalar_murmur(g.encode(), 5)) % 1000
    assert ends.tolist() == [0, 0, 0, 3, 4]
    assert ids[:3].tolist() == sorted(hashed(g) for g in ("abc", "bca", "cab")) and ids[3] == hashed("ünï")


def test_parameters():
    assert [S.least_prime(n) for n in (100, 200, 2000, 10000, 300000, 5000000)] == [103, 229, 2029, 10141, 311713, 5208523]
    assert S.prime_table()[-1] == 2147483647
    d = S.Draws(42)
    assert [d.below(2147483647), d.below(2147483647)] == [1562431130, 117392763]
    assert [S.LshParams(hashes=n, threshold=t).required for n, t in ((12, 0.9), (20, 0.9), (10, 0.8), (20, 0.8))] == [11, 18, 9, 17]
    assert [S.LshParams(hashes=n, bands=b).used_bands for n, b in ((12, 5), (7, 3), (12, 4))] == [4, 1, 4]
    for bad in (dict(threshold=1.0), dict(threshold=0.0), dict(hashes=0), dict(bands=0)):
        with pytest.raises(ValueError):
            S.LshParams(**bad)


def texts(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the bear"
    rows = [(1, base), (2, base), (3, base + "!"), (4, "something else entirely, with other words"), (5, ""), (6, None), (7, "abc"), (8, base + "!?"), (None, base)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_jaccard_is_exact(spark):
    sets = S.shingles(texts(spark))
    rows = {r.doc_id: set(r.shingles) for r in sets.filter("doc_id is not null").collect()}
    want = {(a, b): len(rows[a] & rows[b]) / len(rows[a] | rows[b]) for a in rows for b in rows if a < b and rows[a] | rows[b]}
    got = {(r.id1, r.id2): r.similarity for r in S.jaccard_pairs(sets, 0.8).collect()}
    assert got == {k: v for k, v in want.items() if v > 0.8 and 2 not in k}  # 2 is a copy of 1
    assert dict(values(S.membership(sets, "shingles"), "doc_id", "class_id")) == {None: 1, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}


@pytest.mark.parametrize("strict", [False, True])
def test_lsh_finds_all_agreeing_pairs(spark, strict):
    p = S.LshParams(hashes=12, bands=6, threshold=0.6)  # five values may differ: one of six bands agrees
    sig = S.signatures(texts(spark).filter("doc_id is not null"), p=p)
    rows = {r.doc_id: r.signature for r in sig.collect()}
    agree = {(a, b): sum(x == y for x, y in zip(rows[a], rows[b])) for a in rows for b in rows if a < b and rows[a] != rows[b]}
    got = {(r.id1, r.id2): r.similarity for r in S.lsh_pairs(sig, p, strict).collect()}
    copies = {2, 6, 7}
    assert got == {k: (n if strict else p.required) / 12 for k, n in agree.items() if n >= p.required and not copies & set(k)}
    links = {r.doc_id: r.links for r in S.link_counts(S.lsh_pairs(sig, p), S.membership(sig, "signature")).collect()}
    assert links == {a: sum(1 for b in rows if b != a and sum(x == y for x, y in zip(rows[a], rows[b])) >= p.required) for a in rows}


def test_bloom(spark):
    names = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "n string")
    for b, k in ((4, 1), (10, 5)):
        bits = bloom.build(names, "n", b, k)
        assert {r.n for r in bloom.probe(bits, names, "n", b, k).collect()} == {"a", "b"}  # members are always found
    assert values(spark.range(1).select(bloom.theoretical_rate(F.lit(2.0), F.lit(1), F.lit(1))), "*") == [(0.5,)]
    assert bloom.build(names.limit(0), "n", 10, 3).count() == 0


def test_rotation(spark):
    rows = spark.createDataFrame([("m", 0, [1.0, 2.0, 3.0]), ("m", 1, [4.0, 5.0, 6.0]), ("m", 2, [7.0, 8.0, 9.0]), ("n", 0, None), ("n", 1, [])], "matrix_name string, row_no int, vec_ array<float>")
    c, h = matrix.cells(rows), matrix.heights(rows)
    turned = {(r.i, r.j): r.v for r in matrix.rotate90(c, h).collect()}
    assert [[turned[i, j] for j in range(3)] for i in range(3)] == [[7, 4, 1], [8, 5, 2], [9, 6, 3]]
    pieces = {(r.i, r.block): r.piece for r in matrix.rotate90_blocked(c, h, 2).collect()}
    assert pieces == {(0, 0): [7, 4], (0, 1): [1], (1, 0): [8, 5], (1, 1): [2], (2, 0): [9, 6], (2, 1): [3]}
    with pytest.raises(ValueError):
        matrix.rotate90_blocked(c, h, 0)


def test_nearest(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [1.0])], "vec_id bigint, v array<float>")
    got = {r.vec_id: r.nearest for r in matrix.nearest_rows(rows, rows, "vec_id", "v", 2, block=2).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 4: -1}
    alone = rows.filter("vec_id = 0")
    assert values(matrix.nearest_rows(alone, alone, "vec_id", "v", 2), "nearest") == [(-1,)]
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<float>")
    got = {r.vec_id: r.nearest for r in matrix.nearest_rows(df, df, "vec_id", "v", 3, block=16).collect()}
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == int(d.argmin())


def test_sorting(spark):
    words = ["b", "a", "ab", "B", "", None, "a"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id bigint, w string")
    got = sorted(values(sorting.byte_sort(df, "w", "id"), "place", "w", "id"))
    assert [(w, i) for _, w, i in got] == [("", 4), ("B", 3), ("a", 1), ("a", 6), ("ab", 2), ("b", 0), (None, 5)]
    assert [p for p, _, _ in got] == list(range(1, 8))
    assert sorted(values(sorting.count_sort_starts(df, "w", 0), "code", "n", "start")) == [(-1, 1, 0), (66, 1, 1), (97, 3, 2), (98, 1, 5)]


def test_whole_sweep(spark, data):
    from tidemark.plans import registry

    rows = {(r.b, r.k): r for r in registry.queries()["bloom_sweep_whole"](spark, data).collect()}
    assert set(rows) == {(b, k) for b in range(12, 21) for k in range(1, 21)}
    names = spark.read.parquet(f"{data}/fake_usernames_gen.parquet")
    probes = bloom.others(names, "fake_username", names, "real_username")
    for b, k in [(12, 20), (13, 9)]:
        found = bloom.probe(bloom.build(names, "real_username", b, k), probes, "fake_username", b, k)
        assert (rows[b, k].positives, rows[b, k].probes) == (found.count(), probes.count())
    rates = registry.queries()["bloom_sweep_rates_whole"](spark, data)
    assert rates.count() == 180


@pytest.mark.parametrize("block", [100, 2048])
def test_a_hot_key_meets_in_blocks(spark, block):
    # 10 000 rows of one key and some of others; of all pairs those of near numbers are kept, so that the test ends.
    rows = spark.range(10_000).selectExpr("id", "1 as k", "id % 7 as v").union(spark.range(300).selectExpr("id + 20000", "id % 50 + 2", "id % 7")).repartition(4)
    met = S.meetings(rows, "id", "k", ("v",), pair="id1 < id2 and id2 - id1 <= 2", block=block)
    got = met.filter("id1 < 20000").agg(F.count(F.lit(1)), F.count_distinct("id1", "id2"), F.count_if(F.col("v1") == F.col("id1") % 7)).first()
    assert tuple(got) == (19_997, 19_997, 19_997)
    met = S.meetings(rows, "id", "k", block=block).filter("id1 >= 20000")
    assert met.count() == 50 * 15 and met.filter("(id2 - id1) % 50 != 0").count() == 0
    late = S.meetings(rows.filter("k > 1"), "id", "k", first="id >= 20100", block=block)
    assert late.count() == 50 * 6


def test_many_near_copies_lose_no_pair(spark):
    rng = random.Random(9)
    base = list(range(1000, 1060))
    sets = [(i, sorted({*rng.sample(base, 57), 2000 + i, *rng.sample(range(3000, 3040), rng.randrange(0, 9))})) for i in range(250)] + [(300, []), (301, [5])]
    df = spark.createDataFrame(sets, "doc_id bigint, shingles array<int>").repartition(3)
    got = {(r.id1, r.id2): r.similarity for r in S.jaccard_pairs(df, 0.85).collect()}
    want = {}
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and (s := len({*a} & {*b}) / len({*a} | {*b})) > S.single(0.85):
                want[i, j] = s
    assert len(want) > 1000 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def shuffled(spark):
    """Bytes of shuffles that all executors have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("spread", [1, 1_300_001])  # elements beyond the table of counts too
def test_sets_of_common_phrases_move_little(spark, monkeypatch, spread):
    # Each set has 30 of 150 phrases of eight elements, so every element is in hundreds of sets, and few pairs are alike.
    rng = np.random.default_rng(5)
    rows = [sorted({int(8 * p + i) for p in rng.choice(150, rng.integers(20, 41), replace=False) for i in range(8)}) for _ in range(1200)]
    rows += [sorted({*rng.choice(r, len(r) - int(k)).tolist(), *r[: len(r) - int(k)], *range(1200, 1200 + int(k) // 2)}) for r in rows[:60] for k in (3, 25)] + rows[:40] + [[7], [7, 8]]
    df = spark.createDataFrame([(i, [e * spread for e in r]) for i, r in enumerate(rows)], "doc_id bigint, shingles array<int>").repartition(3)
    m = np.zeros((len(rows), 1300), np.float32)
    for i, r in enumerate(rows):
        m[i, r] = 1
    n, both = m.sum(1), m @ m.T
    least = {tuple(r): i for i, r in reversed(list(enumerate(rows)))}
    want = {(i, j): both[i, j] / (n[i] + n[j] - both[i, j]) for i, j in zip(*np.nonzero(np.triu(both / (n[:, None] + n - both) > S.single(0.8), 1))) if least[tuple(rows[i])] == i and least[tuple(rows[j])] == j}
    assert len(want) > 60
    for block in (S.BLOCK, 20_000):  # one block of each class of sizes, and several
        monkeypatch.setattr(S, "BLOCK", block)
        before = shuffled(spark)
        got = {(r.id1, r.id2): r.similarity for r in S.jaccard_pairs(df, 0.8).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        assert shuffled(spark) - before < 4 * 4 * sum(map(len, rows))


@pytest.mark.parametrize("prime, domain", [(1_004_119, 1_000_000), (1_004_119, 400_000), (103, 103), (2_147_483_647, 2_000_000_000)])
def test_least_hashes(prime, domain):
    rng = np.random.default_rng(prime)
    # Multiples of the prime and their neighbours too, where a rounded quotient is off.
    ids = np.r_[rng.integers(0, 1_000_000, 3000), np.arange(50) * prime % 2_000_000, 0, 1]
    begin = np.array([0, 1, 700, 3000])
    family = [(int(rng.integers(1, 2**31)), int(rng.integers(0, 2**31))) for _ in range(20)] + [(1, 0), (prime, prime), (prime - 1, 1)]
    got = S.least_hashes(ids, begin, family, prime, domain)
    for g, part in enumerate(np.split(ids, begin[1:])):
        assert got[g].tolist() == [min((a * int(x) + b) % prime % domain for x in part) for a, b in family]
