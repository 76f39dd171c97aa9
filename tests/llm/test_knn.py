import numpy as np
import pytest

from tidemark.llm.knn import AdaptiveScan, KnnParams, brute_force, nearest_vectors, rotation, similar_pairs


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vec_ array<float>, list int").repartition(3)


def exact(x, ids, k):
    out = {}
    for r in brute_force(x, ids, k).itertuples():
        out.setdefault(int(r.id), []).append((int(r.neighbour), r.distance))
    return out


def search(spark, rows, p):
    out = {}
    for r in nearest_vectors(frame(spark, rows), p=p).collect():
        out.setdefault(r.id, []).append((r.neighbour, r.distance))
    return {i: sorted(v, key=lambda t: (t[1], t[0])) for i, v in out.items()}


@pytest.mark.parametrize("part_rows", [8192, 40])
def test_recall_on_clusters_of_uneven_density(spark, part_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (12, 16))
    x = np.concatenate([c + rng.normal(0, s, (n, 16)) for c, s, n in zip(centres, np.geomspace(0.01, 2, 12), [300] + [40] * 11)]).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    p = KnnParams(k=5, dim=16, list_size=50, block=4, part_rows=part_rows)
    got = search(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)], p)
    want = exact(x, ids, 5)
    hits = sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in want)
    assert hits >= 0.99 * 5 * len(x)


def test_ties_copies_and_unusable(spark):
    grid = [[float(a), float(b), 0.0] for a in range(6) for b in range(6)]
    rows = [(i, v) for i, v in enumerate(grid)] + [(100 + i, [2.0, 2.0, 0.0]) for i in range(9)]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    p = KnnParams(k=3, dim=3, block=1, list_size=8)
    bad = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0]), (None, [0.0, 0.0, 0.0])]
    got = search(spark, [(i, v, 1) for i, v in rows + bad], p)
    assert got == exact(x, ids, 3)
    pairs = {tuple(r) for r in similar_pairs(nearest_vectors(frame(spark, [(i, v, 1) for i, v in rows]), p=p)).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i, v in got.items() for j, _ in v}


def test_few_and_none(spark):
    p = KnnParams(k=5, dim=2)
    assert search(spark, [], p) == {}
    assert search(spark, [(1, [0.0, 0.0], 0)], p) == {}
    assert search(spark, [(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [0.0, 0.0], 0)], p) == {1: [(3, 0.0), (2, 25.0)], 2: [(1, 25.0), (3, 25.0)], 3: [(1, 0.0), (2, 25.0)]}


def test_scan_abandons_and_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 48)).astype(np.float32)
    p = KnnParams(k=5)
    row, near, dist = AdaptiveScan(x, np.arange(2000), rotation(48, 1), p).search(x[:50], np.arange(50), np.full(50, np.inf))
    want = exact(x, np.arange(2000), 5) if len(x) <= 100 else None
    hits = 0
    for i in range(50):
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(near[row == i]) & set(np.argsort(d)[:5]))
    assert want is None and hits >= 0.97 * 250 and np.all(np.diff(dist[row == 3]) >= 0)


def test_a_vector_that_a_third_of_all_ids_have(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.tile(rng.normal(size=(1, 4)), (200, 1)), np.tile(rng.normal(size=(1, 4)), (3, 1)), rng.normal(size=(400, 4))]).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    got = search(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)], KnnParams(k=3, dim=4, block=2, list_size=100, part_rows=20))
    want = exact(x, ids, 3)
    assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in want.items()}


@pytest.mark.parametrize("sizes", [dict(), dict(part_rows=30, group_rows=400)])
def test_recall_where_far_more_lists_qualify_than_the_first_round_probes(spark, sizes):
    rng = np.random.default_rng(5)
    classes = [rng.normal(0, 1, (2400, 16)), rng.normal(40, 0.01, (600, 16)), rng.normal(-40, 3, (600, 16))]
    x = np.concatenate(classes).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    p = KnnParams(k=5, dim=16, list_size=20, block=4, probes=6, **sizes)
    got = search(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)], p)
    want = exact(x, ids, 5)
    kind = np.repeat(np.arange(3), [len(c) for c in classes])
    recall = [np.mean([len({a for a, _ in got[int(i)]} & {a for a, _ in want[int(i)]}) / 5 for i in ids[kind == c]]) for c in range(3)]
    assert min(recall) >= 0.99, recall
    assert all(len(v) == len({a for a, _ in v}) == 5 for v in got.values())


def test_many_lists_qualify_with_the_parameters_as_they_are(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40_000, 48)).astype(np.float32)
    p = KnnParams()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, vec_ array<float>").repartition(4)
    got = {}
    for r in nearest_vectors(rows, p=p).filter("id % 400 = 7").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    hits = 0
    for i in range(7, len(x), 400):
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got[i] & set(np.argsort(d)[:5]))
    assert hits >= 0.97 * 5 * len(got) and len(got) == 100
