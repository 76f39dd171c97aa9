import math
import random

import numpy as np

from tidemark.llm.membership import BloomChain, ChainParams, seen_before, seen_in_history


def brute(rows):
    known = {r for _, r, _ in rows if r is not None}
    out = {}
    for i, _, f in rows:
        out[i] = f is not None and (f in known or any(g is not None and i is not None and g < i and h == f for g, _, h in rows))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["ann", "Ann", "bo ", None, f"r{i % 40}"]), "hot" if i % 3 == 0 else rng.choice([None, "", "ann", "bo", "é", "é", f"n{rng.randrange(300)}"])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "gen_id bigint, real_username string, fake_username string").repartition(4)
    got = {r.gen_id: r.seen for r in seen_before(df).collect()}
    assert got == brute(rows)
    assert max(r.error_bound for r in seen_before(df).collect()) <= 1e-6
    report = seen_before(df, report=True).collect()
    assert sum(r.keys for r in report) == len({x for _, a, b in rows for x in (a, b) if x is not None})
    assert all(r.error_estimate <= 1e-6 for r in report)


def test_empty_and_without_known(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (3, "b", None)], "gen_id bigint, real_username string, fake_username string")
    assert seen_before(df.limit(0)).count() == 0
    assert {r.gen_id: r.seen for r in seen_before(df, known=None).collect()} == {1: False, 2: True, 3: False}


def test_chain_grows_and_keeps_its_bound():
    rng = np.random.default_rng(1)
    h, g, h2, g2 = (rng.integers(0, 2**63, 60_000).astype(np.uint64) for _ in range(4))
    chain = BloomChain(ChainParams(error=0.01, first_capacity=500))
    assert not chain.see(h[:1], g[:1])[0] and chain.see(h[:1], g[:1])[0]
    assert chain.see(h, g).mean() < 0.02
    assert len(chain.layers) > 5 and chain.see(h, g).all()
    assert chain.contains(h2, g2).mean() <= 0.01 and chain.bound <= 0.01 and chain.estimate <= 0.01
    sizes = [x.capacity for x in chain.layers]
    assert sizes == [500 * 2**i for i in range(len(sizes))] and all(math.isclose(a.error, 2 * b.error) for a, b in zip(chain.layers, chain.layers[1:]))


def test_repeats_inside_one_array():
    chain = BloomChain()
    h = np.array([5, 6, 5, 5, 7], np.uint64)
    assert chain.see(h, h).tolist() == [False, False, True, True, False]


def test_stored_chains_go_on(spark):
    rng = random.Random(12)
    names = [f"n{rng.randrange(900)}" if rng.random() < 0.6 else "hot" for _ in range(3000)]
    rows = [(i, x if i % 97 else None) for i, x in enumerate(names)]
    chains, got, known = None, {}, set()
    for part in (rows[:1000], rows[1000:1001], [], rows[1001:]):
        df = spark.createDataFrame(part, "gen_id bigint, fake_username string").repartition(3)
        out, chains = seen_in_history(df, chains, params=ChainParams(first_capacity=16), shards=5)
        got |= {r.gen_id: r.seen for r in out.collect()}
    want = {}
    for i, x in rows:
        want[i] = x is not None and x in known
        known.add(x)
    assert got == want and chains.count() == 5


def test_chains_survive_storage():
    rng = np.random.default_rng(1)
    h, g = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    p = ChainParams(first_capacity=64)
    a = BloomChain(p)
    a.see(h[:2000], g[:2000])
    b = BloomChain.from_bytes(a.to_bytes(), p)
    assert a.see(h, g).tolist() == b.see(h, g).tolist() == [True] * 2000 + [False] * 3000
    assert a.to_bytes() == b.to_bytes() and a.bound == b.bound < 1e-6
