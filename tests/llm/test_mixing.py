import random

import numpy as np
import pytest

from tidemark.llm.mixing import MixParams, fit_budget, mix_checks, mix_report, mix_sources


def best(lengths, counts, budget):
    reach = {0}
    for x, n in zip(lengths, counts):
        for _ in range(n):
            reach |= {r + x for r in reach if r + x <= budget}
    return max(reach)


@pytest.mark.parametrize("window", [10, 50_000])
def test_fit_is_within_counts_and_optimal_in_the_window(window):
    rng = random.Random(window)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), 6)))
        counts = np.array([rng.randrange(0, 5) for _ in lengths])
        have = int((lengths * counts).sum())
        budget = rng.randrange(0, have + 5)
        take = fit_budget(lengths, counts, budget, window)
        assert (take >= 0).all() and (take <= counts).all()
        total = int((take * lengths).sum())
        assert total <= budget
        if window > have:
            assert total == best(lengths.tolist(), counts.tolist(), min(budget, have))


@pytest.mark.parametrize("each", [1, 3])
@pytest.mark.parametrize("share", [0.2, 0.5, 0.83])
def test_every_part_of_the_lengths_has_its_share(each, share):
    lengths, counts = np.arange(1, 3001), np.full(3000, each)
    budget = int(share * (lengths * counts).sum())
    for seed in range(5):
        take = fit_budget(lengths, counts, budget, 50_000, seed)
        assert (take * lengths).sum() == budget and (take <= counts).all() and (take >= 0).all()
        for third in np.split(take, 3):
            assert abs(third.sum() / (1000 * each) / share - 1) < 0.02


def test_lengths_beyond_the_window():
    rng = np.random.default_rng(1)
    lengths = np.r_[rng.choice(np.arange(1, 400), 300, replace=False), 90_000, 250_000, 700_000]
    counts = np.r_[rng.integers(1, 90, 300), 2, 3, 1]
    have = int((lengths * counts).sum())
    for budget in [0, 1, 39, 40_000, 89_999, 250_001, have // 3, have // 2, have - 1, have, have + 1]:
        for seed in range(3):
            take = fit_budget(lengths, counts, budget, 50_000, seed)
            assert (take <= counts).all() and (take >= 0).all()
            assert min(budget, have) - 40 <= (take * lengths).sum() <= budget, (budget, seed)


def test_even_lengths_come_as_near_as_they_can():
    take = fit_budget(np.arange(2, 2000, 2), np.full(999, 4), 800_001, 50_000)
    assert (take * np.arange(2, 2000, 2)).sum() == 800_000


def sizes(spark, n=900):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else rng.choice(["mid", "small", None]), rng.choice([0, 7, 7, 7, rng.randrange(1, 400)])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").repartition(3), rows


def targets(spark):
    rows = [("a", "big", 0.5, 1), ("a", "mid", 0.3, 2), ("a", "small", 0.2, 4), ("b", "big", 0.9, 2), ("b", "nowhere", 0.1, 3), (None, "big", 0.5, 1), ("b", "mid", None, 1)]
    return spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int")


@pytest.mark.parametrize("bucket_rows", [50_000, 20])
def test_mix(spark, bucket_rows):
    df, rows = sizes(spark)
    t = targets(spark)
    p = MixParams(bucket_rows=bucket_rows)
    chosen = mix_sources(df, t, p).collect()
    caps = {(r.mix_id, r.source): r.max_repeats for r in t.collect()}
    known = {i: (s, n) for i, s, n in rows}
    assert all(1 <= r.times <= caps[r.mix_id, r.source] and known[r.doc_id] == (r.source, r.n_tokens) and r.n_tokens > 0 for r in chosen)
    assert len({(r.mix_id, r.doc_id) for r in chosen}) == len(chosen)
    report = {(r.mix_id, r.source): r for r in mix_report(mix_sources(df, t, p), df, t).collect()}
    assert set(report) == {("a", "big"), ("a", "mid"), ("a", "small"), ("b", "big"), ("b", "nowhere")}
    for (mix, _), r in report.items():
        if mix == "a":
            assert abs(r.actual_share - r.target_share) < 0.002
    assert report["b", "nowhere"].tokens == 0 and report["b", "big"].actual_share == 1.0
    checks = {(r.mix_id, r.source): (r.available, r.capped, r.met) for r in mix_checks(mix_sources(df, t, p), df, t).collect()}
    assert checks == {k: (k[1] != "nowhere", True, True) for k in report}
    again = {(r.mix_id, r.doc_id, r.times) for r in mix_sources(df.repartition(7), t, p).collect()}
    assert again == {(r.mix_id, r.doc_id, r.times) for r in chosen}


def test_scarcest_source_sets_the_size(spark):
    df = spark.createDataFrame([(1, "x", 10), (2, "y", 100), (3, "y", 50)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("m", "x", 0.5, 3), ("m", "y", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    got = {(r.doc_id, r.times) for r in mix_sources(df, t).collect()}
    assert got == {(1, 3)} or got == {(1, 3), (3, 1)}  # of y no document fits 30 tokens
    assert mix_sources(df.limit(0), t).count() == 0 and mix_sources(df, t.limit(0)).count() == 0
