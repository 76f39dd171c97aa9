"""Sources mixed to target weights by fitting token budgets.

Documents are counted by source and exact token length.  From the counts alone
each source's budget is met: whole rounds of the source first, then the same
share of every length, and the rest by a bounded knapsack over what is left.
Which documents of a length are taken is a matter of a seeded hash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut


@dataclass(frozen=True)
class MixParams:
    """``total`` tokens of a mix (None: as many as the scarcest source allows); ``window``: tokens at most that are left to the knapsack."""

    total: int | None = None
    window: int = 50_000
    seed: int = 11
    bucket_rows: int = 50_000


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that they add up to ``budget``, or as near below it as can be.

    ``lengths`` are positive and different.  Of every length the same share is taken, rounded along the lengths in order
    from a seeded start, so that any part of the lengths has its share of the selection to one document.  What the
    rounding leaves, some documents' worth, is a bounded knapsack over what wasn't taken, longer and shorter lengths by
    turns of a seeded lot; a source within the ``window`` is a knapsack as a whole if that comes nearer.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    have = int((lengths * counts).sum())
    if budget >= have:
        return counts.copy()
    rng = np.random.default_rng(seed)
    longest = int(lengths[counts > 0].max())
    take = _spread_share(lengths, counts, max(0.0, budget - min(window, 4 * longest)) / have, float(rng.random()))
    left = budget - int((take * lengths).sum())
    while left < 0:  # by less than the longest document
        there = np.flatnonzero(take > 0)
        enough = there[lengths[there] >= -left]
        i = enough[lengths[enough].argmin()] if len(enough) else there[lengths[there].argmax()]
        take[i] -= 1
        left += int(lengths[i])
    while left > window:
        fits = np.flatnonzero((take < counts) & (lengths <= left))
        if not len(fits):
            break
        more = (counts - take)[fits]
        i = fits[rng.choice(len(fits), p=more / more.sum())]
        take[i] += 1
        left -= int(lengths[i])
    more = _knapsack(lengths, counts - take, left, rng)
    missing = left - int((more * lengths).sum())
    if missing and have <= window:
        whole = _knapsack(lengths, counts, budget, rng)
        if budget - int((whole * lengths).sum()) < missing:
            return whole
    return take + more


def _spread_share(lengths: np.ndarray, counts: np.ndarray, share: float, start: float) -> np.ndarray:
    """The same share of every length in whole documents: what one length rounds off, the next ones in order make up for."""
    order = np.argsort(lengths, kind="stable")
    upto = np.floor(np.cumsum(counts[order]) * share + start)
    take = np.zeros_like(counts)
    take[order] = np.diff(np.r_[np.floor(start), upto]).astype(np.int64)
    return np.minimum(take, counts)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """The bounded knapsack: counts of each length, no more than there are, with the largest sum up to ``budget``."""
    take = np.zeros_like(counts)
    # Lengths by lot, those of many documents sooner.
    lot = np.where(counts > 0, rng.exponential(size=len(counts)) / np.maximum(counts, 1), np.inf)
    # Reachable sums as the bits of a number; every piece of a length's count doubles the one before.
    mask = (1 << (budget + 1)) - 1
    bits, steps = 1, []
    for i in np.argsort(lot, kind="stable"):
        n, length, piece = min(int(counts[i]), budget // int(lengths[i])), int(lengths[i]), 1
        while n > 0 and not bits >> budget & 1:
            piece = min(piece, n)
            steps.append((bits, i, piece))
            bits |= bits << (piece * length) & mask
            n -= piece
            piece *= 2
        if bits >> budget & 1:
            break
    at = bits.bit_length() - 1
    for before, i, piece in reversed(steps):
        if not before >> at & 1:
            take[i] += piece
            at -= piece * int(lengths[i])
    return take


def plan_mixes(sizes: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """For each mix, source and length: ``rounds`` (times all of the source is used) and ``extra`` (documents used once more).

    Each (mix, source) is planned by one task from its counts by length, whose number is that of different lengths.
    """
    hist = sizes.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    have = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("available"))
    wanted = targets.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    room = F.when((F.col("target_share") > 0) & (F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("max_repeats") * F.col("available") / F.col("target_share"))
    limit = F.min(room).over(Window.partitionBy("mix_id"))
    total = F.coalesce(F.floor(limit), F.lit(0)) if p.total is None else F.least(F.lit(p.total).cast("bigint"), F.coalesce(F.floor(limit), F.lit(0)))
    wanted = wanted.withColumn("budget", F.least(F.round(total * F.col("target_share")).cast("bigint"), F.col("max_repeats") * F.col("available")))
    wanted = wanted.filter("budget > 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, docs = pdf["n_tokens"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
        order = np.argsort(lengths)
        lengths, docs = lengths[order], docs[order]
        have, budget = int((lengths * docs).sum()), int(pdf["budget"].iloc[0])
        rounds = budget // have
        mix, source = pdf["mix_id"].iloc[0], pdf["source"].iloc[0]
        extra = fit_budget(lengths, docs, budget - rounds * have, p.window, p.seed + zlib.crc32(f"{mix}\0{source}".encode()))
        return pd.DataFrame({"mix_id": mix, "source": source, "n_tokens": lengths, "rounds": rounds, "extra": extra})

    return (
        wanted.select("mix_id", "source", "budget").join(hist, "source").groupBy("mix_id", "source").applyInPandas(fit, "mix_id string, source string, n_tokens bigint, rounds bigint, extra bigint")
    )


def clean_targets(targets: DataFrame) -> DataFrame:
    """Targets that can be met: named mix and source, a positive share; several rows of one source add up, with the largest cap."""
    return (
        targets.filter("mix_id is not null and source is not null and target_share > 0 and not isnan(target_share)")
        .groupBy("mix_id", "source")
        .agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("bigint").alias("max_repeats"))
    )


def mix_sources(sizes: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The selection: ``mix_id``, ``source``, ``doc_id``, ``n_tokens`` and ``times`` (1 to max_repeats) of each document used.

    ``sizes`` has ``doc_id``, ``source`` and ``n_tokens``; documents without source or tokens are in no mix.  ``targets``
    has ``mix_id``, ``source``, ``target_share`` and ``max_repeats``.  A mix is as large as its scarcest source allows at
    its share and cap; a source without documents bounds nothing and has no part.  Each source comes as near below its
    budget as its documents' lengths allow, most often to the token.  Repeated rows of a document count as different
    documents.  The same seed gives the same selection.
    """
    sizes = sizes.filter("source is not null and n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    targets = clean_targets(targets)
    plan = cut(plan_mixes(sizes, targets, p))
    ranked = _ranked(sizes, p)
    times = F.col("rounds") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return ranked.join(plan, ["source", "n_tokens"]).select("mix_id", "source", "doc_id", "n_tokens", times.cast("int").alias("times")).filter("times > 0")


def _ranked(sizes: DataFrame, p: MixParams) -> DataFrame:
    """Documents with their place among those of equal source and length, by a seeded hash.

    Lengths with very many documents are ranked in buckets of the hash, whose counts give the places before each.
    """
    share = F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    key = ["source", "n_tokens"]
    big = (
        sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > p.bucket_rows)
        .select(*key, F.ceil(F.col("docs") / p.bucket_rows).alias("buckets"))
    )
    docs = sizes.join(big, key, "left").withColumn("share", share).withColumn("bucket", F.floor(F.col("share") * F.coalesce("buckets", F.lit(1))).cast("int"))
    before = (
        docs.filter("buckets is not null").groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.sum("c").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .drop("c")
    )
    place = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("share", "doc_id"))
    return docs.withColumn("place", place).join(before, [*key, "bucket"], "left").select("doc_id", *key, (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"))


def mix_report(selection: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of tokens, tokens available and used, documents used, and the most repeats."""
    have = sizes.filter("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = selection.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").cast("bigint").alias("most_repeats")
    )
    out = clean_targets(targets).join(have, "source", "left").join(used, ["mix_id", "source"], "left").na.fill(0, ["available_tokens", "tokens", "documents", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0))).select(
        "mix_id", "source", "target_share", "actual_share", "max_repeats", "most_repeats", "available_tokens", "tokens", "documents"
    )


def mix_checks(selection: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each mix and source, what must hold: ``capped`` (no document more often than allowed) and ``met`` (no document left
    over fits what is missing to the budget that the scarcest source leaves it, nor is the budget exceeded); and ``available``,
    whether the source has tokens at all."""
    report = mix_report(selection, sizes, targets)
    some = F.col("available_tokens") > 0
    room = F.when(some & (F.col("max_repeats") > 0), F.col("max_repeats") * F.col("available_tokens") / F.col("target_share"))
    total = F.coalesce(F.floor(F.min(room).over(Window.partitionBy("mix_id"))), F.lit(0))
    budget = F.least(F.round(total * F.col("target_share")).cast("bigint"), F.col("max_repeats") * F.col("available_tokens"))
    report = report.withColumns({"short": budget - F.col("tokens"), "times": F.coalesce(F.floor(F.try_divide("tokens", "available_tokens")), F.lit(0)) + 1})
    lengths = sizes.filter("source is not null and n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    used = selection.groupBy("mix_id", "source", "n_tokens").agg(F.sum("times").alias("used"))
    free = report.select("mix_id", "source", "times").join(lengths, "source").join(used, ["mix_id", "source", "n_tokens"], "left")
    free = free.filter(F.coalesce("used", F.lit(0)) < F.col("docs") * F.col("times")).groupBy("mix_id", "source").agg(F.min("n_tokens").alias("shortest"))
    met = (F.col("short") >= 0) & (F.col("short") < F.coalesce("shortest", F.col("short") + 1))
    return report.join(free, ["mix_id", "source"], "left").select("mix_id", "source", some.alias("available"), (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), met.alias("met"))
