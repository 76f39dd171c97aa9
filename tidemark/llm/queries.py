"""Queries of this folder, each on the whole of its tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, ensure_checkpoint_dir, load
from .knn import nearest_vectors, similar_pairs
from .membership import seen_before, seen_in_history
from .mixing import mix_checks, mix_report, mix_sources
from .nearest_stream import tables_as_streams
from .nearest_time import nearest_in_time
from .runs import collapse_runs
from .textstats import text_statistics
from .tokens import count_tokens, decode_ids, encode_texts

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which at least one is among the 5 nearest of the other."""
    return similar_pairs(nearest_vectors(load(spark, d, "matrix")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name was there before."""
    return seen_before(load(spark, d, "fake_usernames_gen")).filter("seen").select("gen_id")


def p5_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same by stored chains: the known names first, then, from their chains alone, the generated ones."""
    names = load(spark, d, "fake_usernames_gen")
    _, chains = seen_in_history(names, None, key="real_username")
    return seen_in_history(names, chains)[0].filter("seen").select("gen_id")


def p5_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The chains at the end of the table: layers, fill, and the rate of wrong answers."""
    return seen_before(load(spark, d, "fake_usernames_gen"), report=True)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    keys = [("game_id", "game_id"), ("period", "quarter"), ("player1_id", "player_id")]
    return nearest_in_time(load(spark, d, "play_events"), load(spark, d, "moments"), keys, ("game_clock", "game_clock"), ("play_id", "moment_id"), 1.5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Events with their nearest moment, where there is one."""
    return _matched(spark, d).filter("right_id is not null").select(F.col("left_id").alias("play_id"), F.col("right_id").alias("moment_id"))


def p6_matched(spark: SparkSession, d: str) -> DataFrame:
    """All events with their nearest moment and its distance, or none."""
    return _matched(spark, d).select(F.col("left_id").alias("play_id"), F.col("right_id").alias("moment_id"), F.round("gap", 6).alias("gap"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; one that is a single file is found by its name in the folder."""
    table = load(spark, d, name)
    read = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return read.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return read.parquet(os.path.join(d, f"{name}.parquet"))


def p6_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events with their nearest moment, by the stateful join of the two tables as streams."""
    keys = [("game_id", "game_id"), ("period", "quarter"), ("player1_id", "player_id")]
    folder = os.path.join(ensure_checkpoint_dir(spark), f"tidemark-{uuid.uuid4().hex}")
    rows = tables_as_streams(_stream(spark, d, "play_events"), _stream(spark, d, "moments"), keys, ("game_clock", "game_clock"), ("play_id", "moment_id"), 1.5, folder, 240.0)
    return rows.filter("right_id is not null").select(F.col("left_id").alias("play_id"), F.col("right_id").alias("moment_id"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    ball = load(spark, d, "moments").filter("player_id = -1")
    return collapse_runs(ball, ["game_id", "quarter", "event_id"], "recorded_at", "moment_id", "shot_clock")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last row of each run."""
    return _runs(spark, d).select(F.col("first_id").alias("first_moment_id"), F.col("last_id").alias("last_moment_id"))


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run as one row, with count and duration."""
    return _runs(spark, d).select("game_id", "quarter", "event_id", F.col("first_id").alias("first_moment_id"), "run_length", F.round("duration", 6).alias("duration"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(load(spark, d, "documents"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of every document."""
    return count_tokens(load(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether decoding their ids gives the text again."""
    docs = load(spark, d, "documents")
    back = decode_ids(encode_texts(docs)).withColumnRenamed("text", "decoded")
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text").join(back, "doc_id").groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return cut(count_tokens(load(spark, d, "documents"), carry=("source",)))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return mix_sources(_sizes(spark, d), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual shares of each mix."""
    sizes, targets = _sizes(spark, d), load(spark, d, "mix_targets")
    return mix_report(mix_sources(sizes, targets), sizes, targets)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the actual shares of each mix."""
    sizes, targets = _sizes(spark, d), load(spark, d, "mix_targets")
    return mix_checks(cut(mix_sources(sizes, targets)), sizes, targets)


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and kind of every document."""
    return text_statistics(load(spark, d, "documents"), load(spark, d, "common_words"))


def p10_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts and ratios of every document."""
    return p10_stats(spark, d).select("doc_id", "n_chars", "n_words", "n_lines", *[F.round(x, 6).alias(x) for x in ("mean_word_length", "punctuated_lines", "common_words")])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no natural prose."""
    return p10_stats(spark, d).filter("kind in ('list', 'table', 'junk')").select("doc_id")


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p5_found": p5_found,
    "p5_error_rate": p5_error_rate,
    "p5_resumed": p5_resumed,
    "p6_found": p6_found,
    "p6_matched": p6_matched,
    "p6_stream": p6_stream,
    "p7_found": p7_found,
    "p7_runs": p7_runs,
    "p8_ids": p8_ids,
    "p8_lengths": p8_lengths,
    "p8_round_trip": p8_round_trip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_stats": p10_stats,
    "p10_ratios": p10_ratios,
}

_NEAREST = """
    WITH m AS (SELECT * FROM moments WHERE game_clock IS NOT NULL AND NOT isnan(game_clock)),
    pairs AS (
        SELECT play_id, moment_id, abs(e.game_clock - m.game_clock) AS gap
        FROM play_events e JOIN m ON e.game_id = m.game_id AND e.period = m.quarter AND e.player1_id = m.player_id
        WHERE abs(e.game_clock - m.game_clock) <= 1.5
    ), best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY play_id ORDER BY gap, moment_id) = 1)"""
_RUNS = """
    WITH b AS (
        SELECT *, CASE WHEN isnan(shot_clock) THEN NULL ELSE CAST(round(shot_clock * 100) AS BIGINT) END AS v FROM moments WHERE player_id = -1
    ), l AS (
        SELECT *, lag(v) OVER w AS pv, lag(moment_id) OVER w AS pid FROM b WINDOW w AS (PARTITION BY game_id, quarter, event_id ORDER BY recorded_at, moment_id)
    ), s AS (
        SELECT *, sum(CASE WHEN pid IS NULL OR (v IS NULL) <> (pv IS NULL) OR abs(v - pv) > 5 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY game_id, quarter, event_id ORDER BY recorded_at, moment_id ROWS UNBOUNDED PRECEDING) AS run FROM l
    ), r AS (
        SELECT game_id, quarter, event_id, arg_min(moment_id, (recorded_at, moment_id)) AS first_moment_id, arg_max(moment_id, (recorded_at, moment_id)) AS last_moment_id,
               count(*) AS run_length, round((epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 1e6, 6) AS duration
        FROM s GROUP BY game_id, quarter, event_id, run HAVING count(*) >= 3
    )"""

ORACLES: dict[str, str] = {
    "p8_round_trip": "SELECT true AS same, count(*) AS documents FROM documents",
    "p10_ratios": r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') AS w,
          list_filter(regexp_split_to_array(t, '[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\s\p{Z}\x00-\x08\x0b\x1c-\x1f\p{Mn}\p{Me}\p{Cf}]')) AS l FROM t),
    c AS (SELECT doc_id, lang, count(*) AS n FROM (SELECT doc_id, replace(lower(unnest(w)), 'ς', 'σ') AS x FROM w)
          JOIN (SELECT DISTINCT lang, replace(lower(word), 'ς', 'σ') AS x FROM common_words WHERE lang IS NOT NULL) USING (x) GROUP BY 1, 2),
    m AS (SELECT doc_id, max(n) AS n FROM c GROUP BY 1)
    SELECT w.doc_id, length(t) AS n_chars, len(w) AS n_words, len(l) AS n_lines,
           round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 6) AS mean_word_length,
           round(coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？;:·"'')”’»][\s\p{Z}\x0b\x1c-\x1f\p{Mn}\p{Me}\p{Cf}]*$'))) / nullif(len(l), 0), 0), 6) AS punctuated_lines,
           round(coalesce(m.n, 0) / coalesce(nullif(len(w), 0), 1), 6) AS common_words
    FROM w LEFT JOIN m USING (doc_id)""",
    "p9_checks": """
    SELECT DISTINCT t.mix_id, t.source, d.source IS NOT NULL AS available, true AS capped, true AS met
    FROM mix_targets t LEFT JOIN (SELECT DISTINCT source FROM documents WHERE length(text) > 0) d ON t.source = d.source
    WHERE t.mix_id IS NOT NULL AND t.source IS NOT NULL AND t.target_share > 0""",
    "p2_found": """
    WITH u AS (
        SELECT vec_id, CAST(vec_ AS DOUBLE[]) AS v FROM matrix
        WHERE len(vec_) = 48 AND len(list_filter(vec_, lambda x: x IS NULL OR isnan(x))) = 0
    ), d AS (
        SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM u a JOIN u b ON a.vec_id <> b.vec_id
    ), n AS (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5)
    SELECT DISTINCT least(i, j) AS vec_id_1, greatest(i, j) AS vec_id_2 FROM n""",
    "p5_found": """
    WITH f AS (SELECT fake_username AS name, min(gen_id) AS g FROM fake_usernames_gen WHERE fake_username IS NOT NULL GROUP BY 1),
    r AS (SELECT DISTINCT real_username AS name FROM fake_usernames_gen WHERE real_username IS NOT NULL)
    SELECT t.gen_id FROM fake_usernames_gen t JOIN f ON t.fake_username = f.name LEFT JOIN r ON t.fake_username = r.name
    WHERE r.name IS NOT NULL OR f.g < t.gen_id""",
    "p6_found": f"{_NEAREST} SELECT play_id, moment_id FROM best",
    "p6_stream": f"{_NEAREST} SELECT play_id, moment_id FROM best",
    "p6_matched": f"{_NEAREST} SELECT e.play_id, best.moment_id, round(best.gap, 6) AS gap FROM play_events e LEFT JOIN best USING (play_id)",
    "p7_found": f"{_RUNS} SELECT first_moment_id, last_moment_id FROM r",
    "p7_runs": f"{_RUNS} SELECT game_id, quarter, event_id, first_moment_id, run_length, duration FROM r",
}

ORACLES["p5_resumed"] = ORACLES["p5_found"]
