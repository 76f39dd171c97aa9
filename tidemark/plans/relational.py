"""The relational operations and the readers and writers, each as a query with its SQL."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import cut, ensure_checkpoint_dir, load
from ..operators.matrix import from_columns
from ..operators.tracking import densify
from ..sources import generators as G
from ..sources import readers as R
from ..sources import writers as W


def _t(name):
    return lambda s, d: load(s, d, name)


orders, lineitem, customer, part, supplier, nation, region = (_t(n) for n in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region"))
EVENT_COLUMNS = ["play_id", "game_id", "eventnum", "eventmsgtype", "period", "pctimestring", "player1_id", "player1_team_id"]
SPREAD = {"quantity": "l_quantity", "price": "l_extendedprice"}


def _folder(spark) -> str:
    """A new folder in the place all executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), f"tidemark-{uuid.uuid4().hex}")


def _csv_round_trip(spark, d):
    """Events written as CSV files and read again by a glob, all as strings, then cast."""
    path = _folder(spark)
    load(spark, d, "play_events").select(EVENT_COLUMNS).repartition(3).write.option("header", True).csv(path)
    back = R.read_strings(spark, f"{path}/*.csv", EVENT_COLUMNS)
    return R.cast_columns(back, {c: "int" for c in EVENT_COLUMNS if c not in ("play_id", "pctimestring")} | {"play_id": "bigint"})


def _tsv_documents(spark, d):
    path = _folder(spark)
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", " ")
    load(spark, d, "documents").select(F.concat_ws("\t", F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.col("doc_id").cast("string"), flat, F.lit("")).alias("value")).write.text(path)
    return R.read_tsv_documents(spark, path).select("doc_id", F.length("text").cast("bigint").alias("n"))


def _name_lines(spark, d):
    path = _folder(spark)
    W.write_lines(load(spark, d, "fake_usernames_gen").select("real_username").filter("real_username is not null").distinct(), "real_username", path)
    return R.read_lines(spark, path, "name")


def _text_matrix(spark, d):
    path = _folder(spark)
    rows = load(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").coalesce(1)
    rows.select(F.concat_ws(" ", "n_nationkey", "n_regionkey").alias("value")).write.text(path)
    return R.read_text_matrix(spark, f"{path}/*.txt").select("i", "j", "v")


def _binary_matrix(by_columns):
    def query(spark, d):
        path = _folder(spark)

        def pack(batches):
            for pdf in batches:
                yield pd.DataFrame({"name": pdf["name"], "content": [W.binary_matrix(np.array(list(v), np.float32)) for v in pdf["rows"]]})

        rows = load(spark, d, "embeddings").groupBy((F.col("vec_id") % 4).cast("string").alias("name")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
        files = rows.select("name", F.transform("x", lambda v: v["embedding"]).alias("rows")).mapInPandas(pack, "name string, content binary")
        for row in files.toLocalIterator():  # four small files
            W.write_bytes(spark, f"{path}/{row['name']}.bin", row["content"])
        back = R.read_binary_matrix(spark, path, by_columns)
        name = F.regexp_extract("file", r"(\d+)\.bin$", 1)
        return back.select(name.alias("name"), "row_no", F.size("vec_").cast("bigint").alias("n"), F.round(F.aggregate("vec_", F.lit(1000.0), lambda a, v: a + v), 3).alias("total"))

    return query


def _pairs_tsv(spark, d):
    path = _folder(spark)
    pairs = supplier(spark, d).select(F.col("s_suppkey").alias("id1"), (F.col("s_suppkey") + 1).alias("id2"), F.round(F.col("s_acctbal") / 100, 1).alias("similarity"))
    W.write_pairs(pairs, path)
    return spark.read.option("sep", "\t").schema("id1 bigint, id2 bigint, similarity double").csv(path)


def _single_csv(spark, d):
    path = _folder(spark)
    W.write_single_csv(nation(spark, d).select("n_nationkey", "n_regionkey").orderBy("n_nationkey"), path)
    return spark.read.option("sep", " ").schema("n_nationkey int, n_regionkey int").csv(path)


def _pairs_in_order(spark, d):
    """The places of the pairs in their file."""
    path = _folder(spark)
    pairs = supplier(spark, d).select(F.col("s_suppkey").alias("id1"), (F.col("s_suppkey") + 1).alias("id2"), F.round(F.col("s_acctbal") / 100, 1).alias("similarity"))
    W.write_pairs(pairs, path)
    lines = R.first_lines(spark, path, 200, "line")
    return lines.select("place", F.split_part("line", F.lit("\t"), F.lit(1)).cast("bigint").alias("id1"))


def _first_documents(spark, d):
    """The first lines of a file, whatever their ids are."""
    path = _folder(spark)
    docs = load(spark, d, "documents").select("doc_id").orderBy(F.desc("doc_id")).coalesce(1)
    docs.select(F.concat_ws("\t", F.lit("u"), F.col("doc_id").cast("string"), F.lit("text")).alias("value")).write.text(path)
    return R.read_tsv_documents(spark, path, first=25)


def _listed_matrices(spark, d):
    """Three square matrices of a manifest, cells of rows and columns beyond their size left out."""
    path = _folder(spark)
    sizes = [3, 5, 8]
    for n in sizes:
        W.write_bytes(spark, f"{path}/m{n}.txt", "".join(" ".join(str(n * i + j) for j in range(n)) + "\n" for i in range(n)).encode())
    W.write_bytes(spark, f"{path}/unlisted.txt", b"1 2\n3 4\n")
    W.write_bytes(spark, f"{path}/manifest", "\n".join(f"{n} m{n}.txt" for n in sizes).encode())
    return R.read_listed_matrices(spark, f"{path}/manifest")


QUERIES = {
    "filter_project": lambda s, d: lineitem(s, d).filter("l_discount > 0.05 and l_quantity < 24").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")),
    "lenient_cast": lambda s, d: orders(s, d).select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("grade"), F.col("o_orderstatus").try_cast("int").alias("none")),
    "derived_columns": lambda s, d: part(s, d).withColumns({"feet": F.col("p_size") * 0.3048, "size_class": F.when(F.col("p_size") > 25, "large").otherwise("small")}).select("p_partkey", F.round("feet", 4).alias("feet"), "size_class"),
    "drop_columns": lambda s, d: customer(s, d).drop("c_name", "c_acctbal").alias("c").select("c.c_custkey", "c.c_nationkey", "c.c_mktsegment"),
    "disjunctive_filter": lambda s, d: orders(s, d).filter(((F.col("o_totalprice") <= 50000) & (F.col("o_orderstatus") != "F")) | (F.col("o_totalprice") > 250000) | F.col("o_orderpriority").isNull()).select("o_orderkey"),
    "group_sums": lambda s, d: lineitem(s, d).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_extendedprice").alias("most")),
    "count_distinct": lambda s, d: lineitem(s, d).groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.round(F.sum("l_extendedprice"), 2).alias("total")),
    "distinct_rows": lambda s, d: lineitem(s, d).select("l_returnflag", "l_linestatus", "l_linenumber").distinct(),
    "count_if": lambda s, d: lineitem(s, d).agg(F.count_if(F.col("l_discount") > 0.05).alias("n"), F.round(F.count_if(F.col("l_discount") > 0.05) / F.count(F.lit(1)), 6).alias("rate")),
    "mean_and_spread": lambda s, d: lineitem(s, d).groupBy("l_linenumber").agg(*[x for k, c in SPREAD.items() for x in (F.round(F.avg(c), 4).alias(f"{k}_mean"), F.round(F.stddev_pop(c), 4).alias(f"{k}_std"))]),
    "truncated_mean": lambda s, d: part(s, d).groupBy("p_brand").agg(F.floor(F.sum(F.col("p_size").cast("bigint")) / F.count(F.lit(1))).alias("mean")),
    "longest_string": lambda s, d: part(s, d).agg(F.max(F.length("p_name")).cast("bigint").alias("n")),
    "half_even": lambda s, d: lineitem(s, d).select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 2, 0).alias("half"), F.round(F.col("l_quantity") / 2, 0).alias("up")),
    "left_join_fill": lambda s, d: customer(s, d).join(orders(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total")), "c_custkey", "left").select("c_custkey", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total")),
    "inner_join_keys": lambda s, d: lineitem(s, d).join(orders(s, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")),
    "null_safe_join": lambda s, d: _null_safe(s, d),
    "anti_join": lambda s, d: customer(s, d).join(orders(s, d), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "semi_join": lambda s, d: customer(s, d).join(orders(s, d).filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "densify_fill": lambda s, d: densify(region(s, d).select("r_regionkey"), ("slow", "normal", "fast")).join(nation(s, d).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("zone", F.lit("slow")), ["r_regionkey", "zone"], "left").na.fill(0).orderBy("r_regionkey", "zone"),
    "first_per_group": lambda s, d: orders(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("rn = 1").select("o_custkey", "o_orderkey"),
    "lag_self": lambda s, d: _windowed(s, d),
    "first_rows": lambda s, d: load(s, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(25),
    "set_algebra": lambda s, d: _sets(s, d),
    "csv_round_trip": _csv_round_trip,
    "tsv_documents": _tsv_documents,
    "name_lines": _name_lines,
    "text_matrix": _text_matrix,
    "text_matrix_by_columns": lambda s, d: from_columns(_text_matrix(s, d).withColumn("m", F.lit("m")), "m").select("i", "j", "v"),
    "binary_matrix": _binary_matrix(False),
    "binary_matrix_by_columns": _binary_matrix(True),
    "single_csv": _single_csv,
    "pairs_tsv_order": _pairs_in_order,
    "first_documents": _first_documents,
    "listed_matrices": _listed_matrices,
    "anti_join_dear": lambda s, d: customer(s, d).join(orders(s, d).filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "pairs_tsv": _pairs_tsv,
    "literal_table": lambda s, d: R.literals(s, ("slow", "normal", "fast"), "zone"),
    "random_strings": lambda s, d: G.random_strings(s, 10000),
    "near_misses": lambda s, d: G.near_misses(load(s, d, "fake_usernames_gen"), "real_username", 500).select("fake"),
    "random_string_checks": lambda s, d: G.random_strings(s, 10000).agg(F.count_distinct("id").alias("n"), F.min(F.length("s")).alias("shortest"), F.max(F.length("s")).alias("longest"), F.count_if(F.col("s").rlike("^[a-z]+$")).alias("lower")),
    "near_miss_checks": lambda s, d: _miss_checks(s, d),
}


def _miss_checks(spark, d):
    """What holds of all near misses: they differ, each comes from a name of the table, and is one change (a swap is two edits) away."""
    names = load(spark, d, "fake_usernames_gen")
    made = G.near_misses(names, "real_username", 500)
    known = made.join(names.select(F.col("real_username").alias("real")).distinct(), "real", "left_semi")
    near = (F.levenshtein("fake", "real") <= 2) & (F.abs(F.length("fake") - F.length("real")) <= 1)
    return known.agg(F.count_distinct("fake").alias("n"), F.count_if(near).alias("near"))


def _null_safe(spark, d):
    """Events and their repeats under another id: equal in everything, null players and teams included."""
    keys = ["game_id", "eventnum", "player1_id", "player1_team_id"]
    e = load(spark, d, "play_events")
    a, b = e.select("play_id", *keys), e.select(F.col("play_id").alias("other"), *[F.col(k).alias(f"b_{k}") for k in keys])
    same = F.col("play_id") < F.col("other")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(b, same).select("play_id", "other")


def _windowed(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, d, "events")
    return e.select(
        "event_id",
        F.round(F.coalesce(F.lag("value").over(w), F.col("value")), 4).alias("before"),
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"),
        F.round(F.avg("value").over(w.rowsBetween(-9, 0)), 7).alias("recent"),
    )


def _sets(spark, d):
    """The parts two suppliers with neighbouring keys sell: shared, and in all."""
    p = lineitem(spark, d).groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    p = cut(p)
    q = p.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("parts").alias("next"))
    both = F.size(F.array_intersect("parts", "next"))
    return p.join(q, "l_suppkey").select("l_suppkey", both.cast("bigint").alias("shared"), F.size(F.array_union("parts", "next")).cast("bigint").alias("in_all"))


_WIDE = "WITH e AS (SELECT CAST(vec_id % 4 AS VARCHAR) AS name, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

ORACLES = {
    "filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24",
    "lenient_cast": "SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS grade, TRY_CAST(o_orderstatus AS INTEGER) AS none FROM orders",
    "derived_columns": "SELECT p_partkey, round(p_size * CAST(0.3048 AS DOUBLE), 4) AS feet, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class FROM part",
    "drop_columns": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "disjunctive_filter": "SELECT o_orderkey FROM orders WHERE (o_totalprice <= 50000 AND o_orderstatus <> 'F') OR o_totalprice > 250000 OR o_orderpriority IS NULL",
    "group_sums": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n, round(avg(l_discount), 6) AS discount, max(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2",
    "count_distinct": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "count_if": "SELECT count_if(l_discount > 0.05) AS n, round(count_if(l_discount > 0.05) / count(*), 6) AS rate FROM lineitem",
    "mean_and_spread": "SELECT l_linenumber, " + ", ".join(f"round(avg({c}), 4) AS {k}_mean, round(stddev_pop({c}), 4) AS {k}_std" for k, c in SPREAD.items()) + " FROM lineitem GROUP BY 1",
    "truncated_mean": "SELECT p_brand, CAST(floor(sum(p_size) / count(*)) AS BIGINT) AS mean FROM part GROUP BY 1",
    "longest_string": "SELECT max(length(p_name)) AS n FROM part",
    "half_even": "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half, round(l_quantity / 2, 0) AS up FROM lineitem",
    "left_join_fill": "SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "inner_join_keys": "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "null_safe_join": """SELECT a.play_id, b.play_id AS other FROM play_events a JOIN play_events b ON a.play_id < b.play_id AND a.game_id IS NOT DISTINCT FROM b.game_id
    AND a.eventnum IS NOT DISTINCT FROM b.eventnum AND a.player1_id IS NOT DISTINCT FROM b.player1_id AND a.player1_team_id IS NOT DISTINCT FROM b.player1_team_id""",
    "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "densify_fill": """WITH z AS (SELECT r_regionkey, zone FROM region CROSS JOIN (VALUES ('slow'), ('normal'), ('fast')) AS t(zone)), c AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
    SELECT r_regionkey, zone, CASE WHEN zone = 'slow' THEN coalesce(n, 0) ELSE 0 END AS n FROM z LEFT JOIN c ON r_regionkey = n_regionkey""",
    "first_per_group": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "lag_self": """SELECT event_id, round(coalesce(lag(value) OVER w, value), 4) AS before, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS so_far,
    round(avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 7) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "first_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25",
    "set_algebra": """WITH p AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
    SELECT a.l_suppkey, len(list_intersect(a.parts, b.parts)) AS shared, len(a.parts) + len(b.parts) - len(list_intersect(a.parts, b.parts)) AS in_all FROM p a JOIN p b ON b.l_suppkey = a.l_suppkey + 1""",
    "csv_round_trip": "SELECT " + ", ".join(EVENT_COLUMNS) + " FROM play_events",
    "tsv_documents": "SELECT doc_id, coalesce(length(text), 0) AS n FROM documents",
    "name_lines": "SELECT DISTINCT real_username AS name FROM fake_usernames_gen WHERE real_username IS NOT NULL",
    "text_matrix": """WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey, n_regionkey FROM nation)
    SELECT i, 0 AS j, CAST(n_nationkey AS DOUBLE) AS v FROM r UNION ALL SELECT i, 1, CAST(n_regionkey AS DOUBLE) FROM r""",
    "text_matrix_by_columns": """WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS j, n_nationkey, n_regionkey FROM nation)
    SELECT 0 AS i, j, CAST(n_nationkey AS DOUBLE) AS v FROM r UNION ALL SELECT 1, j, CAST(n_regionkey AS DOUBLE) FROM r""",
    "binary_matrix": f"{_WIDE} SELECT name, r AS row_no, len(v) AS n, round(1000 + list_sum(v), 3) AS total FROM e",
    "binary_matrix_by_columns": f"""{_WIDE}, c AS (SELECT name, generate_subscripts(v, 1) - 1 AS row_no, unnest(v) AS x FROM e)
    SELECT name, row_no, count(*) AS n, round(1000 + sum(x), 3) AS total FROM c GROUP BY 1, 2""",
    "single_csv": "SELECT n_nationkey, n_regionkey FROM nation",
    "pairs_tsv": "SELECT s_suppkey AS id1, s_suppkey + 1 AS id2, round(s_acctbal / 100, 1) AS similarity FROM supplier",
    "pairs_tsv_order": "SELECT row_number() OVER (ORDER BY round(s_acctbal / 100, 1) DESC, s_suppkey) AS place, s_suppkey AS id1 FROM supplier QUALIFY place <= 200",
    "first_documents": "SELECT doc_id, 'text' AS text FROM documents ORDER BY doc_id DESC LIMIT 25",
    "listed_matrices": """SELECT n, 'm' || n || '.txt' AS file, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(n * i + j AS DOUBLE) AS v
    FROM (VALUES (3), (5), (8)) AS t(n), (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j) WHERE i < n AND j < n""",
    "anti_join_dear": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "random_string_checks": "SELECT CAST(10000 AS BIGINT) AS n, 1 AS shortest, 25 AS longest, CAST(10000 AS BIGINT) AS lower",
    "near_miss_checks": "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS near",
    "literal_table": "SELECT * FROM (VALUES ('slow'), ('normal'), ('fast')) AS t(zone)",
}
