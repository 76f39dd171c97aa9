"""Similarity, Bloom filter, matrix and sorting queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import cut, load
from ..functions.exprs import square_distance
from ..functions.murmur import M32, M64, R64, murmur2_32, murmur2_64
from ..operators import bloom as B
from ..operators import matrix as X
from ..operators import similarity as S
from ..operators import sorting as O
from ..operators import timing

SHINGLE, LSH = S.ShingleParams(), S.LshParams()
LOG_BITS, HASHES = 14, 4


def _docs(spark, d):
    return load(spark, d, "documents")


def _names(spark, d):
    return load(spark, d, "fake_usernames_gen")


def _sig(spark, d):
    return cut(S.signatures(_docs(spark, d)))


def _filter(spark, d):
    return B.build(_names(spark, d), "real_username", LOG_BITS, HASHES)


def _positives(spark, d):
    """Names taken for members by a filter that has four to eight bits for each, so that some are at every scale."""
    n = _names(spark, d)
    b = B.fitting_log_bits(n, "real_username")
    return B.probe(B.build(n, "real_username", b, HASHES), B.others(n, "fake_username", n, "real_username"), "fake_username", b, HASHES)


def _links(spark, d):
    sig = _sig(spark, d)
    return S.link_counts(S.lsh_pairs(sig), S.membership(sig, "signature"))


def _sweep(spark, d, most=8):
    n = _names(spark, d)
    return B.sweep(n, "real_username", B.others(n, "fake_username", n, "real_username"), "fake_username", range(12, 21), most)


def _sweep_rates(spark, d, most=8):
    n = _names(spark, d).agg(F.count_distinct("real_username").alias("n"))
    s = _sweep(spark, d, most).withColumn("rate", F.try_divide(F.col("positives"), F.col("probes")))
    return s.join(F.broadcast(n)).select("b", "k", F.round("rate", 6).alias("rate"), F.round(B.theoretical_rate(F.pow(F.lit(2.0), F.col("b")), F.col("k"), F.col("n")), 6).alias("expected"))


def _rows(spark, d):
    return load(spark, d, "matrix")


def _turn(spark, d, times):
    c, rows = X.cells(_rows(spark, d)), _rows(spark, d)
    high = X.heights(rows.filter("size(vec_) > 0"))
    wide = rows.filter("size(vec_) > 0").groupBy("matrix_name").agg(F.max(F.size("vec_")).alias("height"))
    for i in range(times):
        c = X.rotate90(c, wide if i % 2 else high)
    return c.select("matrix_name", "i", "j", F.round("v", 5).alias("v"))


def _nearest(spark, d):
    rows = load(spark, d, "embeddings")
    return X.nearest_rows(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", 64).select("vec_id", "nearest", F.round("distance", 4).alias("distance"))


def _first_vector(spark, d):
    rows = load(spark, d, "embeddings")
    one = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return rows.join(F.broadcast(one)).select("vec_id", F.round(square_distance(F.col("embedding"), F.col("q")), 4).alias("distance"))


def _timed(spark, what):
    """Repeats and rows of timed runs, and whether they took any time; the seconds differ from run to run."""
    work = {k: w for k, w in timing.works(spark, 40, (4, 10)).items() if k.startswith(what)}
    return timing.time_runs(spark, work, 2).select("work", "repeats", "rows", (F.col("mean") > 0).alias("timed"))


QUERIES = {
    "murmur2": lambda s, d: _names(s, d).select("fake_username").distinct().select("fake_username", *[murmur2_32(F.col("fake_username"), x).alias(f"h{x}") for x in (0, 1, 4, 1234)]),
    "murmur2_64": lambda s, d: _names(s, d).select("fake_username").distinct().select("fake_username", murmur2_64(F.col("fake_username"), 7).alias("h")),
    "least_prime": lambda s, d: s.createDataFrame([(n, S.least_prime(n)) for n in sorted({x for p in S.prime_table() for x in (p - 1, p, p + 1)} - {2147483648})], "n int, prime int"),
    "shingle_counts": lambda s, d: S.shingles(_docs(s, d)).select("doc_id", F.size("shingles").cast("bigint").alias("n")),
    "minhash_signatures": lambda s, d: S.signatures(_docs(s, d)),
    "signature_classes": lambda s, d: S.membership(_sig(s, d), "signature"),
    "lsh_pairs": lambda s, d: S.lsh_pairs(_sig(s, d)),
    "lsh_pairs_strict": lambda s, d: S.lsh_pairs(_sig(s, d), strict=True),
    "lsh_links": _links,
    "lsh_band_sizes": lambda s, d: S.band_sizes(_sig(s, d)),
    "lsh_average_bucket": lambda s, d: S.average_bucket_size(_sig(s, d)).select(F.round("average", 9).alias("average")),
    "jaccard_pairs": lambda s, d: S.jaccard_pairs(S.shingles(_docs(s, d))).select("id1", "id2", F.round("similarity", 6).alias("similarity")),
    "shingle_classes": lambda s, d: S.membership(cut(S.shingles(_docs(s, d))), "shingles"),
    "bloom_bits": lambda s, d: _filter(s, d),
    "bloom_key_bits": lambda s, d: B.key_bits(_names(s, d), "real_username", LOG_BITS, HASHES),
    "bloom_members": lambda s, d: B.probe(_filter(s, d), _names(s, d), "real_username", LOG_BITS, HASHES),
    "bloom_false_positives": _positives,
    "bloom_false_positive_count": lambda s, d: _positives(s, d).agg(F.count(F.lit(1)).alias("n")),
    "bloom_sweep": _sweep,
    "bloom_sweep_rates": _sweep_rates,
    "bloom_sweep_whole": lambda s, d: _sweep(s, d, 20),
    "bloom_sweep_rates_whole": lambda s, d: _sweep_rates(s, d, 20),
    "bloom_theory": lambda s, d: s.range(12, 21).join(s.range(1, 21).withColumnRenamed("id", "k")).select(
        F.col("id").alias("b"), "k", F.round(B.theoretical_rate(F.pow(F.lit(2.0), F.col("id")), F.col("k"), F.lit(9999)), 8).alias("rate")
    ),
    "rotate90": lambda s, d: _turn(s, d, 1),
    "rotate90_twice": lambda s, d: _turn(s, d, 2),
    "rotate90_four_times": lambda s, d: _turn(s, d, 4),
    "rotate90_blocked": lambda s, d: X.rotate90_blocked(X.cells(_rows(s, d)), X.heights(_rows(s, d).filter("size(vec_) > 0"))).select("matrix_name", "i", "block", F.size("piece").cast("bigint").alias("n"), F.round(F.get("piece", F.lit(0)), 5).alias("first")),
    "matrix_sequence": lambda s, d: X.sequential(s, 120),
    "matrix_by_columns": lambda s, d: X.from_columns(X.cells(_rows(s, d))).select("matrix_name", "i", "j", F.round("v", 5).alias("v")),
    "nearest_vector": _nearest,
    "square_distances": _first_vector,
    "rotation_benchmark": lambda s, d: _timed(s, "rotate"),
    "sort_benchmark": lambda s, d: _timed(s, "sort"),
    "nearest_benchmark": lambda s, d: _timed(s, "nearest"),
    "result_lines": lambda s, d: X.heights(_rows(s, d)).select(F.concat_ws(",", F.lit("RESULT"), "matrix_name", F.col("height").cast("string")).alias("line")),
    "byte_sort": lambda s, d: O.byte_sort(load(s, d, "part"), "p_name", "p_partkey"),
    "char_histogram": lambda s, d: O.char_histogram(load(s, d, "part"), "p_name", 0),
    "count_sort_starts": lambda s, d: O.count_sort_starts(load(s, d, "part"), "p_name", 2),
    "counting_pass": lambda s, d: O.counting_pass(load(s, d, "customer"), "c_name", "c_custkey", 17),
    "sorted_top10": lambda s, d: load(s, d, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey").limit(10),
}

_MASK = 4294967295


def _murmur(t: str, seed: str) -> str:
    """The 32-bit hash of text ``t`` as an expression on its hexadecimal digits."""
    hx, n = f"hex(encode({t}))", f"CAST(octet_length(encode({t})) AS BIGINT)"
    num = lambda *at: "CAST('0x' || " + " || ".join(f"substr({hx}, CAST(({a}) * 2 + 1 AS BIGINT), 2)" for a in at) + " AS BIGINT)"
    k = f"list_transform(range(0, {n} // 4), lambda i: ({num('i * 4 + 3', 'i * 4 + 2', 'i * 4 + 1', 'i * 4')} * {M32}) & {_MASK})"
    k = f"list_transform(list_transform({k}, lambda k: xor(k, k >> 24)), lambda k: (k * {M32}) & {_MASK})"
    h = f"list_reduce({k}, lambda h, k: xor((h * {M32}) & {_MASK}, k), xor(CAST({seed} AS BIGINT), {n}))"
    s = f"({n} // 4 * 4)"
    tail = f"CASE {n} % 4 WHEN 1 THEN {num(s)} WHEN 2 THEN {num(s + ' + 1', s)} ELSE {num(s + ' + 2', s + ' + 1', s)} END"
    steps = [
        f"CASE WHEN {n} % 4 = 0 THEN {h} ELSE (xor({h}, {tail}) * {M32}) & {_MASK} END",
        f"(xor(h, h >> 13) * {M32}) & {_MASK}",
        "xor(h, h >> 15)",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = f"list_transform([{out}], lambda h: {step})[1]"
    return f"CASE WHEN {t} IS NOT NULL THEN {out} END"


def _murmur64(t: str, seed: int) -> str:
    """The 64-bit hash of text ``t``, as a signed number; products are cut to 64 of 128 bits."""
    full = "CAST(18446744073709551615 AS UHUGEINT)"
    m = f"CAST({M64} AS UHUGEINT)"
    hx, n = f"hex(encode({t}))", f"CAST(octet_length(encode({t})) AS BIGINT)"
    byte = lambda at: f"substr({hx}, CAST(({at}) * 2 + 1 AS BIGINT), 2)"
    k = f"list_transform(range(0, {n} // 8), lambda i: ((CAST(CAST('0x' || {' || '.join(byte(f'i * 8 + {j}') for j in range(7, -1, -1))} AS UBIGINT) AS UHUGEINT) * {m}) & {full}))"
    k = f"list_transform({k}, lambda k: (xor(k, k >> {R64}) * {m}) & {full})"
    h = f"list_reduce({k}, lambda h, k: (xor(h, k) * {m}) & {full}, xor(CAST({seed} AS UHUGEINT), (CAST({n} AS UHUGEINT) * {m}) & {full}))"
    rest = f"CAST(CAST('0x' || list_aggregate(list_transform(range({n} - 1, {n} // 8 * 8 - 1, -1), lambda i: {byte('i')}), 'string_agg', '') AS UBIGINT) AS UHUGEINT)"
    steps = [
        f"CASE WHEN {n} % 8 = 0 THEN {h} ELSE (xor({h}, {rest}) * {m}) & {full} END",
        f"(xor(h, h >> {R64}) * {m}) & {full}",
        f"xor(h, h >> {R64})",
        "CASE WHEN h > 9223372036854775807 THEN CAST(CAST(h AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = f"list_transform([{out}], lambda h: {step})[1]"
    return f"CASE WHEN {t} IS NOT NULL THEN {out} END"


def _grams() -> str:
    k = SHINGLE.k
    return f"""g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(range(1, CAST(length(text) AS BIGINT) - {k} + 2), lambda i: substring(text, i, {k}))) AS gram
        FROM documents WHERE length(text) >= {k})),
    u AS (SELECT gram, {_murmur('gram', str(SHINGLE.seed))} AS h FROM (SELECT DISTINCT gram FROM g)),
    sh AS (SELECT DISTINCT doc_id, (CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) % {SHINGLE.slots} AS x FROM g JOIN u USING (gram))"""


def _signed() -> str:
    family, prime, domain = S.hash_family(LSH, SHINGLE.slots)
    values = ", ".join(f"({j}, {a}, {b})" for j, (a, b) in enumerate(family))
    return f"""WITH {_grams()},
    f(j, a, b) AS (VALUES {values}),
    mins AS (SELECT doc_id, j, min((CAST(a AS BIGINT) * x + b) % {prime} % {domain}) AS v FROM sh, f GROUP BY 1, 2),
    sig AS (SELECT d.doc_id, coalesce(s, list_transform(range(0, {LSH.hashes}), lambda i: CAST({S.NOTHING} AS BIGINT))) AS signature
            FROM documents d LEFT JOIN (SELECT doc_id, list(v ORDER BY j) AS s FROM mins GROUP BY 1) USING (doc_id)),
    cls AS (SELECT signature, min(doc_id) AS class_id, count(*) AS members FROM sig GROUP BY 1)"""


_ROWS = LSH.hashes // LSH.used_bands
_BANDS = f"bd AS (SELECT {{ident}}, unnest(range(0, {LSH.used_bands})) AS band, signature FROM {{source}}), bs AS (SELECT {{ident}}, band, signature, list_slice(signature, band * {_ROWS} + 1, (band + 1) * {_ROWS}) AS slice FROM bd)"


def _pairs() -> str:
    return f"""{_signed()}, {_BANDS.format(ident='class_id', source='cls')},
    cand AS (SELECT DISTINCT a.class_id AS id1, b.class_id AS id2, a.signature AS s1, b.signature AS s2 FROM bs a JOIN bs b ON a.band = b.band AND a.slice = b.slice AND a.class_id < b.class_id),
    prs AS (SELECT id1, id2, agree FROM (SELECT id1, id2, len(list_filter(list_zip(s1, s2), lambda z: z[1] = z[2])) AS agree FROM cand) WHERE agree >= {LSH.required})"""


_SETS = f"""WITH {_grams()}, st AS (SELECT d.doc_id, coalesce(s, []) AS s FROM documents d LEFT JOIN (SELECT doc_id, list(x ORDER BY x) AS s FROM sh GROUP BY 1) USING (doc_id)),
    cls AS (SELECT s, min(doc_id) AS class_id FROM st GROUP BY 1)"""
_REAL = "SELECT DISTINCT real_username AS name FROM fake_usernames_gen WHERE real_username IS NOT NULL"
_FAKE = "SELECT DISTINCT fake_username AS name FROM fake_usernames_gen WHERE fake_username IS NOT NULL"


def _bits(source: str, log_bits: str, k: int) -> str:
    return " UNION ALL ".join(f"SELECT name, {i} AS i, {_murmur('name', str(i * i))} & ((1 << {log_bits}) - 1) AS bit FROM ({source})" for i in range(k))


_FITTING = f"(SELECT greatest(6, CAST(ceil(log2(4 * count(*))) AS INTEGER)) FROM ({_REAL}))"
_POSITIVE = f"""WITH bits AS (SELECT DISTINCT bit FROM ({_bits(_REAL, _FITTING, HASHES)})),
    pr AS ({_bits(f'{_FAKE} EXCEPT ({_REAL})', _FITTING, HASHES)}), pos AS (SELECT name FROM pr JOIN bits USING (bit) GROUP BY 1 HAVING count(*) = {HASHES})"""
_MOST = 8


def _swept(most: int) -> str:
    return f"""WITH mh AS ({' UNION ALL '.join(f"SELECT name, {i} AS i, {_murmur('name', str(i * i))} AS h FROM ({_REAL})" for i in range(most))}),
    ph AS ({' UNION ALL '.join(f"SELECT name, {i} AS i, {_murmur('name', str(i * i))} AS h FROM ({_FAKE} EXCEPT ({_REAL}))" for i in range(most))}),
    sizes AS (SELECT CAST(unnest(range(12, 21)) AS INTEGER) AS b),
    ks AS (SELECT CAST(unnest(range(1, {most + 1})) AS INTEGER) AS k),
    bits AS (SELECT DISTINCT b, k, h & ((1 << b) - 1) AS bit FROM mh, sizes, ks WHERE i < k),
    hit AS (SELECT p.name, p.b, p.k, count(bits.bit) AS n FROM (SELECT name, b, k, h & ((1 << b) - 1) AS bit FROM ph, sizes, ks WHERE i < k) p LEFT JOIN bits USING (b, k, bit) GROUP BY 1, 2, 3),
    sw AS (SELECT b, k, count(*) AS probes, count_if(n = k) AS positives FROM hit GROUP BY 1, 2)"""


_SWEEP, _SWEEP_WHOLE = _swept(_MOST), _swept(20)
_CELLS = "WITH c AS (SELECT matrix_name, row_no AS i, generate_subscripts(vec_, 1) - 1 AS j, unnest(vec_) AS v FROM matrix WHERE len(vec_) > 0), hh AS (SELECT matrix_name, max(row_no) + 1 AS h, max(len(vec_)) AS w FROM matrix WHERE len(vec_) > 0 GROUP BY 1)"
_AT0 = "CASE WHEN length({v}) > {p} THEN ascii(substring({v}, {p} + 1, 1)) ELSE -1 END"

ORACLES = {
    "murmur2": "SELECT fake_username, " + ", ".join(f"{_murmur('fake_username', str(x))} AS h{x}" for x in (0, 1, 4, 1234)) + " FROM (SELECT DISTINCT fake_username FROM fake_usernames_gen)",
    "murmur2_64": f"SELECT fake_username, {_murmur64('fake_username', 7)} AS h FROM (SELECT DISTINCT fake_username FROM fake_usernames_gen)",
    "least_prime": """
    WITH small AS (SELECT p FROM range(2, 46342) AS r(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 216) AS q(x) WHERE x * x <= p AND p % x = 0)),
    cand AS (SELECT i, CAST(floor(pow(2, i / 16.0)) AS BIGINT) - k AS c FROM range(16, 497) AS a(i), range(0, 3000) AS b(k) WHERE CAST(floor(pow(2, i / 16.0)) AS BIGINT) - k >= 5),
    sieved AS (SELECT i, c FROM cand WHERE (c % 6 = 1 OR c IN (5, 7)) AND NOT EXISTS (SELECT 1 FROM small WHERE p < 400 AND ((c % p = 0 AND c <> p) OR ((c - 2) % p = 0 AND c - 2 <> p)))),
    twin AS (SELECT i, c FROM sieved WHERE NOT EXISTS (SELECT 1 FROM small WHERE p >= 400 AND p < c - 2 AND (c % p = 0 OR (c - 2) % p = 0))),
    e AS (SELECT DISTINCT CAST(CASE p WHEN 1454120821 THEN 1454120779 ELSE p END AS INTEGER) AS p FROM (SELECT max(c) AS p FROM twin GROUP BY i UNION ALL SELECT unnest([3, 89, 2147483647]))),
    n AS (SELECT DISTINCT CAST(x AS INTEGER) AS n FROM (SELECT unnest([CAST(p AS BIGINT) - 1, p, CAST(p AS BIGINT) + 1]) AS x FROM e) WHERE x < 2147483648)
    SELECT n.n, min(e.p) AS prime FROM n JOIN e ON e.p >= n.n GROUP BY n.n""",
    "shingle_counts": f"WITH {_grams()} SELECT d.doc_id, count(x) AS n FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY 1",
    "minhash_signatures": f"{_signed()} SELECT doc_id, signature FROM sig",
    "signature_classes": f"{_signed()} SELECT doc_id, class_id FROM sig JOIN cls USING (signature)",
    "lsh_pairs": f"{_pairs()} SELECT id1, id2, {LSH.required} / {LSH.hashes} AS similarity FROM prs",
    "lsh_pairs_strict": f"{_pairs()} SELECT id1, id2, agree / {LSH.hashes} AS similarity FROM prs",
    "lsh_links": f"""{_pairs()}, e AS (SELECT id1 AS x, id2 AS y FROM prs UNION ALL SELECT id2, id1 FROM prs),
    far AS (SELECT x AS class_id, sum(members) AS n FROM e JOIN cls ON y = class_id GROUP BY 1)
    SELECT sig.doc_id, cls.class_id, CAST(cls.members - 1 + coalesce(far.n, 0) AS BIGINT) AS links FROM sig JOIN cls USING (signature) LEFT JOIN far ON far.class_id = cls.class_id""",
    "lsh_band_sizes": f"""{_signed()}, {_BANDS.format(ident='doc_id', source='sig')}, n AS (SELECT band, slice, count(*) AS documents FROM bs GROUP BY 1, 2)
    SELECT CAST(band AS INTEGER) AS band, documents, count(*) AS buckets FROM n GROUP BY 1, 2""",
    "lsh_average_bucket": f"SELECT round(count(*) * {LSH.used_bands} / (2000 * {LSH.used_bands}), 9) AS average FROM documents",
    "jaccard_pairs": f"""{_SETS}, p AS (SELECT a.class_id AS id1, b.class_id AS id2, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS n1, len(b.s) AS n2 FROM cls a JOIN cls b ON a.class_id < b.class_id
        AND len(a.s) > 0 AND len(b.s) > 0 AND least(len(a.s), len(b.s)) >= 0.79 * greatest(len(a.s), len(b.s)))
    SELECT id1, id2, round(c / (n1 + n2 - c), 6) AS similarity FROM p WHERE c / (n1 + n2 - c) > {S.single(0.8)!r}""",
    "shingle_classes": f"{_SETS} SELECT doc_id, class_id FROM st JOIN cls USING (s)",
    "bloom_bits": f"SELECT DISTINCT bit FROM ({_bits(_REAL, str(LOG_BITS), HASHES)})",
    "bloom_key_bits": f"SELECT name AS real_username, i, bit FROM ({_bits(_REAL, str(LOG_BITS), HASHES)})",
    "bloom_members": f"SELECT name AS real_username FROM ({_REAL})",
    "bloom_false_positives": f"{_POSITIVE} SELECT name AS fake_username FROM pos",
    "bloom_false_positive_count": f"{_POSITIVE} SELECT count(*) AS n FROM pos",
    "bloom_sweep": f"{_SWEEP} SELECT b, k, probes, positives FROM sw",
    "bloom_sweep_rates": f"""{_SWEEP}, m AS (SELECT count(DISTINCT real_username) AS n FROM fake_usernames_gen)
    SELECT b, k, round(positives / probes, 6) AS rate, round(pow(1 - pow(1 - 1 / pow(2.0, b), k * n), k), 6) AS expected FROM sw, m""",
    "bloom_sweep_whole": f"{_SWEEP_WHOLE} SELECT b, k, probes, positives FROM sw",
    "bloom_sweep_rates_whole": f"""{_SWEEP_WHOLE}, m AS (SELECT count(DISTINCT real_username) AS n FROM fake_usernames_gen)
    SELECT b, k, round(positives / probes, 6) AS rate, round(pow(1 - pow(1 - 1 / pow(2.0, b), k * n), k), 6) AS expected FROM sw, m""",
    "bloom_theory": """SELECT b, k, round(pow(1 - pow(1 - 1 / pow(2.0, b), k * 9999), k), 8) AS rate
    FROM (SELECT unnest(range(12, 21)) AS b) CROSS JOIN (SELECT unnest(range(1, 21)) AS k)""",
    "rotate90": f"{_CELLS} SELECT matrix_name, j AS i, h - 1 - i AS j, round(v, 5) AS v FROM c JOIN hh USING (matrix_name)",
    "rotate90_twice": f"{_CELLS} SELECT matrix_name, h - 1 - i AS i, w - 1 - j AS j, round(v, 5) AS v FROM c JOIN hh USING (matrix_name)",
    "rotate90_four_times": f"{_CELLS} SELECT matrix_name, i, j, round(v, 5) AS v FROM c",
    "rotate90_blocked": f"""{_CELLS}, t AS (SELECT matrix_name, j AS i, h - 1 - i AS j, v FROM c JOIN hh USING (matrix_name))
    SELECT matrix_name, i, CAST(j // 10 AS BIGINT) AS block, count(*) AS n, round(arg_min(coalesce(v, 'nan'::FLOAT), j), 5) AS first FROM t GROUP BY 1, 2, 3""",
    "matrix_sequence": "SELECT CAST(x // 120 AS INTEGER) AS i, CAST(x % 120 AS INTEGER) AS j, x + 1 AS v FROM (SELECT unnest(range(0, 14400)) AS x)",
    "matrix_by_columns": f"{_CELLS} SELECT matrix_name, j AS i, i AS j, round(v, 5) AS v FROM c",
    "nearest_vector": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64),
    d AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT vec_id, other AS nearest, round(d, 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, other) = 1""",
    "square_distances": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 4) AS distance FROM embeddings, q""",
    "rotation_benchmark": "SELECT * FROM (VALUES ('rotate', 2::BIGINT, 1600::BIGINT, true), ('rotate-blocked 4', 2, 400, true), ('rotate-blocked 10', 2, 160, true)) AS t(work, repeats, rows, timed)",
    "sort_benchmark": "SELECT * FROM (VALUES ('sort', 2::BIGINT, 40::BIGINT, true), ('sort-pass', 2, 40, true)) AS t(work, repeats, rows, timed)",
    "nearest_benchmark": "SELECT 'nearest' AS work, CAST(2 AS BIGINT) AS repeats, CAST(1 AS BIGINT) AS rows, true AS timed",
    "result_lines": "SELECT concat_ws(',', 'RESULT', matrix_name, CAST(max(row_no) + 1 AS VARCHAR)) AS line FROM matrix GROUP BY matrix_name",
    "byte_sort": "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name NULLS LAST, p_partkey) AS place FROM part",
    "char_histogram": f"SELECT {_AT0.format(v='p_name', p=0)} AS code, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1",
    "count_sort_starts": f"""WITH h AS (SELECT {_AT0.format(v='p_name', p=2)} AS code, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1)
    SELECT code, n, CAST(coalesce(sum(n) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h""",
    "counting_pass": f"SELECT c_custkey, {_AT0.format(v='c_name', p=17)} AS code, row_number() OVER (ORDER BY {_AT0.format(v='c_name', p=17)}, c_custkey) AS place FROM customer WHERE c_name IS NOT NULL",
    "sorted_top10": "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 10",
}
