"""Queries: identifiers, trie, decoding, registry, training rows, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import streaming as S
from tessera.catalog import register
from tessera.functions import ids
from tessera.operators import evaluate as E
from tessera.operators import quantize as Q
from tessera.operators import registry as G
from tessera.operators import training as TR
from tessera.sources import table

K = 16


def _books(s: SparkSession, d: str, salt: str = "") -> list[np.ndarray]:
    v = table(s, d, "embeddings").where("embedding IS NOT NULL")
    rows = v.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)).limit(4 * K).select("embedding").collect()  # a sample of 64 by hash
    return Q.frozen_codebooks([np.array(r[0], float) for r in rows], K)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))


def _codes(s: SparkSession, d: str) -> DataFrame:
    return Q.encode(_vectors(s, d), _books(s, d))


def _level(n: int, source: str, book: str) -> str:
    return f"SELECT doc, {n} AS level, r, arg_min(code, (round(list_aggregate(list_transform(list_zip(r, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum'), 9), code)) AS code FROM {source}, {book} GROUP BY doc, r"


def _rq_sql() -> str:
    """CTEs down to `codes` (doc, c1..c4, err), with books b1..b4."""
    out = ["x AS (SELECT vec_id AS doc, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / sqrt(list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * z), 'sum'))) AS r FROM embeddings)"]
    out.append(f"sample AS MATERIALIZED (SELECT doc, row_number() OVER (ORDER BY sha256(CAST(doc AS VARCHAR))) - 1 AS place FROM x QUALIFY place < {4 * K})")
    src = "x"
    for n in range(1, 5):
        out.append(f"b{n} AS (SELECT place - {(n - 1) * K} AS code, r AS c FROM {src} JOIN sample USING (doc) WHERE place >= {(n - 1) * K} AND place < {n * K})")
        out.append(f"k{n} AS MATERIALIZED ({_level(n, src, f'b{n}')})")
        out.append(f"r{n} AS MATERIALIZED (SELECT doc, code AS c{n}, list_transform(list_zip(k.r, b.c), lambda p: p[1] - p[2]) AS r FROM k{n} k JOIN b{n} b USING (code))")
        src = f"r{n}"
    out.append("codes AS (SELECT doc, c1, c2, c3, c4, list_aggregate(list_transform(r4.r, lambda z: z * z), 'sum') AS err FROM r1 JOIN r2 USING (doc) JOIN r3 USING (doc) JOIN r4 USING (doc))")
    out.append("issued AS (SELECT *, row_number() OVER (PARTITION BY c1, c2, c3, c4 ORDER BY doc) - 1 AS ordinal FROM codes)")
    return ", ".join(out)


RQ = _rq_sql()


def rq_encode(s: SparkSession, d: str) -> DataFrame:
    return _codes(s, d).select("doc", *[F.col(f"c{i}").cast("long").alias(f"c{i}") for i in range(1, 5)], F.round("err", 6).alias("err"))


def occupancy(s: SparkSession, d: str) -> DataFrame:
    return Q.occupancy(_codes(s, d), K)


def sid_codec(s: SparkSession, d: str) -> DataFrame:
    """Tails as its SQL states them, three bytes at most; the ordinal says which document of a full prefix it is."""
    a = Q.allocate(_codes(s, d))
    tail = ids.short_tail(F.col("tail"))
    a = a.withColumn("raw", ids.pack(F.col("codes"), tail)).withColumn("back", F.array_join(ids.unpack(F.col("raw")), "."))
    return a.select("doc", ids.to_text(F.col("codes"), tail).alias("sid"), F.lower(F.hex("raw")).alias("packed"), F.array_join(ids.tokens(F.concat("codes", F.slice("tail", 1, 1))), " ").alias("tokens"), F.col("back").alias("round_trip"), ids.ordinal(F.col("tail")).alias("ordinal"))


def trie_nodes(s: SparkSession, d: str) -> DataFrame:
    return Q.trie_nodes(Q.allocate(_codes(s, d))).select(F.col("depth").cast("long").alias("depth"), "prefix", "children", "leaves")


def trie_numbers(s: SparkSession, d: str) -> DataFrame:
    return Q.numbered(Q.allocate(_codes(s, d)))


def trie_edges(s: SparkSession, d: str) -> DataFrame:
    return Q.trie_edges(Q.allocate(_codes(s, d))).select(F.col("depth").cast("long").alias("depth"), "parent", F.col("code").cast("long").alias("code"), "child")


def trie_validate(s: SparkSession, d: str) -> DataFrame:
    a = Q.allocate(_codes(s, d))
    return Q.validate(a.where("doc % 7 <> 0"), a.where("doc % 5 <> 0"))


def beam_search(s: SparkSession, d: str) -> DataFrame:
    issued = Q.allocate(_codes(s, d))
    q = _vectors(s, d).where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vec")
    return Q.beam(q, issued, _books(s, d)).select("qid", "prefix", F.round("score", 4).alias("score"), "rank")


def registry_fold(s: SparkSession, d: str) -> DataFrame:
    return G.fold(G.mutations(table(s, d, "events")))


FOLD_SQL = """
WITH l AS (SELECT user_id AS doc, value, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'patch' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'tombstone' ELSE 'none' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT *, max(n) FILTER (op = 'create') OVER w AS born, max(n) FILTER (op = 'tombstone') OVER w AS died FROM l WINDOW w AS (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, born IS NOT NULL AND (died IS NULL OR born > died) AS live FROM b),
e AS (SELECT * FROM a WHERE CASE op WHEN 'create' THEN NOT live WHEN 'tombstone' THEN born IS NOT NULL WHEN 'none' THEN false ELSE live END),
g AS (SELECT doc, max(n) FILTER (op = 'create') AS born, max(n) FILTER (op = 'tombstone') AS died, count(*) FILTER (op = 'create') AS creates, count(*) FILTER (op = 'update') AS updates, count(*) FILTER (op = 'patch') AS patches, count(*) FILTER (op IN ('create', 'update', 'tombstone')) AS epoch, round(arg_max(value, n) FILTER (op = 'patch'), 6) AS last_patch FROM e GROUP BY doc),
registry AS (SELECT doc, CASE WHEN died > born THEN 'TOMBSTONED' WHEN updates > 0 THEN 'ACTIVE_COLD_START' ELSE 'ACTIVE_LEARNED' END AS state, creates, updates, patches, epoch, last_patch FROM g)"""


def hot_ratio(s: SparkSession, d: str) -> DataFrame:
    return G.hot_ratio(registry_fold(s, d))


def tier1_reasons(s: SparkSession, d: str) -> DataFrame:
    reg = registry_fold(s, d).select("doc", "state", F.when(F.col("doc") % 4 == 0, "b").otherwise("a").alias("tenant"), F.when(F.col("doc") % 3 == 0, F.array(F.lit("staff"))).otherwise(F.array().cast("array<string>")).alias("roles"), (F.col("doc") % 10).alias("schema"))
    cand = table(s, d, "customer").select(F.col("c_custkey").alias("doc"))
    return G.tier1(cand, reg.withColumn("schema", F.when(F.col("schema") == 9, 1).otherwise(2)), "a", ["guest"], 2).groupBy("reason").agg(F.count("*").alias("n"))


def resolve_alias(s: SparkSession, d: str) -> DataFrame:
    """Customers as identifiers: some still own theirs, some are reached by an alias in time."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("sid"))
    reg = c.where("sid % 3 <> 0").select("sid", (F.col("sid") * 2).alias("doc"))
    al = table(s, d, "orders").where("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("sid")).agg(F.max("o_orderkey").alias("doc"), (F.max("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return G.resolve(c, reg, al, "1998-01-01 00:00:00")


def channel_share_24h(s: SparkSession, d: str) -> DataFrame:
    return G.trailing_share(table(s, d, "events"), "event_type = 'error'")


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Training rows over orders: the customer is the document, the priority the family."""
    o = table(s, d, "orders")
    fam = F.when(F.col("o_orderpriority").startswith("1"), "real_query").when(F.col("o_orderpriority").startswith("2"), "synthetic").otherwise("title")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row_id"), fam.alias("source"), F.lit(1.0).alias("weight"))


ROWS_SQL = """r AS (SELECT o_custkey AS doc_id, o_orderkey AS row_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'real_query' WHEN o_orderpriority LIKE '2%' THEN 'synthetic' ELSE 'title' END AS source FROM orders),
b AS (SELECT *, CASE WHEN source = 'real_query' THEN 3.0::DOUBLE ELSE 1.0 END * CASE WHEN max((source = 'real_query')::INT) OVER (PARTITION BY doc_id) = 0 THEN 1.5 ELSE 1.0 END AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY (source = 'real_query')::INT DESC, sha256(doc_id || ':' || row_id)) AS rn FROM r),
balanced AS (SELECT doc_id, row_id, source, weight FROM b WHERE rn <= 8)"""


def balance_units(s: SparkSession, d: str) -> DataFrame:
    return TR.balance_units(_rows(s, d), 8).select("doc_id", "row_id", "source", "weight")


def mix_families(s: SparkSession, d: str) -> DataFrame:
    m = TR.mix(balance_units(s, d), {"real_query": 0.5, "synthetic": 0.3, "title": 0.2, "absent": 0.4})
    return m.select("row_id", "source", F.round("weight", 6).alias("weight"))


def family_shares(s: SparkSession, d: str) -> DataFrame:
    return TR.family_shares(balance_units(s, d))


def coverage(s: SparkSession, d: str) -> DataFrame:
    return balance_units(s, d).groupBy("doc_id").agg(F.count("*").alias("n"))


def held_out(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(TR.held_out(F.col("doc_id"))).select("doc_id")


def stratified_replay(s: SparkSession, d: str) -> DataFrame:
    return TR.stratified_replay(_codes(s, d).select("doc", "c1"), 40).select("doc", F.col("c1").cast("long").alias("c1"))


def prefix_siblings(s: SparkSession, d: str) -> DataFrame:
    return TR.siblings(_codes(s, d)).select("doc", F.col("level").cast("long").alias("level"), "sibling")


def cost_model(s: SparkSession, d: str) -> DataFrame:
    """A scenario for each nation: its number sets the documents and the load."""
    n = F.col("n_nationkey")
    return E.costs(table(s, d, "nation").select(F.col("n_name").alias("scenario"), ((n + 1) * 100_000).alias("docs"), (n * 10 + 50).alias("qps"), F.when(n % 2 == 0, 0.4).alias("cache_hit")))


COST_SQL = """
WITH p AS (SELECT n_name AS scenario, (n_nationkey + 1) * 1e5 AS u, n_nationkey * 10 + 50.0 AS q, CASE WHEN n_nationkey % 2 = 0 THEN 0.6 ELSE 0.75 END AS miss FROM nation),
h AS (SELECT *, u * 832 / 72e6 AS g, 380000 * 65000.0 / 54e7 AS t, 27 * miss / 3000 AS own, 16 / 3000.0 AS dense, u / 1073741824.0 AS gu FROM p)
SELECT scenario, round(g, 6) AS generation_hours, round(g * 1.2, 6) AS generation_cost, round(t, 6) AS training_hours, round(t * 1.2, 6) AS training_cost, round(g / (g + t), 6) AS generation_share, round(q * own, 6) AS gpus,
round(own / 3, 6) AS cost_per_1k, round(dense / 3, 6) AS dense_cost_per_1k, round(own / dense, 6) AS ratio_vs_dense, round(gu * 10, 6) AS trie_gb, round(gu * 1536, 6) AS vectors_gb, round(gu * 1536 * 1.45, 6) AS hnsw_gb FROM h"""


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    return S.run_to_end(S.windowed_counts(S.event_stream(s, d)))


def stream_registry(s: SparkSession, d: str) -> DataFrame:
    return S.run_to_end(S.state_counts(S.event_stream(s, d)))


_P = "CAST(c1 AS VARCHAR) || '.' || c2 || '.' || c3 || '.' || c4"
_TAIL = "CASE WHEN ordinal < 255 THEN '' WHEN ordinal < 510 THEN '255.' ELSE '255.255.' END || (ordinal % 255)"
_U = "CASE WHEN ordinal < 255 THEN ordinal ELSE 255 END"
register("rq_encode", rq_encode, f"WITH {RQ} SELECT doc, c1, c2, c3, c4, round(err, 6) AS err FROM codes")
register("occupancy", occupancy, f"""WITH {RQ}, l AS (SELECT c1, c2, c3, c4, count(*) AS n FROM codes GROUP BY ALL), t AS (SELECT c1, c2, sum(n) AS n FROM l GROUP BY ALL), o AS (SELECT c1, sum(n) AS n FROM t GROUP BY ALL), z AS (SELECT sum(n) AS t FROM o)
SELECT round(max(n) / (any_value(t) / {K}), 6) AS l1_max_mean, count(*) AS l1_used, round(-sum(n / t * log2(n / t)), 6) AS l1_entropy, (SELECT round(max(n) / avg(n), 6) FROM t) AS l2_max_mean, (SELECT count(*) FROM l) AS leaf_prefixes, (SELECT max(n) FROM l) AS max_leaf, (SELECT count(*) FROM l WHERE n > 255) AS over_255 FROM o, z""")
register("sid_codec", sid_codec, f"WITH {RQ} SELECT doc, {_P} || '.' || {_TAIL} AS sid, lower(printf('%02x%02x%02x%02x', c1, c2, c3, c4) || CASE WHEN ordinal < 255 THEN '' WHEN ordinal < 510 THEN 'ff' ELSE 'ffff' END || printf('%02x', ordinal % 255)) AS packed, (8 + c1) || ' ' || (264 + c2) || ' ' || (520 + c3) || ' ' || (776 + c4) || ' ' || (1032 + {_U}) AS tokens, {_P} || '.' || {_TAIL} AS round_trip, ordinal FROM issued")
_KEYS = [("''", "c1"), ("CAST(c1 AS VARCHAR)", "c2"), ("c1 || '.' || c2", "c3"), ("c1 || '.' || c2 || '.' || c3", "c4"), (_P, _U)]
register("trie_nodes", trie_nodes, f"WITH {RQ}, k AS (" + " UNION ALL ".join(f"SELECT {i} AS depth, {p} AS prefix, {n} AS nxt FROM issued" for i, (p, n) in enumerate(_KEYS)) + ") SELECT CAST(depth AS BIGINT) AS depth, prefix, count(DISTINCT nxt) AS children, count(*) AS leaves FROM k GROUP BY depth, prefix")
def _numbers_sql() -> str:
    """Nodes by depth, numbered in the order of their codes by a plain window."""
    ctes, rows = [], ["SELECT CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS node, NULL::BIGINT AS parent, NULL::BIGINT AS code, CAST(0 AS BIGINT) AS first_child, (SELECT count(*) FROM n1) AS children, CAST(0 AS BIGINT) AS first_leaf, (SELECT count(*) FROM issued) AS leaves"]
    for depth in range(1, 5):
        keys = ", ".join(f"c{i}" for i in range(1, depth + 1))
        ctes.append(f"n{depth} AS (SELECT {keys}, count(*) AS leaves, row_number() OVER (ORDER BY {keys}) - 1 AS node, coalesce(sum(count(*)) OVER (ORDER BY {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_leaf FROM issued GROUP BY {keys})")
        above = ", ".join(f"c{i}" for i in range(1, depth))
        parent = f"(SELECT node FROM n{depth - 1} p WHERE ({above.replace('c', 'p.c')}) = ({above.replace('c', 'n.c')}))" if depth > 1 else "0"
        match = f"({keys.replace('c', 'k.c')}) = ({keys.replace('c', 'n.c')})"
        child, number = (f"(SELECT min(node) FROM n{depth + 1} k WHERE {match})", f"(SELECT count(*) FROM n{depth + 1} k WHERE {match})") if depth < 4 else ("NULL", "0")
        rows.append(f"SELECT {depth}, node, {parent}, c{depth}, {child}, {number}, first_leaf, leaves FROM n{depth} n")
    names = ["depth", "node", "parent", "code", "first_child", "children", "first_leaf", "leaves"]
    return f"WITH {RQ}, {', '.join(ctes)} SELECT {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in names)} FROM ({' UNION ALL '.join(rows)})"


register("trie_numbers", trie_numbers, _numbers_sql())
register("trie_edges", trie_edges, f"WITH {RQ} " + " UNION ALL ".join(f"SELECT DISTINCT CAST({i} AS BIGINT) AS depth, {_KEYS[i][0]} AS parent, CAST({_KEYS[i][1]} AS BIGINT) AS code, {_KEYS[i + 1][0]} AS child FROM issued" for i in range(4)))
register("trie_validate", trie_validate, "SELECT count(*) FILTER (vec_id % 7 = 0 AND vec_id % 5 <> 0) AS missing, count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 5 = 0) AS extra, count(*) FILTER (vec_id % 7 <> 0) AS leaves FROM embeddings")


def _beam_sql() -> str:
    ctes, src = [], "(SELECT doc AS qid, r, '' AS prefix, 0.0::DOUBLE AS score, 1 AS rank FROM x WHERE doc % 50 = 0)"
    for n in range(1, 5):
        parent, own, child = _KEYS[n - 1][0], _KEYS[n - 1][1], _KEYS[n][0]
        ctes.append(f"e{n} AS (SELECT DISTINCT {parent} AS prefix, {own} AS code, {child} AS child FROM issued)")
        ctes.append(f"s{n} AS MATERIALIZED (SELECT qid, prefix, child, code, score, rank, list_transform(list_zip(r, c), lambda p: p[1] - p[2]) AS r FROM {src} JOIN e{n} USING (prefix) JOIN b{n} USING (code))")
        ctes.append(f"z{n} AS MATERIALIZED (SELECT *, -list_aggregate(list_transform(r, lambda v: v * v), 'sum') / 0.05 AS z FROM s{n})")
        ctes.append(f"t{n} AS MATERIALIZED (SELECT *, max(z) OVER (PARTITION BY qid, prefix) AS m FROM z{n})")
        ctes.append(f"u{n} AS MATERIALIZED (SELECT qid, r, child AS prefix, code, rank AS old, round(score + z - m - ln(sum(exp(z - m)) OVER (PARTITION BY qid, prefix)), 6) AS score FROM t{n})")
        ctes.append(f"w{n} AS MATERIALIZED (SELECT * FROM (SELECT qid, r, prefix, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old, code) AS rank FROM u{n}) WHERE rank <= 8)")
        src = f"w{n}"
    return f"WITH {RQ}, {', '.join(ctes)} SELECT qid, prefix, round(score, 4) AS score, rank FROM w4"


register("beam_search", beam_search, _beam_sql())
register("registry_fold", registry_fold, FOLD_SQL + " SELECT * FROM registry")
register("hot_ratio", hot_ratio, FOLD_SQL + " SELECT round(count(*) FILTER (state = 'ACTIVE_COLD_START') / count(*) FILTER (state <> 'TOMBSTONED'), 6) AS hot_ratio, count(*) FILTER (state <> 'TOMBSTONED') AS live FROM registry")
register("tier1_reasons", tier1_reasons, FOLD_SQL + ", c AS (SELECT CASE WHEN state IS NULL THEN 'missing' WHEN state = 'TOMBSTONED' THEN 'tombstoned' WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'acl' WHEN c_custkey % 10 = 9 THEN 'schema' ELSE 'kept' END AS reason FROM customer LEFT JOIN registry ON doc = c_custkey) SELECT reason, count(*) AS n FROM c GROUP BY reason")
register("resolve_alias", resolve_alias, "WITH a AS (SELECT o_custkey AS sid, max(o_orderkey) AS doc, max(o_orderdate) + INTERVAL 30 DAY AS e FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT c_custkey AS sid, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 2 WHEN e > TIMESTAMP '1998-01-01' THEN doc END AS doc, coalesce(c_custkey % 3 = 0 AND e > TIMESTAMP '1998-01-01', false) AS via_alias FROM customer LEFT JOIN a ON sid = c_custkey")
register("channel_share_24h", channel_share_24h, "SELECT event_id, round(avg((event_type = 'error')::INT::DOUBLE) OVER w, 6) AS share, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)")
register("balance_units", balance_units, f"WITH {ROWS_SQL} SELECT * FROM balanced")
register("mix_families", mix_families, f"WITH {ROWS_SQL}, p AS (SELECT source, sum(weight) AS w FROM balanced GROUP BY source), q AS (SELECT source, w, CASE source WHEN 'real_query' THEN 0.5 WHEN 'synthetic' THEN 0.3 ELSE 0.2 END::DOUBLE AS ratio FROM p), f AS (SELECT source, ratio / sum(ratio) OVER () * sum(w) OVER () / w AS f FROM q) SELECT row_id, source, round(weight * f, 6) AS weight FROM balanced JOIN f USING (source)")
register("family_shares", family_shares, f"WITH {ROWS_SQL} SELECT source, round(sum(weight) / (SELECT sum(weight) FROM balanced), 6) AS share FROM balanced GROUP BY source")
register("coverage", coverage, f"WITH {ROWS_SQL} SELECT doc_id, count(*) AS n FROM balanced GROUP BY doc_id")
register("held_out", held_out, "SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256('20260901:' || doc_id), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE < 0.05")
register("stratified_replay", stratified_replay, f"WITH {RQ}, t AS (SELECT doc, c1, row_number() OVER (PARTITION BY c1 ORDER BY sha256(CAST(doc AS VARCHAR))) AS turn FROM codes), o AS (SELECT doc, c1, row_number() OVER (ORDER BY turn, c1) AS n FROM t) SELECT doc, c1 FROM o WHERE n <= 120")
register("prefix_siblings", prefix_siblings, f"WITH {RQ}, h AS (SELECT *, sha256(CAST(doc AS VARCHAR)) AS h FROM codes), p AS (" + " UNION ALL ".join("SELECT a.doc, CAST({0} AS BIGINT) AS level, b.doc AS sibling, b.h FROM h a JOIN h b ON a.c{1} <> b.c{1}{2}".format(n, n + 1, "".join(f" AND a.c{i} = b.c{i}" for i in range(1, n + 1))) for n in range(4)) + ") SELECT doc, level, sibling FROM (SELECT *, row_number() OVER (PARTITION BY doc, level ORDER BY h) AS k FROM p) WHERE k <= 2")
register("cost_model", cost_model, COST_SQL)
register("stream_windows", stream_windows, "SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS s FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY 1, 2")
register("stream_registry", stream_registry, "SELECT user_id, count(*) FILTER (event_type = 'signup') AS creates, count(*) FILTER (event_type = 'error') AS tombstones, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id")
