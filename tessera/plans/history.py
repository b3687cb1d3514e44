"""Queries: identifiers at an instant, resolution through aliases and history, updates of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import history as H
from tessera.plans import lifecycle as L
from tessera.sources import table

CUT = "1996-06-01"


def _history(s: SparkSession, d: str) -> DataFrame:
    """Orders as versions: a customer's orders hold an identifier for up to 400 days, some are open; they overlap."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    until = F.when(k % 9 != 0, F.date_add(F.to_date("o_orderdate"), (k % 400 + 1).cast("int")).cast("timestamp_ntz"))
    return table(s, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 200).alias("sid"), k.cast("long").alias("doc"), day.alias("valid_from"), until.alias("valid_to"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_partkey") % 220).alias("sid"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"))


def identifier_history(s: SparkSession, d: str) -> DataFrame:
    """Who held each asked identifier on the day it was asked for."""
    return H.held_at(_asked(s, d), _history(s, d)).withColumnRenamed("at", "on_day")


def resolve_history(s: SparkSession, d: str) -> DataFrame:
    """The same with present holders and aliases before the history."""
    open_ = _history(s, d)
    docs = open_.where("doc % 50 = 0").select("sid", "doc", F.when(F.col("doc") % 100 == 0, "TOMBSTONED").otherwise("ACTIVE_LEARNED").alias("state"))
    aliases = open_.where("doc % 41 = 0").select("sid", "doc", F.coalesce("valid_to", F.lit(CUT).cast("timestamp_ntz")).alias("expires_at"))
    docs = docs.where("CAST(substr(sid, 2) AS INT) % 3 = 0")
    return H.resolve(_asked(s, d), docs, aliases, open_).groupBy("via").agg(F.count("*").alias("n"), F.sum("doc").alias("total"))


_HISTORY = """h AS (SELECT 's' || o_custkey % 200 AS sid, CAST(o_orderkey AS BIGINT) AS doc, CAST(o_orderdate AS TIMESTAMP) AS valid_from, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 + 1 AS INTEGER) AS TIMESTAMP) END AS valid_to FROM orders),
w AS (SELECT DISTINCT 's' || l_partkey % 220 AS sid, CAST(l_shipdate AS TIMESTAMP) AS on_day FROM lineitem),
held AS (SELECT sid, on_day, max(struct_pack(f := valid_from, d := doc)) AS b FROM w JOIN h USING (sid) WHERE valid_from <= on_day AND (valid_to IS NULL OR on_day < valid_to) GROUP BY sid, on_day),
hist AS (SELECT sid, on_day, b.d AS doc, b.f AS valid_from FROM w LEFT JOIN held USING (sid, on_day))"""

register("identifier_history", identifier_history, f"WITH {_HISTORY} SELECT sid, on_day, doc, valid_from FROM hist")
register("resolve_history", resolve_history, f"""WITH {_HISTORY},
n AS (SELECT sid, arg_min(doc, (doc % 100 = 0)::BIGINT * 1000000000000 + doc) AS doc FROM h WHERE doc % 50 = 0 AND CAST(substr(sid, 2) AS INT) % 3 = 0 GROUP BY sid),
a AS (SELECT sid, max(struct_pack(e := coalesce(valid_to, TIMESTAMP '{CUT}'), d := doc)) AS x FROM h WHERE doc % 41 = 0 GROUP BY sid),
r AS (SELECT CASE WHEN n.doc IS NOT NULL THEN 'registry' WHEN x.e > on_day THEN 'alias' WHEN hist.doc IS NOT NULL THEN 'history' END AS via, coalesce(n.doc, CASE WHEN x.e > on_day THEN x.d END, hist.doc) AS doc FROM hist LEFT JOIN n USING (sid) LEFT JOIN a USING (sid))
SELECT via, count(*) AS n, CAST(sum(doc) AS BIGINT) AS total FROM r GROUP BY via""")


# ------------------------------------------------------------ updates of units

_SHIFT = 3


def unit_update(s: SparkSession, d: str) -> DataFrame:
    """Vectors as units, five to a document: a third have new contents (the vector three further), some documents
    grow by a unit, others lose their last."""
    codes = L._codes(s, d)
    v = L._vectors(s, d).where("vec IS NOT NULL")
    old = codes.withColumns({"parent": F.floor(F.col("doc") / 5), "chunk": F.col("doc") % 5, "state": F.when(F.col("doc") % 31 == 0, "TOMBSTONED").otherwise("ACTIVE_LEARNED"), "hash": F.sha2(F.col("doc").cast("string"), 256), "alias_depth": (F.col("doc") % 4).cast("int")})
    old = old.where("parent % 17 <> 1")
    # the living keep their order; what a unit says now comes from its own vector or from one three further
    source = F.when(F.col("doc") % 3 == 0, F.col("doc") + _SHIFT).otherwise(F.col("doc"))
    living = codes.select("doc").where("doc % 31 <> 0")
    extra = living.select(F.floor(F.col("doc") / 5).alias("parent")).distinct().where("parent % 4 = 0").select("parent", (F.col("parent") * 5).alias("src"), F.lit(9).alias("at"))
    said = living.select(F.floor(F.col("doc") / 5).alias("parent"), source.alias("src"), (F.col("doc") % 5).alias("at")).where("parent % 6 <> 5 OR at <> 4").union(extra)
    n = codes.select(F.col("doc").alias("src"), *[F.col(f"c{i}").alias(f"n{i}") for i in range(1, 5)]).join(v.withColumnRenamed("doc", "src"), "src")
    said = said.join(n, "src")
    new = said.where("parent % 10 <> 7").select("parent", (F.row_number().over(Window.partitionBy("parent").orderBy("at")) - 1).alias("pos"), F.sha2(F.col("src").cast("string"), 256).alias("hash"), "vec", "n1", "n2", "n3", "n4")
    out = H.unit_changes(old, new, L._books(s, d), margin=0.6)
    return out.select("parent", "pos", "doc", "action", "reason", "reidentify", *[F.col(f"c{i}").cast("long").alias(f"c{i}") for i in range(1, 5)])


UNIT_SQL = f"""WITH {L.RQ},
oldu AS (SELECT *, doc // 5 AS parent, row_number() OVER (PARTITION BY doc // 5 ORDER BY doc) - 1 AS pos FROM codes WHERE doc % 31 <> 0 AND (doc // 5) % 17 <> 1),
ex AS (SELECT DISTINCT doc // 5 AS parent FROM codes WHERE doc % 31 <> 0 AND (doc // 5) % 4 = 0),
said AS (SELECT parent, src, spot FROM (SELECT doc // 5 AS parent, CASE WHEN doc % 3 = 0 THEN doc + {_SHIFT} ELSE doc END AS src, doc % 5 AS spot FROM codes WHERE doc % 31 <> 0) WHERE parent % 6 <> 5 OR spot <> 4 UNION ALL SELECT parent, parent * 5, 9 FROM ex),
newu AS (SELECT parent, src, row_number() OVER (PARTITION BY parent ORDER BY spot) - 1 AS pos, c1 AS n1, c2 AS n2, c3 AS n3, c4 AS n4, err AS d_n, r AS vec FROM said JOIN codes ON codes.doc = src JOIN x ON x.doc = src WHERE parent % 10 <> 7),
o AS (SELECT * FROM oldu WHERE parent IN (SELECT parent FROM newu)),
j AS (SELECT coalesce(o.parent, n.parent) AS parent, coalesce(o.pos, n.pos) AS pos, o.doc, n.src, c1, c2, c3, c4, n1, n2, n3, n4, d_n, vec, doc % 4 AS depth,
  CASE WHEN coalesce(o.parent, n.parent) NOT IN (SELECT parent FROM oldu) THEN 'unknown' WHEN o.doc IS NULL THEN 'new' WHEN n.src IS NULL THEN 'dropped' WHEN o.doc = n.src THEN 'kept' ELSE 'changed' END AS action FROM o FULL JOIN newu n ON o.parent = n.parent AND o.pos = n.pos),
m AS (SELECT j.doc, CASE WHEN c1 = n1 AND c2 = n2 AND c3 = n3 AND c4 = n4 THEN 'codes_unchanged' WHEN depth >= 2 THEN 'pinned_alias_depth' WHEN round(list_aggregate(list_transform(list_zip(vec, b1.c, b2.c, b3.c, b4.c), lambda p: (p[1] - p[2] - p[3] - p[4] - p[5]) * (p[1] - p[2] - p[3] - p[4] - p[5])), 'sum'), 9) - round(d_n, 9) <= 0.6 THEN 'within_hysteresis_margin' ELSE 'moved_past_margin' END AS reason
  FROM j JOIN b1 ON b1.code = c1 JOIN b2 ON b2.code = c2 JOIN b3 ON b3.code = c3 JOIN b4 ON b4.code = c4 WHERE action = 'changed')
SELECT parent, pos, doc, action, reason, coalesce(reason = 'moved_past_margin', false) AS reidentify,
  CAST(CASE WHEN t THEN n1 ELSE c1 END AS BIGINT) AS c1, CAST(CASE WHEN t THEN n2 ELSE c2 END AS BIGINT) AS c2, CAST(CASE WHEN t THEN n3 ELSE c3 END AS BIGINT) AS c3, CAST(CASE WHEN t THEN n4 ELSE c4 END AS BIGINT) AS c4
FROM (SELECT j.*, m.reason, action = 'new' OR coalesce(m.reason = 'moved_past_margin', false) AS t FROM j LEFT JOIN m USING (doc))"""

register("unit_update", unit_update, UNIT_SQL)
