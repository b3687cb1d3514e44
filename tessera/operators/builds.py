"""A training dataset as one job: rows of all families, filters, negatives, balance and mixing, and its report.

corpus: (doc, title, text, metadata map, twin, codes array<int>, ordinal); `twin` names the group of copies of a document or is null.
cands:  (doc, pos, text, found), generated queries, `found` if a search for one returned its document.
logs:   (doc, qid, text, ts), real queries; those before the cut count.
pools:  (doc, row_id, source, other, pos), candidates for negatives; a null row_id stands for all rows of the document.

Held-out documents are told by a hash of their id, so no list of them is made, and give no row at all. Every table
is read once: corpus rows and targets come from one written projection.

Defined results: null texts are empty, an empty title or metadata gives no row, null metadata values are left out; rows of
documents that the corpus lacks are dropped; corpus ids, (doc, pos) and (doc, qid) are unique; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import curation as C
from tessera.operators import training as TR
from tessera.sources.lineage import cut

PREFIX_WORDS = 48  # words of the text that stand for it
# Shares of the families and of the sources of negatives.
RATIOS = {"synthetic_query": 0.60, "real_query": 0.15, "title": 0.10, "content_prefix": 0.10, "metadata": 0.05}
SHARES = {"prefix_sibling": 0.40, "self": 0.25, "bm25": 0.20, "dense": 0.10, "random": 0.05}


def known(corpus: DataFrame, fraction: float = 0.05, seed: int = 20260901) -> DataFrame:
    """The documents that training may see."""
    return corpus.where(~TR.held_out(F.col("doc"), fraction, seed))


def rendered(metadata: Column) -> Column:
    """key: value of all entries but the chunk number, by key."""
    entries = F.filter(F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>"))), lambda e: (e["key"] != "chunk") & e["value"].isNotNull())
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def document_rows(corpus: DataFrame) -> DataFrame:
    """(doc, row_id, source, input): title, first words and metadata of each document, in one pass."""
    text, title, meta = F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")), rendered(F.col("metadata"))
    first = F.array_join(F.slice(T.words(text), 1, PREFIX_WORDS), " ")
    made = [("title", title, title != ""), ("content_prefix", first, F.lit(True)), ("metadata", meta, meta != "")]
    item = [F.when(keep, F.struct(F.lit(n).alias("source"), t.alias("t"))) for n, t, keep in made]
    rows = corpus.select("doc", F.explode(F.array_compact(F.array(*item))).alias("r")).select("doc", F.col("r.source").alias("source"), "r.t")
    shown = F.when(F.col("source") == "content_prefix", T.format_document(F.col("t"))).otherwise(T.format_query(F.col("t")))
    return rows.select("doc", F.col("source").alias("row_id"), "source", shown.alias("input"))


def checked(cands: DataFrame, corpus: DataFrame, keep: int = 10) -> DataFrame:
    """Candidates of known documents with their verdict; one leaks if over half of its 6-grams are the text's."""
    both = cands.join(corpus.select("doc", F.col("text").alias("body")), "doc")
    toks = both.select("doc", "pos", "text", "found", T.tokens(F.coalesce("text", F.lit(""))).alias("t"), T.tokens(F.coalesce("body", F.lit(""))).alias("u"))
    grams = toks.select("doc", "pos", "text", "found", T.ngrams(F.col("t"), 6).alias("a"), T.ngrams(F.col("u"), 6).alias("b"))
    leaks = F.when(F.size("a") == 0, False).otherwise(F.size(F.array_intersect("a", "b")) / F.size("a") > 0.5)
    flagged = cut(grams.select("doc", "pos", "text", "found", leaks.alias("leaks")))  # the fold must not take the n-grams in
    return C.filter_queries(flagged, keep)


def random_pool(corpus: DataFrame, size: int = 8) -> DataFrame:
    """Others by chance: documents are dealt to bins of about size + 1 by one hash, and a document asks one bin by another."""
    bins = F.lit(max(1, corpus.count() // (size + 1)))
    member = corpus.select(F.floor(TR.unit_hash(F.lit("bin"), F.col("doc").cast("string")) * bins).alias("bin"), F.col("doc").alias("other"))
    asks = corpus.select("doc", F.floor(TR.unit_hash(F.lit("ask"), F.col("doc").cast("string")) * bins).alias("bin"))
    pairs = asks.join(member, "bin").where("doc <> other")
    return pairs.select("doc", F.lit(None).cast("string").alias("row_id"), F.lit("random").alias("source"), "other", F.lit(0).alias("pos"))


def negatives(rows: DataFrame, corpus: DataFrame, pools: DataFrame, shares: dict[str, float], total: int = 8) -> DataFrame:
    """(doc, row_id, negatives): up to `total` identifiers a row, none of the document or of its copies."""
    asked = rows.where("source <> 'content_prefix'").select("doc", "row_id")
    twins = corpus.select("doc", "twin")
    wide = pools.where("row_id IS NULL").drop("row_id").join(asked, "doc").select("doc", "row_id", "source", "other", "pos")
    own = pools.where("row_id IS NOT NULL").join(asked, ["doc", "row_id"]).select("doc", "row_id", "source", "other", "pos")
    every = wide.unionByName(own).where("doc <> other").join(twins, "doc").join(twins.select(F.col("doc").alias("other"), F.col("twin").alias("t_")), "other")
    fair = every.where(~F.coalesce(F.col("twin") == F.col("t_"), F.lit(False)))
    fair = cut(fair.select(F.struct("doc", "row_id").alias("qid"), "source", F.col("other").alias("doc"), "pos"))  # assembling reads it once a source
    picked = C.assemble(fair, shares, total)
    named = picked.join(corpus.select("doc", "codes", "ordinal"), "doc")
    lists = named.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "doc", "codes", "ordinal"))).alias("n"))  # at most `total` of a row
    return lists.select("qid.doc", "qid.row_id", F.transform("n", lambda x: F.struct(x["doc"].alias("doc"), x["codes"].alias("codes"), x["ordinal"].alias("ordinal"))).alias("negatives"))


def build(
    corpus: DataFrame, cands: DataFrame, logs: DataFrame, pools: DataFrame, before: Column | None = None, keep: int = 10, least: int = 8, most: int = 23,
    ratios: dict[str, float] | None = None, shares: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_id, source, input, codes, ordinal, weight, negatives) and the report (name, value)."""
    corpus = cut(corpus.select("doc", "title", "text", "metadata", "twin", "codes", "ordinal"))
    seen = known(corpus)
    verdicts = cut(checked(cands, seen, keep))
    made = verdicts.where("verdict = 'accepted'").select("doc", F.concat(F.lit("synthetic_query-"), "pos").alias("row_id"), F.lit("synthetic_query").alias("source"), T.format_query(F.coalesce("text", F.lit(""))).alias("input"))
    real = known(logs if before is None else logs.where(F.col("ts") < before)).select("doc", F.concat(F.lit("real_query-"), "qid").alias("row_id"), F.lit("real_query").alias("source"), T.format_query(F.coalesce("text", F.lit(""))).alias("input"))
    told = made.unionByName(real).join(seen.select("doc"), "doc", "left_semi").unionByName(document_rows(seen))
    even = TR.balance_units(told.withColumnRenamed("doc", "doc_id").withColumn("weight", F.lit(1.0)), most)
    rows = cut(TR.mix(even, ratios or RATIOS).withColumnRenamed("doc_id", "doc"))  # what the cap drops needs no negatives
    found = negatives(rows, corpus, pools, shares or SHARES)
    none = F.array().cast(dict(found.dtypes)["negatives"])
    out = rows.join(corpus.select("doc", "codes", "ordinal"), "doc").join(found, ["doc", "row_id"], "left").withColumn("negatives", F.coalesce("negatives", none))
    out = cut(out.select(F.col("doc").alias("doc_id"), "row_id", "source", "input", "codes", "ordinal", "weight", "negatives"))
    return out, report(corpus, verdicts, out, least)


def report(corpus: DataFrame, verdicts: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(name, value): documents held out, verdicts, documents short of queries or rows, rows and weight share of each family."""

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns))).alias("r")).select("r.*")

    held = corpus.agg(F.count("*").alias("docs"), F.count_if(TR.held_out(F.col("doc"))).alias("held_out_docs"))
    per = C.filter_stats(verdicts).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["generated", *C.VERDICTS]), F.count_if(F.col("accepted") < least).alias("low_coverage_docs"))
    got = known(corpus).select("doc").join(rows.groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("n"), F.sum(F.size("negatives")).alias("k")), "doc", "left")
    units = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("negatives"), F.count_if(F.coalesce("n", F.lit(0)) < least).alias("units_below_floor"))
    shares = TR.family_shares(rows).select(F.concat(F.lit("share_"), "source").alias("name"), F.col("share").alias("value"))
    return long(held).unionByName(long(per)).unionByName(long(units)).unionByName(shares)
