"""Generated queries and negatives: filters in order, coverage, dedup of documents, losses.

Defined results: null texts have no tokens; candidates come in the order of `pos`, equal ones by text;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.lineage import cut

# Weights of the levels in the loss, margins of the ranking loss.
LEVEL_WEIGHTS = [1.0, 1.0, 1.0, 1.0, 0.5]
MARGINS = [0.5, 0.5, 1.0, 1.0, 1.0]


def leaking(rows: DataFrame, n: int = 6, most: float = 0.5) -> DataFrame:
    """(doc, body, parts) -> (doc, pos, text, n_tokens, leaks): a part leaks if over `most` of its n-grams are the body's.
    A text is cut into tokens once, not for each part; a null part has neither."""

    def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
        return set(zip(*(words[i:] for i in range(n)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for i, (body, texts) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    whole = None
                    for pos, text in enumerate(texts.as_py() or []):
                        words = None if text is None else T.token_list(text)
                        own = grams(words or [])
                        if own and whole is None:
                            whole = grams(T.token_list(body.as_py() or ""))
                        out.append((i, pos, text, None if words is None else len(words), None if words is None else bool(own) and len(own & whole) / len(own) > most))
                at, *columns = zip(*out, strict=True) if out else ([],) * 5
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.bool_())
                yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", "pos", "text", "n_tokens", "leaks"])

    whole = rows.select("doc", "body", "parts")
    return whole.mapInArrow(run, f"doc {dict(whole.dtypes)['doc']}, pos int, text string, n_tokens long, leaks boolean")


def filter_queries(cands: DataFrame, keep: int = 10, like: float = 0.8) -> DataFrame:
    """(doc, pos, text, leaks, found) -> with `verdict`: duplicate of one kept before, leaked, round_trip_failed,
    accepted, or unseen once `keep` are accepted. The order decides, so a document's candidates
    are folded as one array (a few dozen queries)."""
    grams = T.ngrams(F.col("t"), 3)
    rows = cands.withColumn("t", T.tokens(F.coalesce("text", F.lit("")))).withColumn("g", grams)
    item = F.struct("pos", "text", "t", "g", F.coalesce("leaks", F.lit(False)).alias("leaks"), F.coalesce("found", F.lit(False)).alias("found"))
    lists = rows.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("c"))

    def alike(a: Column, b: Column) -> Column:
        none = (F.size(a["g"]) == 0) | (F.size(b["g"]) == 0)
        return F.when(none, (a["t"] == b["t"]).cast("double")).otherwise(F.size(F.array_intersect(a["g"], b["g"])) / F.size(F.array_union(a["g"], b["g"]))) > like

    def step(s: Column, x: Column) -> Column:
        verdict = (
            F.when(F.size(s["kept"]) >= keep, "unseen").when(F.exists(s["kept"], lambda k: alike(x, k)), "duplicate")
            .when(x["leaks"], "leaked").when(~x["found"], "round_trip_failed").otherwise("accepted")
        )
        kept = F.when(verdict == "accepted", F.concat(s["kept"], F.array(F.struct(x["t"].alias("t"), x["g"].alias("g"))))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), x["text"].alias("text"), verdict.alias("verdict")))).alias("out"))

    pos = dict(cands.dtypes)["pos"]
    zero = F.struct(F.array().cast("array<struct<t:array<string>,g:array<string>>>").alias("kept"), F.array().cast(f"array<struct<pos:{pos},text:string,verdict:string>>").alias("out"))
    return lists.select("doc", F.explode(F.aggregate("c", zero, step, lambda s: s["out"])).alias("o")).select("doc", "o.*")


VERDICTS = ["duplicate", "leaked", "round_trip_failed", "accepted"]


def filter_stats(verdicts: DataFrame) -> DataFrame:
    """Per document: candidates, and how many got each verdict."""
    return verdicts.groupBy("doc").agg(F.count("*").alias("generated"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def coverage_state(accepted: Column, attempts: Column, least: int = 8, most: int = 2) -> Column:
    return F.when(accepted >= least, "ok").when(attempts < most, "regenerate").otherwise("LOW_COVERAGE")


def interleave(generated: DataFrame) -> DataFrame:
    """(doc, pos, kind, ...) with `place`: the kinds in turn, in the order in which they first come."""
    kind = Window.partitionBy("doc", "kind")
    turns = generated.withColumn("turn_", F.row_number().over(kind.orderBy("pos"))).withColumn("first_", F.min("pos").over(kind))
    return turns.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("turn_", "first_", "pos")).cast("long")).drop("turn_", "first_")


def drop_false_negatives(negatives: DataFrame, links: DataFrame, scored: bool = True, tau: float = 0.7, delta: float = 0.1) -> DataFrame:
    """(qid, positive, doc, score, positive_score) with `verdict`: near_dup of the positive (links a, b both ways),
    score too high, or kept; without a scorer only links count."""
    both = links.select(F.col("a").alias("positive"), F.col("b").alias("doc")).union(links.select("b", "a")).distinct().withColumn("near_", F.lit(True))
    rows = negatives.join(both, ["positive", "doc"], "left")
    high = ~((F.col("score") <= tau) & (F.col("score") <= F.col("positive_score") - delta))
    verdict = F.when(F.col("near_"), "near_dup").when(F.lit(scored) & F.coalesce(high, F.lit(True)), "score").otherwise("kept")
    return rows.withColumn("verdict", verdict).drop("near_")


def discard_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("seen"), F.count_if(F.col("verdict") == "score").alias("dropped_score"), F.count_if(F.col("verdict") == "near_dup").alias("dropped_near_dup"), F.round(F.coalesce(F.avg((F.col("verdict") != "kept").cast("double")), F.lit(0.0)), 6).alias("discard_rate"))


def assemble(pools: DataFrame, shares: dict[str, float], total: int) -> DataFrame:
    """(qid, source, doc, pos) -> at most `total` documents a query: by share (half to even) from the largest
    share on, each document once, then what is left in the same order.

    A document counts for the first source that may take it; sources pass on what they have not
    the quota for. The quotas are few, so each source is one pass over the rows of its pool."""
    order = sorted(shares, key=lambda s: -shares[s])
    rows = pools.where(F.col("source").isin(order)).groupBy("qid", "source", "doc").agg(F.min("pos").alias("pos"))
    taken = None
    for n, source in enumerate(order):
        own = rows.where(F.col("source") == source)
        if taken is not None:
            own = own.join(taken.select("qid", "doc"), ["qid", "doc"], "left_anti")
        w = Window.partitionBy("qid").orderBy("pos", "doc")
        own = own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= round(shares[source] * total))
        part = own.select("qid", "doc", "source", F.lit(n).alias("round"), "pos")
        taken = part if taken is None else taken.union(part)
    prio = F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate(order) for x in (s, n)]), F.col("source"))
    rest = rows.join(taken.select("qid", "doc"), ["qid", "doc"], "left_anti").withColumn("round", F.lit(len(order)) + prio)
    every = taken.union(rest.select("qid", "doc", "source", "round", "pos"))
    once = every.withColumn("n_", F.row_number().over(Window.partitionBy("qid", "doc").orderBy("round", "pos"))).where("n_ = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("round", "pos", "doc")).cast("long")).where(F.col("place") <= total).drop("n_", "round", "pos")


def settled(last: DataFrame) -> DataFrame:
    """(doc, to), to < doc -> the same with the end of each chain. Every round doubles the steps taken and is written,
    so neither the links nor earlier rounds are made again."""
    into = cut(last)
    while True:
        up = into.select(F.col("doc").alias("to"), F.col("to").alias("next"))
        joined = cut(into.join(up, "to", "left").select("doc", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        into = joined.select("doc", "to")
        if not joined.where("moved").limit(1).count():
            return into


def merged(copies: DataFrame, into: DataFrame) -> DataFrame:
    """Exact groups (doc, canonical) whose canonical documents go `into` others."""
    to = into.select(F.col("doc").alias("canonical"), "to")
    return copies.join(to, "canonical", "left").select("doc", F.coalesce("to", "canonical").alias("canonical"))


def canonical(copies: DataFrame, links: DataFrame, high: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Exact groups (doc, canonical) and links (a < b, j) -> (doc, canonical) with links from `high` on merged,
    and the other links between canonical documents. A merge takes the canonical that its smaller
    end had when pairs come in order: one pass, not a closure, so chains keep their last step."""
    # in order of (a, b) the last pair that names b decides; its a has been settled by smaller pairs
    into = settled(links.where(F.col("j") >= high).groupBy(F.col("b").alias("doc")).agg(F.max("a").alias("to")))
    groups = merged(copies, into)
    rest = links.where(F.col("j") < high).join(into.select(F.col("doc").alias("a"), F.col("to").alias("ta")), "a", "left").join(into.select(F.col("doc").alias("b"), F.col("to").alias("tb")), "b", "left")
    moved = rest.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "j").where("a <> b")
    return groups, moved


# ------------------------------------------------------------ losses (evaluation)


def _log_p(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - total)


def sequence_loss(rows: DataFrame, smoothing: float = 0.1, weighted: bool = True) -> DataFrame:
    """(id, level from 0, logits, target, weight) -> mean of the weighted cross entropies of the levels; the last
    level, the ordinal, is not smoothed."""
    lp, k = F.col("lp"), F.size("lp")
    eps = F.when(F.col("level") < 4, smoothing).otherwise(0.0)
    ce = -(1 - eps) * F.get("lp", F.col("target")) - eps / k * F.aggregate(lp, F.lit(0.0), lambda a, x: a + x)
    alpha = F.element_at(F.array(*(F.lit(w) for w in LEVEL_WEIGHTS)), F.col("level") + 1)
    each = rows.withColumn("lp", _log_p(F.col("logits"))).groupBy("id").agg(F.sum(alpha * ce).alias("ce"), F.first("weight").alias("w"))
    w = F.col("w") if weighted else F.lit(1.0)
    return each.agg(F.round(F.sum(F.col("ce") * w) / F.greatest(F.sum(w), F.lit(1e-9)), 6).alias("loss"))


def divergence(positive: Column, negative: Column) -> Column:
    """First level at which two code arrays differ, their length if none."""
    at = F.array_position(F.zip_with(positive, negative, lambda x, y: x != y), True)
    return F.when(at > 0, at - 1).otherwise(F.size(positive)).cast("int")


def rank_loss(rows: DataFrame) -> DataFrame:
    """(id, logits by level, pos, neg, real) one row a negative -> mean hinge at the level where it leaves the positive."""
    r = rows.where("real").withColumn("at", divergence(F.col("pos"), F.col("neg"))).where(F.col("at") < F.size("pos"))
    lp = _log_p(F.get("logits", F.col("at")))
    r = r.withColumn("lp", lp).withColumn("m", F.element_at(F.array(*(F.lit(m) for m in MARGINS)), F.col("at") + 1))
    hinge = F.greatest(F.lit(0.0), F.col("m") - F.get("lp", F.get("pos", F.col("at"))) + F.get("lp", F.get("neg", F.col("at"))))
    return r.agg(F.round(F.sum(hinge) / F.greatest(F.count("*"), F.lit(1)), 6).alias("loss"), F.count("*").alias("n"))


def proximal(params: DataFrame, reference: DataFrame) -> DataFrame:
    """Squared distance of parameters (name, value) to their reference."""
    both = params.select("name", "value").join(reference.select("name", F.col("value").alias("ref")), "name")
    return both.agg(F.round(F.coalesce(F.sum((F.col("value") - F.col("ref")) ** 2), F.lit(0.0)), 6).alias("distance"))
