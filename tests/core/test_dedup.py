"""Near duplicates on small tables, against plain passes over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as T
from tessera.operators import curation as C
from tessera.operators import dedup as D


def _texts():
    r = random.Random(5)
    out = []
    for _ in range(12):
        w = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.choice([3, 60, 400]))]
        for _ in range(5):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                v[r.randrange(len(v))] = "x" + str(r.randrange(99))
            out.append(r.choice([" ", "\n"]).join(v))
    return [*out, "", None, "Straße ΑΣ é"]


def _plain(texts):
    """Signatures by the definition."""
    a, b = D.factors()
    return {i: ((D.shingle_hashes(t.casefold()).astype(np.int64)[:, None] * a + b) % D.PRIME).min(axis=0) for i, t in enumerate(texts) if t is not None}


def test_least_is_exact_at_the_ends():
    a, b = D.factors()
    for j in (0, 17, 127):
        for want in (0, 1, D.PRIME - 2, D.PRIME - 1):
            h = np.array([(want - int(b[j])) * pow(int(a[j]), -1, D.PRIME) % D.PRIME], np.uint64)
            assert D.least(h, *D.fractions())[j] == want
    h = np.random.default_rng(0).integers(0, D.PRIME, 700)
    assert (D.least(h.astype(np.uint64), *D.fractions()) == ((h[:, None] * a + b) % D.PRIME).min(axis=0)).all()


@pytest.mark.parametrize(("low", "tile"), [(0.85, 1024), (0.85, 2), (0.99, 1024), (1.0, 1024), (0.5, 2)])
def test_links(spark, monkeypatch, low, tile):
    monkeypatch.setattr(D, "TILE", tile)
    texts = _texts()
    sig = _plain(texts)
    want = {}
    for x in sig:
        for y in sig:
            same = sig[x] == sig[y]
            if x < y and same.mean() >= low and same.reshape(D.BANDS, -1).all(axis=1).any():
                want[x, y] = same.mean()
    rows = D.links(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), low).collect()
    assert {(r.a, r.b): r.j for r in rows} == want and len(rows) == len(want) > 5


def test_merges_and_their_ends(spark):
    texts = _texts()
    sig = _plain(texts)
    signed = D.signatures(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"))
    assert {r.doc: tuple(r.sig) for r in signed.collect()} == {i: tuple(map(int, s)) for i, s in sig.items()}
    want = {y: max(x for x in sig if x < y and (sig[x] == sig[y]).sum() >= 127) for y in sig if any(x < y and (sig[x] == sig[y]).sum() >= 127 for x in sig)}
    last = D.merges(signed)
    assert {r.doc: r.to for r in last.collect()} == want and len(want) > 5
    end = {}
    for y in sorted(want):
        end[y] = end.get(want[y], want[y])
    assert {r.doc: r.to for r in C.settled(last).collect()} == end


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "cut", lambda df: rounds.append(1) or df.localCheckpoint())
    got = C.settled(spark.range(1, 301).select(F.col("id").alias("doc"), (F.col("id") - 1).alias("to"))).collect()
    assert len(got) == 300 and {r.to for r in got} == {0} and len(rounds) <= 11


def test_dedup_map_reads_texts_once(spark, monkeypatch, tmp_path):
    texts = _texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = spark.sparkContext.accumulator(0)
    signatures = D.signatures
    monkeypatch.setattr(D, "signatures", lambda docs: signatures(docs.where(F.udf(lambda _: made.add(1) or True, "boolean")("doc"))))
    got = {r.doc: r.canonical for r in catalog.queries()["dedup_map"](spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, t in enumerate(texts) if t is not None} and made.value == len(texts) - 1
    copies = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").where("text IS NOT NULL").select("doc", T.content_hash(F.col("text")).alias("h"))
    first = copies.join(copies.groupBy("h").agg(F.min("doc").alias("canonical")), "h").select("doc", "canonical")
    links = catalog.queries()["near_dup_links"](spark, str(tmp_path))
    assert {r.doc: r.canonical for r in C.canonical(first, links)[0].collect()} == got


def test_content_digest(spark):
    r = random.Random(3)
    odd = ["a", "B", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1f", "\x85", " ", " ", "\xa0", "　", "\xdf", "\xc9", "Σ", "ﬁ", "Ａ", "é", "\xb5", "\U0001f600", "İ"]
    texts = ["", *("".join(r.choices(odd, k=r.randrange(1, 14))) for _ in range(3000)), *("".join(r.choices(odd[:9], k=r.randrange(1, 14))) for _ in range(3000))]
    for x in spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.content_hash(F.col("text")).alias("h")).collect():
        assert T.content_digest(x.text) == x.h, ascii(x.text)
