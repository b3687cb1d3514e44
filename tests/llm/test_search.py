"""Lexical search against a plain restatement; the bisection; exact stopping."""

import collections
import math
import random
import re

import numpy as np

from tessera.llm import search as S

DOCS = "doc_id long, text string, lang string, n long, terms string, salt long, score long"
ITEMS = "item_id long, text string, rank int, q long"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k):
    bags = [(i, collections.Counter(split(t))) for i, t, *_ in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text, *_ in items:
        scored = []
        for i, b in bags:
            n = sum(b.values())
            s = 0
            for t in set(split(text)) & set(b):
                m = 50 + (50 * n * n_docs) // length
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def corpus(r, n):
    topics = [["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(30)] for _ in range(6)]
    common = ["the", "of", "and", "Ä", "x1"]
    rows = [(k, " ".join(r.choice(common if r.random() < 0.4 else r.choice(topics) if r.random() < 0.05 else topics[k % 6]) + r.choice(["", ",", "!", "\x00", "_"]) for _ in range(r.randint(1, 60))), "en", 1, "t", 5, 6) for k in range(n)]
    rows += [(9000, None, "en", 1, "t", 5, 6), (9001, "", "en", 1, "t", 5, 6), (9002, " ..", "en", 1, "t", 5, 6), (None, rows[0][1], "en", 1, "t", 5, 6), (7, "THE The the", "en", 1, "t", 5, 6), (9003, "the " * 50000 + topics[0][0], "en", 1, "t", 5, 6)]
    rows += [(10000 + k // 2, rows[1][1], "de", 1, "t", 5, 6) for k in range(200)]
    items = [(k, " ".join(r.choice(topics[k % 6] + common) for _ in range(r.randint(1, 15))), 3, 4) for k in range(12)]
    return rows, items + [(50, None, 1, 1), (51, "unknownterm", 1, 1), (52, rows[2][1], 1, 1), (53, "", 1, 1)]


def test_search_equals_a_plain_restatement(spark):
    rows, items = corpus(random.Random(2), 500)
    docs, queries = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = plain(rows, items, 20)
    small = S.Search(docs, 20, shard=8, group_docs=64, block=5)  # upper levels, several groups, blocks of queries
    assert collections.Counter(tuple(r) for r in small.run(queries).collect()) == want
    assert 0 < small.visited < small.pairs
    assert collections.Counter(tuple(r) for r in S.search(docs, queries, 20).collect()) == want


def test_empty_tables(spark):
    no, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", 1, 1)], ITEMS)
    assert S.search(no, some).count() == 0 and S.search(no, none).count() == 0
    assert S.search(spark.createDataFrame([(1, None, "", 1, "", 1, 1)], DOCS), some).count() == 0
    assert S.search(spark.createDataFrame([(1, "a", "", 1, "", 1, 1)], DOCS), none).count() == 0


def test_bisection_brings_like_documents_together():
    r = np.random.default_rng(0)
    kind = r.integers(0, 4, 512)
    docs = [np.unique(np.concatenate([100 * k + r.integers(0, 40, 12), 1000 + r.integers(0, 10, 3)])) for k in kind]
    ptr = np.cumsum([0] + [len(d) for d in docs])
    order = S.reorder(ptr, np.concatenate(docs), leaf=64)
    assert sorted(order) == list(range(512))
    share = [np.bincount(kind[order[lo : lo + 64]], minlength=4).max() / 64 for lo in range(0, 512, 64)]
    assert np.mean(share) > 0.85 > 2 * np.mean(np.bincount(kind, minlength=4).max() / 512)
    tree = S.grow(*_places(docs), 2)
    leaf = tree.leaf(*S._hashed(np.repeat(np.arange(512), np.diff(ptr)), np.concatenate(docs)), 512)
    assert np.mean([np.bincount(kind[leaf == k], minlength=4).max() / max((leaf == k).sum(), 1) for k in range(4)]) > 0.7
    same = S.reorder(np.arange(0, 3001, 3), np.tile([1, 2, 3], 1000), leaf=16)  # copies only
    assert sorted(same) == list(range(1000))
    assert S.reorder(np.zeros(1, np.int64), np.zeros(0, np.int64)).tolist() == []


def _places(docs):
    doc, place = S._hashed(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs))
    return np.searchsorted(doc, np.arange(len(docs) + 1)), place


def test_factor_beyond_64_bits():
    tf, n = np.array([1, 3]), np.array([10**9, 5])
    docs, length = 10**11, 10**13
    want = [(10**9 * t) // (1000 * t + 20 * (50 + 50 * m * docs // length)) for t, m in zip(tf.tolist(), n.tolist())]
    assert S.factor(tf, n, docs, length).tolist() == want
    assert S.factor(np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 1).tolist() == []


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "slice_hashes", lambda b, s, e: np.zeros(len(s), np.uint64))
    v = S.Vocabulary([b"ab", b"cd", b"xyz"])
    b = np.frombuffer(b"cd ab xyz zz", np.uint8)
    assert v.find(b, np.array([0, 3, 6, 10]), np.array([2, 5, 9, 12])).tolist() == [1, 0, 2, -1]
