"""The quality classifier's features and scores restated plainly; its bounded training rows."""

import collections
import math
import random
import re

import numpy as np

from tessera.llm import quality as Q
from tessera.llm.common import labelled
from tessera.llm.hashing import slice_hashes

SCHEMA = "doc_id long, text string, n_chars long"
MARKS = "doc_id long, quality int, toxic int"


def plain_features(text, n_chars):
    """{feature: value}: hashed words of unit length, one bin of each statistic."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]

    def bucket(w):
        b = np.frombuffer(w.encode(), np.uint8)
        return int(slice_hashes(b, np.array([0]), np.array([len(b)]))[0] >> np.uint64(50))

    counts = collections.Counter(bucket(w) for w in low)
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    out = {f: math.log1p(c) / norm for f, c in counts.items()}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {t for t, c in collections.Counter(triples).items() if c > 1}
    repeated = {i + k for i, t in enumerate(triples) if t in twice for k in range(3)}
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    count = lambda p: len(re.findall(p, text))
    upper, letters = count("[A-Z]"), count("[A-Za-z]")
    stats = [
        (math.log1p(len(words)), 12.0), (sum(map(len, words)) / n, 20.0), (count(r"[#*$%&|<>]") / chars, 0.6), ((len(lines) - len(set(lines))) / max(len(lines), 1), 1.0),
        (len(repeated) / n, 1.0), (math.log1p(len(words) / max(len(lines), 1)), 8.0), (upper / max(letters, 1), 1.0), (len(counts) / n, 1.0),
        (count("[0-9]") / chars, 0.5), (count(r"[!?,;:.\-\"'()]") / n, 3.0), (count("[.!?]") / n, 1.0), (math.log1p(n_chars), 14.0),
    ]
    for k, (x, top) in enumerate(stats):
        out[Q.BUCKETS + k * Q.BINS + min(Q.BINS - 1, math.ceil(math.sqrt(min(max(x / top, 0), 1)) * (Q.BINS - 1)))] = 1.0
    return out


def test_features_and_scores_equal_a_plain_restatement(spark):
    r = random.Random(6)
    texts = ["", " \n ", "One", "é É ß", "A b\nA b\nA b\nc"] + ["".join(r.choice(["Word", "x1", "#", " ", "\n", ". ", "é", "the end", "!"]) + r.choice(["", " "]) for _ in range(r.randint(1, 120))) for _ in range(40)]
    encoded = [t.encode() for t in texts]
    b, off = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0] + [len(e) for e in encoded])
    d, f, x = Q.featurise(b, off, np.array([len(t) for t in texts]))
    want = [plain_features(t, len(t)) for t in texts]
    for i, w in enumerate(want):
        got = dict(zip(f[d == i].tolist(), x[d == i].tolist(), strict=True))
        assert got.keys() == w.keys() and all(abs(got[k] - w[k]) < 1e-9 for k in w), texts[i]
    m = Q.Machine(2)
    rng = np.random.default_rng(1)
    m.w0, m.w, m.v = 0.3, rng.normal(0, 0.5, Q.SIZE).astype(np.float32).astype(float), rng.normal(0, 0.3, m.v.shape).astype(np.float32).astype(float)
    rows = Q.score(spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3), m).collect()
    for row in rows:
        w = sorted(want[row.doc_id].items())
        z = m.w0 + sum(m.w[k] * v for k, v in w) + sum(float(m.v[a] @ m.v[c]) * va * vc for i, (a, va) in enumerate(w) for c, vc in w[:i])
        assert abs(row.score - 1 / (1 + math.exp(-z))) < 1e-5


def test_training_rows_are_bounded_whatever_their_doc_ids(spark):
    docs = spark.createDataFrame([(1, f"text {k}", 6) for k in range(20_000)] + [(7, "same", 4)] * 50, SCHEMA)
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 0), (77, 0, 0), (None, 1, 0), (7, None, 0)], MARKS)
    got = labelled(docs, marks, "quality", 300, ["n_chars"])
    assert got.count() == 300
    assert labelled(docs.where("doc_id = 7"), marks, "quality", 300).count() == 1
    assert {r.predicted for r in Q.classify(docs, marks).select("predicted").distinct().collect()} <= {0, 1}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, None), (None, "", 0)], SCHEMA)
    got = Q.classify(docs, spark.createDataFrame([], MARKS)).collect()
    assert len(got) == 3 and all(abs(r.score - 0.5) < 0.05 for r in got)
