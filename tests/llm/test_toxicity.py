"""The automaton against a plain distance, context, learning and scores on odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T
from tessera.llm.common import labelled

SCHEMA = "doc_id long, text string, lang string, score double, toxic int, h long, id long"


def distance(a, b):
    """Insertions, deletions, exchanges and swaps of neighbours; no letter is edited twice."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_reads_what_the_distance_says():
    r = random.Random(1)
    forms = ["abcab", "abba", "ababababa", "bcbcacab", "cabcabc", "aaaaa"]
    auto = T.Automaton(forms, [])
    for _ in range(4000):
        w = list(r.choice(forms)) if r.random() < 0.8 else [r.choice("abc") for _ in range(r.randint(1, 10))]
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k:k] = r.choice("abcx") if r.random() < 0.4 else []
            if k < len(w) and r.random() < 0.4:
                del w[k]
            if k + 1 < len(w) and r.random() < 0.3:
                w[k], w[k + 1] = w[k + 1], w[k]
        w = "".join(w)
        want = [distance(f, w) for f in forms if distance(f, w) <= T.edits(len(f))]
        got = auto.near(w) if w else None
        assert (got[1] if got else None) == (min(want) if want else None), w


def test_stems_signs_and_words():
    auto = T.Automaton(["idiot", "stupid"], ["bocos"])
    assert auto.near("bocosaur") == (2, 0) and auto.near("bocos") == (2, 0) and auto.near("boco") is None
    assert auto.near("1d10t") == (0, 0) and auto.near("$tup1d") == (1, 0)
    assert T.words_of("An 1D10T, st@pid! a$ $b tr$$h über-Wort") == ["an", "1d10t", "st@pid", "a", "b", "tr", "h", "über", "wort"]


def model():
    m = T.Model(["idiot", "worthless"], ["zork"], [5.0, 5.0, 4.0], frozenset({"idiom"}))
    x = np.array([T._features(100, [(0, 5, 0, 0, 1.0)] * k, m.weight) for k in (0, 0, 0, 1, 2, 3)])
    T._regress(m, x, np.array([0, 0, 0, 1, 1, 1.0]))
    return m


def test_context_separates_quotation_from_abuse():
    scan = T.Scanner(model())
    texts = ["you idiot", 'she said "idiot" to the court', "the word «idiot» is old", "an idiot walks here", "idiom", "İdiot idiott", ""]
    got = scan.hits(texts)
    weight = [h[1][0][4] if h[1] else None for h in got]
    assert weight[0] > weight[3] == 1 > weight[1] and weight[2] < 0.2 and weight[4] is None
    assert got[0][1][0][:4] == (4, 9, 0, 0) and got[6] == (0, [])
    assert [(s, e) for s, e, *_ in got[5][1]][-1] == (6, 12)  # code points of the text as it is
    p = [T.probability(model(), np.array([T._features(*x, model().weight)]))[0] for x in got]
    assert p[0] > p[1] and p[3] > p[1] and p[6] < 0.5


def test_many_texts_equal_each_alone():
    r = random.Random(3)
    scan, texts = T.Scanner(model()), []
    for _ in range(200):
        texts.append(" ".join(r.choice(["idiot", "idoit", "worthles", "zorkan", "plain", '"', "you", "\n", "é", "wort"]) for _ in range(r.randint(0, 40))))
    assert scan.hits(texts) == [scan.hits([t])[0] for t in texts]


def corpus(r, n):
    vocabulary = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 8))) for _ in range(400)]
    bad = ["grunkle", "snarfod", "plimbus", "wortzag"]
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.2)
        if toxic:
            for j in range(0, len(words), 12):
                words[j] = r.choice(bad) if r.random() < 0.6 else "quazz" + r.choice(vocabulary)
        rows.append((k, " ".join(words), "en", 0.0, 0, 1, 2))
        labels.append((k, 1, toxic))
    return rows, labels, bad


def test_learned_from_labels_and_held_out(spark):
    rows, labels, bad = corpus(random.Random(7), 900)
    rows += [(5000 + k, rows[0][1], "en", 0.0, 0, 1, 2) for k in range(200)]  # a much copied text, said to be toxic
    labels += [(5000 + k, 1, 1) for k in range(200)] + [(3, None, None), (None, 1, 1), (9999, 1, 1)]
    odd = [(6000, None, None, None, None, None, None), (6001, "", "en", 1.0, 1, 1, 1), (6002, "grunkel " * 30000, "en", 0.0, 0, 0, 0), (6003, "you snarfdo", "en", 0.0, 0, 0, 0), (None, "fine text", "en", 0.0, 0, 0, 0), (3, rows[3][1], "en", 0.0, 0, 1, 2)]
    docs, marks = spark.createDataFrame(rows + odd, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = T.fit(docs, marks)
    assert set(m.words) == set(bad) and [s[:5] for s in m.stems] == ["quazz"]
    out = T.classify(docs, marks).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[6002].predicted == 1 and by[6003].predicted == 1 and by[6000].predicted == by[6001].predicted == 0 and by[6000].score == by[6001].score and not by[None].held_out
    held = [(by[i].predicted, t) for i, _, t in labels if i in by and i is not None and i < 900 and by[i].held_out and t is not None]
    assert len(held) > 200 and sum(p == t for p, t in held) >= 0.99 * len(held)
    found = T.spans(docs.where("doc_id = 6003"), m).collect()
    assert [(r.start, r.end, r.found, r.form, r.edits) for r in found] == [(4, 11, "snarfdo", "snarfod", 1)]


def test_the_bound_holds_for_rows_and_copies_teach_once(spark):
    rows = [(1, f"text {k} " + "w " * (k % 7), "en", 0.0, 0, 1, 2) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert labelled(docs, marks, "toxic", 50).count() == 50
    same = spark.createDataFrame([(1, "a b c d e f g", "en", 0.0, 0, 1, 2)] * 100, SCHEMA)
    assert labelled(same, marks, "toxic", 50).count() == 1


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    no = spark.createDataFrame([], SCHEMA)
    assert T.classify(no, none).count() == 0
    got = T.classify(spark.createDataFrame([(1, "x", "en", 0.0, 0, 1, 2)], SCHEMA), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 0)]
    one_kind = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert T.classify(no, one_kind).count() == 0
