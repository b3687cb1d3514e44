"""The filter audit against a plain restatement, and its word counting."""

import collections
import itertools
import random
import re

import numpy as np

from tessera.llm import audit

SCHEMA = "doc_id long, text string, lang string, n long, fails int, part string, digest string, mask int, good int"


def plain(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and i > least[t]:
            f.add("E")
        mine = [x for x in labels if x[0] == i and i is not None]
        seen.append((lang or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                shapley[f] += len(gone)
                redundant = sum(f in s[1] for s in own) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(s[1] == {f} for s in own), sum(s[2] for s in gone), sum(s[3] for s in gone)]
        for p, o, k in list(out):
            if p == part:
                out[p, o, k].append(shapley[o[k - 1]])
    return out


def test_audit_equals_a_plain_restatement(spark):
    r = random.Random(4)
    texts = [None, "", "  ", "A B", "a#b", "word " * 250, " ".join(f"w{k}" for k in range(250)), " ".join(f"é{k}" for k in range(20000)), "X " * 300, "\x1c a \x85 b"]
    rows = []
    for _ in range(120):
        rows.append((r.choice([*range(40), None]), r.choice(texts), r.choice(["en", "de", "", None]), 1, 9, "x", "y", 3, 4))
    rows += [(500 + k, " ".join(r.choice(["aa", "Bb", "c%"]) for _ in range(r.randint(1, 400))), "en", 1, 9, "x", "y", 3, 4) for k in range(30)]
    labels = [(r.randrange(40), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(30)] + [(None, 1, 1), (505, 1, 0), (505, 0, 1)]
    got = audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 600 * 3
    for x in got:
        assert [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] == want[x.part, x.filter_order, x.step]


def test_audit_of_empty_tables(spark):
    no = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(no, none).count() == 0
    one = spark.createDataFrame([(1, None, None, 1, 1, "", "", 1, 1)], SCHEMA)
    got = audit.audit(one, none).collect()
    assert len(got) == 600 and {r.part for r in got} == {""}
    assert all((r.removed, r.shapley) == ((1, 120) if r.filter_order[r.step - 1] == "A" else (0, 0)) for r in got)


def test_words_that_share_a_hash_are_told_apart():
    b = np.frombuffer(b"ab cd ab xyz cd", np.uint8)
    start, end = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 8, 12, 15])
    doc = np.zeros(5, np.int64)
    assert audit.distinct_words(b, start, end, doc, 1).tolist() == [3]
    assert audit.distinct_words(b, start, end, doc, 1, hashes=np.zeros(5, np.uint64)).tolist() == [3]
    two = audit.distinct_words(b, start, end, np.array([0, 0, 1, 1, 1]), 3, hashes=np.array([1, 1, 2, 2, 2], np.uint64))
    assert two.tolist() == [2, 3, 0]
