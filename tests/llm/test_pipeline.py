"""Each stage of the pipeline on its own input, against plain restatements."""

import os

import corpus_pipeline as C
import pytest

from tessera.llm import mixing, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    for out in seen[1:-1]:
        assert out.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in seen[1].collect()} == good
    texts = {r.doc_id: r.text.lower().split() for r in seen[1].collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in texts.items()}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if comp[j] < comp[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    comp[i], changed = comp[j], True
    assert {r.doc_id for r in seen[2].collect()} == {i for i in comp if comp[i] == i}
    before, after = ({r.doc_id: r for r in x.collect()} for x in seen[2:4])
    for i, r in after.items():
        spans = pii.all_spans(before[i].text, pii.model())[1]
        assert r.n_chars == len(r.text) and (r.text == before[i].text) == (not spans)
    plan = {r.doc_id: r.taken for r in mixing.mix(seen[3]).collect()}
    words = {}
    for r in seen[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in plan.items() if n}
    pieces = seen[5].collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and sum(r.start == 0 for r in pieces) == seen[4].count()


def test_dedup_stage_keeps_one_row_of_each_group(spark):
    words = [f"w{i}" for i in range(60)]
    a, near_a, b = " ".join(words), " ".join([*words[:59], "end"]), " ".join(reversed(words))
    c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "cd")
    rows = [(1, a), (1, a), (1, near_a), (3, b), (5, b), (5, c), (7, c + " "), (6, d), (6, d), (6, a), (8, ""), (8, ""), (8, " "), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, ["web", "book"][n % 2], len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n_chars long").repartition(4)
    got = C.dedup_stage(spark, df, SF)
    assert got.columns == df.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    assert [t for i, t in got if i == 1] in ([a], [near_a])
    assert sorted(x for x in got if x[0] not in (None, 1)) == [(3, b), (5, c), (6, d), (8, ""), (8, " ")]
    assert [x for x in got if x[0] is None] == [(None, a), (None, a)]


WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, part string, parts string, size long, rank int, n string, text_hash string, length_ int, id string, shard int, taken string, component_key string, row string, `end_` int, size_ string"


def _odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "mail a.b@c.de now and call +1 (212) 555-0101", long, long, long + " end", "同じ 言葉 です", "x" * 50_000, "a b c d e f", "a b c d e f"]
    rows = [(i, t, None if i % 4 == 0 else "en", [None, "web", "é"][i % 3], None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here at all", "en", "web", 17), (None, None, None, None, None), (3, "another text of id three", None, None, None)]
    return [(*r, 0.5, "p", None, 7, 1, "k", "h", 3, "i", 4, "t", "c", "r", 9, "s") for r in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("k", range(len(C.STAGES)))
def test_stage_on_odd_rows(spark, k):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, an empty table."""
    name, stage = C.STAGES[k]
    rows = _odd_rows()
    docs = spark.createDataFrame(rows, WIDE).repartition(3)
    out = stage(spark, docs, SF)
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0
    if k < len(C.STAGES) - 1:
        assert out.columns == docs.columns == none.columns
    got = out.collect()
    key = lambda r: tuple(map(str, r))
    if name == "quality classifier":
        assert set(map(key, got)) <= set(map(key, rows))
    elif name == "MinHash near-dedup":
        kept = [r for r in got if r.doc_id is not None]
        assert set(map(key, got)) <= set(map(key, rows)) and len(got) - len(kept) == 2
        # ids 5, 6 and 7 are one group, 10 and 11 another, the row of id 4 came three times
        assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3, 3, 4, 5, 8, 9, 10]
    elif name == "PII":
        assert len(got) == len(rows)
        masked = [r.text for r in got if r.doc_id == 4]
        assert masked == ["mail [email] now and call [phone]"] * 3 and all(r.n_chars == len(masked[0]) for r in got if r.doc_id == 4)
        assert sorted(key((r.doc_id, r.text)) for r in got if r.doc_id != 4) == sorted(key(r[:2]) for r in rows if r[0] != 4)
    elif name == "mixing sources":
        words = lambda t: len((t or "").split())
        held = {}
        for r in rows:
            held[r[0]] = held.get(r[0], 0) + words(r[1])
        taken = {}
        for r in got:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + words(r.text)
        assert all(taken[i] <= 3 * held[i] for i in taken) and sum(taken.values()) > 0 and all(r.text.strip() for r in got)
    else:
        assert sum(r.start == 0 for r in got) == len(rows)
        full = {}
        for r in got:
            full.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for cuts in full.values():
            at = 0
            for offset, length in sorted(cuts):
                assert offset == at
                at += length
            assert at <= 2048
