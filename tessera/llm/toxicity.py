"""Toxicity: Levenshtein automata over a lexicon trie, hits weighed by their context.

1. Lexicon. From at most ``TRAIN_ROWS`` labelled rows (a documented bound, taken after the
   join with the texts, in the order of a hash) forms are counted in Spark: whole words and
   stems (the first 3 to 8 letters of longer words). A form enters with its log ratio of
   rates as weight if toxic rows hold it at ``RATIO`` times the rate of the others and the
   likelihood ratio is beyond what as many tries give by chance; a word covered by a stem is
   not entered again. At most ``LEXICON`` forms, the most telling first.
2. Automaton. All forms stand in one trie. A state is the set of (node, edits) that a read
   prefix can be at: up to one edit for words of 5 to 7 letters, two from 8 on (insertion,
   deletion, exchange of a letter, swap of two neighbours), none for stems, which accept any
   ending. Digits and signs that stand for letters (0 1 3 4 5 7 @ $) read as those. The sets
   are made into a table only as texts reach them; all words of a block walk through the
   table together, and most leave it after a few letters. Words that clean training rows
   hold are never taken as misspellings.
3. Context. Each hit has a window of characters and words around it: between quotation marks,
   or near a word of reporting ("said", "the word"), it counts little, next to an address in
   the second person or to another hit somewhat more.
4. Score. A logistic regression on the sums (density, amount, different forms, share of
   misspellings, share of quotations), fitted on the same rows.

Whole texts are read; batches are handled in blocks of whole texts. Labels, lang, source and
doc_id are never inputs of a score.

Defined results: a null or empty text has no hits and gets the score of that; null labels are
not learned from; a doc_id with several labels counts with each; rows that share a doc_id are
scored one by one; with no labels of either kind the score is 0.5 for every row (predicted 0);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, labelled, trimmed
from .hashing import scramble, slice_hashes
from .words import blocks, word_runs

TRAIN_ROWS = 20_000
LEXICON = 512
RATIO = 6.0
STEM = range(3, 9)
SHINGLE = 5
MANY = 3
WINDOW_CHARS = 80
NEAR = 6
THRESHOLD = 0.7

# Signs that stand for letters, and words of reporting and of address in four languages.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
REPORTING = frozenset("said says wrote called word words term terms quote quoted quotes slur insult reported sagte schrieb nannte wort begriff zitat zitiert sogenannte dit écrit appelé mot terme cité citation dijo escribió llamó palabra término cita citado".split())
ADDRESS = frozenset("you your you're yours du dich dein deine ihr euch tu toi vous ton votre tú usted eres tus".split())
_OPEN, _CLOSE = "“«„‘", "”»“’"


def edits(size: int) -> int:
    """How many edits a word of that many letters may have."""
    return 0 if size < 5 else 1 if size < 8 else 2


# ---------------------------------------------------------------- automaton


class Automaton:
    """The subset automaton of all forms with their edits, made as it is walked.

    A member of a state is (node, edits so far, node to swap into or -1)."""

    def __init__(self, words: list[str], stems: list[str]):
        self.letters: dict[str, int] = {}
        self._swaps: dict[tuple[int, int], int] = {}
        for x in [*words, *stems]:
            for c in x:
                self.letters.setdefault(c, len(self.letters) + 1)
        self.next: list[dict[int, int]] = [{}]
        self.room = [0]  # edits that some form below may still have
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        for k, (x, stem) in enumerate([(w, False) for w in words] + [(s, True) for s in stems]):
            at, most = 0, 0 if stem else edits(len(x))
            self.room[0] = max(self.room[0], most)
            for c in x:
                at = self.next[at].setdefault(self.letters[c], len(self.next))
                if at == len(self.word):
                    self.next.append({})
                    self.room.append(0)
                    self.word.append(-1)
                    self.stem.append(-1)
                self.room[at] = max(self.room[at], most)
            (self.stem if stem else self.word)[at] = k
        self.most = [edits(len(w)) for w in words] + [0] * len(stems)
        self.classes = len(self.letters) + 2  # 0: no letter; the last: a letter of no form
        self.table = np.full((64, self.classes), -1, np.int32)
        self.accept = np.full(64, -1, np.int32)  # entry * 4 + distance
        self.sticky = np.zeros(64, bool)  # a stem was read: any ending is accepted
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0, -1)}))

    def _closed(self, members: Iterable[tuple[int, int, int]]) -> frozenset:
        """With the letters left out: a child may be entered at the cost of an edit."""
        best: dict[tuple[int, int], int] = {}
        todo = list(members)
        while todo:
            node, e, swap = todo.pop()
            if e > self.room[node] or best.get((node, swap), 9) <= e:
                continue
            best[node, swap] = e
            if swap < 0:
                todo += [(child, e + 1, -1) for child in self.next[node].values()]
        return frozenset((node, e, swap) for (node, swap), e in best.items())

    def _state(self, members: frozenset) -> int:
        if members in self.number:
            return self.number[members]
        k = self.number[members] = len(self.sets)
        self.sets.append(members)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
            self.sticky = np.concatenate([self.sticky, np.zeros_like(self.sticky)])
        stems = [self.stem[n] for n, e, swap in members if swap < 0 and e == 0 and self.stem[n] >= 0]
        found = [(e, self.word[n]) for n, e, swap in members if swap < 0 and self.word[n] >= 0 and e <= self.most[self.word[n]]]
        if stems:
            found.append((0, stems[0]))
        if found:
            e, entry = min(found)
            self.accept[k] = entry * 4 + e
        self.sticky[k] = bool(stems)
        return k

    def _step(self, state: int, c: int) -> int:
        out = set()
        for node, e, swap in self.sets[state]:
            if swap >= 0:
                child = self.next[swap].get(c)  # the first letter of a swapped pair, read second
                if child is not None and child == node:
                    out.add((node, e, -1))
                continue
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, e, -1))
            if e < 2:
                out.add((node, e + 1, -1))
                for first in self.next[node].values():
                    out.add((first, e + 1, -1))
                    second = self.next[first].get(c)
                    if second is not None:
                        out.add((second, e + 1, self._via(node, first, second)))
        return self._state(self._closed(out))

    def _via(self, node: int, first: int, second: int) -> int:
        """Marks a swap: `second` is reached once the letter that leads to `first` is read."""
        letter = next(c for c, n in self.next[node].items() if n == first)
        key = (letter, second)
        if key not in self._swaps:  # a node of its own with one edge
            self._swaps[key] = len(self.next)
            self.next.append({letter: second})
            self.room.append(self.room[second])
            self.word.append(-1)
            self.stem.append(-1)
        return self._swaps[key]

    def walk(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word codes[start:end] (letter classes): entry * 4 + distance, or -1."""
        out = np.full(len(start), -1, np.int64)
        state = np.full(len(start), self.start, np.int64)
        live, pos = np.arange(len(start)), start.astype(np.int64)
        while len(live):
            over = pos >= end[live]
            stuck = self.sticky[state]
            stop = over | stuck
            out[live[stop]] = self.accept[state[stop]]
            live, pos, state = live[~stop], pos[~stop], state[~stop]
            c = codes[pos]
            new = self.table[state, c]
            missing = np.flatnonzero(new < 0)
            if len(missing):
                for key in np.unique(state[missing] * self.classes + c[missing]):
                    s, k = divmod(int(key), self.classes)
                    target = self._step(s, k)
                    self.table[s, k] = target
                new = self.table[state, c]
            alive = new != self.dead
            live, pos, state = live[alive], pos[alive] + 1, new[alive].astype(np.int64)
        return out

    def near(self, word: str) -> tuple[int, int] | None:
        """(entry, distance) of one lower-case word."""
        other = self.classes - 1
        codes = np.array([self.letters.get(LOOKALIKES.get(c, c), other) for c in word], np.int64)
        got = int(self.walk(codes, np.array([0]), np.array([len(codes)]))[0]) if len(codes) else -1
        return None if got < 0 else divmod(got, 4)


# ---------------------------------------------------------------- words

_LETTER = np.array([chr(c).isalnum() or 0x300 <= c < 0x370 for c in range(1 << 16)])
_LETTER[ord("_")] = False


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(points: np.ndarray) -> np.ndarray:
    """Whether each code point belongs to a word; @ and $ only between two letters."""
    inside = _LETTER[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    sign = (points == 64) | (points == 36)
    if sign.any() and len(points) > 2:
        sign[1:-1] &= inside[:-2] & inside[2:]
        sign[[0, -1]] = False
        inside = inside | sign
    return inside


def words_of(text: str) -> list[str]:
    """The lower-case words that the automaton reads."""
    low = text.lower()
    inside = np.concatenate([[False], _classes(_points(low)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return [low[s:e] for s, e in zip(edge[::2], edge[1::2], strict=True)]


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    clean: frozenset[str] = frozenset()  # words of clean rows within the edits of a form
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None

    def automaton(self) -> Automaton:
        return Automaton(self.words, self.stems)

    @property
    def forms(self) -> list[str]:
        return [*self.words, *(s + "*" for s in self.stems)]


class Scanner:
    """Finds the hits of whole texts; one for each task."""

    def __init__(self, model: Model):
        self.model, self.auto = model, model.automaton()
        letters = {ord(c): k for c, k in self.auto.letters.items()}
        for sign, letter in LOOKALIKES.items():
            letters.setdefault(ord(sign), self.auto.letters.get(letter, self.auto.classes - 1))
        self.top = max(letters, default=0) + 1
        self.code = np.full(self.top + 1, self.auto.classes - 1, np.int64)
        for c, k in letters.items():
            self.code[c] = k

    def hits(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, int, int, float]]]]:
        """For each text its number of words, and (start, end, entry, distance, context weight) of each hit."""
        lows = [_lowered(t) for t in texts]
        whole = "\n".join(lows)
        points = _points(whole)
        inside = np.concatenate([[False], _classes(points), [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        got = self.auto.walk(self.code[np.minimum(points, self.top)], start, end)
        first = np.cumsum([0] + [len(x) + 1 for x in lows])
        doc = np.searchsorted(first, start, "right") - 1
        out: list[tuple[int, list]] = [(int(n), []) for n in np.bincount(doc, minlength=len(texts))]
        at = [int(k) for k in np.flatnonzero(got >= 0) if not (got[k] & 3 and whole[start[k] : end[k]] in self.model.clean)]
        for i, k in enumerate(at):
            d = int(doc[k])
            near = any(0 <= j < len(at) and doc[at[j]] == d and abs(at[j] - k) <= NEAR for j in (i - 1, i + 1))
            s, e = int(start[k] - first[d]), int(end[k] - first[d])
            out[d][1].append((s, e, int(got[k]) >> 2, int(got[k]) & 3, context(lows[d], s, e, near)))
        return out


def _lowered(text: str) -> str:
    """Lower case of the same length: the few letters that grow when lowered stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def context(low: str, start: int, end: int, near: bool = False) -> float:
    """How much a hit counts: quotation and reporting lower it, address and company raise it."""
    before, after = low[max(0, start - WINDOW_CHARS) : start], low[end : end + WINDOW_CHARS]
    weight = 1.0
    if _quoted(before.rpartition("\n")[2], after.partition("\n")[0]):
        weight *= 0.2
    words = [w.strip(".,;:!?()\"'“”«»„") for w in [*before.split()[-NEAR:], *after.split()[:NEAR]]]
    if any(w in REPORTING for w in words):
        weight *= 0.5
    elif weight == 1 and (near or any(w in ADDRESS for w in words)):
        weight *= 1.25
    return weight


def _quoted(before: str, after: str) -> bool:
    """Between quotation marks on one line: a mark that opens behind, one that closes ahead."""
    if '"' in after:
        left = before.rpartition('"')
        if left[1] and not left[2][:1].isspace() and (not left[0] or not left[0][-1].isalnum()):
            return True
    for a, b in zip(_OPEN, _CLOSE, strict=True):
        if before.rfind(a) > before.rfind(b) if a != b else a in before:
            if b in after:
                return True
    return False


FEATURES = 6


def _features(n: int, hits: list[tuple[int, int, int, int, float]], weight: list[float]) -> list[float]:
    mass = sum(weight[e] * c * 0.7**d for _, _, e, d, c in hits)
    k = max(len(hits), 1)
    return [
        math.log1p(100 * mass / max(n, 1)),
        math.log1p(mass),
        math.log1p(len({e for _, _, e, _, _ in hits})),
        sum(d > 0 for _, _, _, d, _ in hits) / k,
        sum(c < 1 for *_, c in hits) / k,
        math.log1p(1000 * len(hits) / max(n, 1)),
    ]


# ---------------------------------------------------------------- learning


def _copies(rows: DataFrame) -> list[int]:
    """Hashes of the chosen rows that are near copies of another with its label: one of each group
    teaches, so that a much copied text does not make all its words tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lo, hi, b, off in blocks(batch.column("text")):
                start, end, doc = word_runs(b, off)
                h = slice_hashes(b, start, end)
                n = hi - lo
                own = scramble(slice_hashes(b, off[:-1], off[1:]))
                least = np.tile(own, (3, 1))
                if len(h) >= SHINGLE:
                    x = np.zeros(len(h) - SHINGLE + 1, np.uint64)
                    for k in range(SHINGLE):
                        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
                    first, whole = doc[: len(x)], doc[: len(x)] == doc[SHINGLE - 1 :]
                    at, have = np.unique(first[whole], return_index=True)
                    for k in range(3):
                        if len(at):
                            least[k, at] = np.minimum.reduceat(scramble(x[whole] ^ np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)), have)
                assert len(own) == n
                keys.append(least)
            k = np.concatenate(keys, axis=1) if keys else np.zeros((3, 0), np.uint64)
            yield pa.record_batch([batch.column("h"), batch.column("toxic"), *(pa.array(x.view(np.int64)) for x in k)], names=["h", "toxic", "k0", "k1", "k2"])

    got = rows.select("h", "toxic", "text").mapInArrow(trimmed(run), "h long, toxic int, k0 long, k1 long, k2 long").collect()  # at most train_rows short rows
    seen: set[tuple[int, int, int]] = set()
    out = []
    for r in sorted(got):
        mine = {(k, r["toxic"], r[f"k{k}"]) for k in range(3)}
        if mine & seen:
            out.append(r["h"])
        seen |= mine
    return out


def _forms(text: str) -> tuple[int, Counter]:
    words = [w for w in words_of(text) if len(w) > 2 and not w[0].isdigit()]
    seen: Counter = Counter()
    for w in words:
        seen[w] += 1
        for k in STEM:
            if len(w) > k:
                seen[w[:k] + "*"] += 1
    return len(words), seen


_COUNTS = ["d0", "d1", "n0", "n1", "m0", "m1"]


def _counts(rows: DataFrame) -> DataFrame:
    """By form: rows that hold it, occurrences, and rows that hold it MANY times, each by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[int]] = defaultdict(lambda: [0] * 6)

        def rows_out() -> pa.RecordBatch:
            keys = list(got)
            return pa.record_batch([pa.array(keys, pa.string()), *(pa.array([got[k][j] for k in keys], pa.int64()) for j in range(6))], names=["form", *_COUNTS])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                total, seen = _forms(text)
                got[""][toxic] += 1
                got[""][2 + toxic] += total
                for form, k in seen.items():
                    x = got[form]
                    x[toxic] += 1
                    x[2 + toxic] += k
                    x[4 + toxic] += k >= MANY
                if len(got) > 200_000:
                    yield rows_out()
                    got.clear()
        if got:
            yield rows_out()

    summed = rows.mapInArrow(trimmed(run), "form string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("form").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return summed


def _g2(a: float, b: float, na: float, nb: float) -> float:
    """Likelihood ratio of holding a form in a of na toxic and b of nb other rows."""
    total, out = na + nb, 0.0
    for x, n in ((a, na), (b, nb)):
        for seen, share in ((x, (a + b) / total), (n - x, 1 - (a + b) / total)):
            if seen > 0 and share > 0:
                out += 2 * seen * math.log(seen / (n * share))
    return out


def choose(rows: list[tuple[str, int, int, int, int, int, int]], tried: int, lexicon: int = LEXICON) -> tuple[list[str], list[str], list[float]]:
    """Words, stems and weights from the counts of forms ('' has the totals), of which `tried` were looked at."""
    total = next((r for r in rows if r[0] == ""), None)
    if total is None or not total[1] or not total[2]:
        return [], [], []
    _, d0, d1, n0, n1, _, _ = total
    beyond = 2 * math.log(max(tried, 2)) + 2
    most: dict[str, int] = {}  # by stem, the occurrences of its commonest word
    kept = []
    for form, a0, a1, c0, c1, b0, b1 in rows:
        if not form:
            continue
        if not form.endswith("*"):
            for k in STEM:
                if len(form) >= k:
                    most[form[:k]] = max(most.get(form[:k], 0), c1)
        rate = ((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))
        # abuse repeats itself: rows that hold a form often tell more than rows that hold it by chance
        rows_rate = max(((x1 + 0.5) / (d1 + 1)) / ((x0 + 0.5) / (d0 + 1)) for x1, x0 in ((a1, a0), (b1, b0)))
        g = max(_g2(a1, a0, d1, d0), _g2(b1, b0, d1, d0))
        if rate >= RATIO and rows_rate >= RATIO / 2 and g > beyond:
            kept.append((g, form, math.log(rate), c1))
    kept.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    auto: Automaton | None = None
    for _, form, w, c1 in kept:
        if len(words) + len(stems) >= lexicon:
            break
        base = form.rstrip("*")
        if any(base.startswith(s) for s in stems):
            continue
        if form.endswith("*"):
            # not one word's beginning, nor a shorter form of a stem that tells more
            if 2 * most.get(base, 0) < c1 and not any(s.startswith(base) for s in stems):
                stems[base] = w
        elif auto is None or auto.near(form) is None:
            words[form] = w
            auto = Automaton(list(words), [])
    words = {x: w for x, w in words.items() if not any(x.startswith(s) for s in stems)}
    return list(words), list(stems), [*words.values(), *stems.values()]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    rows = scratch.write(labelled(docs, labels, "toxic", train_rows), "rows")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return Model()
    copies = spark.createDataFrame([(h,) for h in _copies(rows)], "h long")
    rows = scratch.write(rows.join(F.broadcast(copies), "h", "left_anti").repartition(4 * spark.sparkContext.defaultParallelism, "h"), "taught")
    counts = scratch.write(_counts(rows), "forms")
    n0, n1 = counts.where("form = ''").select("n0", "n1").first()
    # candidates: forms of three toxic rows at several times the rate elsewhere, out of the bounded rows' forms
    tried = counts.where("d1 >= 3")
    several = tried.where((F.col("form") == "") | ((F.col("n1") + 0.5) / (n1 + 1) >= RATIO * (F.col("n0") + 0.5) / (n0 + 1)))
    model = Model(*choose([tuple(r) for r in several.select("form", *_COUNTS).collect()], tried.count()))
    model.clean = _clean_words(counts, model)
    x, y = _training(rows, model)
    _regress(model, x, y)
    for name in ("rows", "taught", "forms"):
        scratch.drop(name)
    return model


def _clean_words(counts: DataFrame, model: Model) -> frozenset[str]:
    """Words of clean rows that a form would take for its misspelling: they stay allowed."""
    plain = counts.where("form <> '' AND NOT endswith(form, '*') AND d0 > 0 AND n0 + n1 > 0 AND n1 <= 2 * n0").select("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.automaton()
        for batch in batches:
            hit = [w for w in batch.column(0).to_pylist() if (got := auto.near(w)) and got[1]]
            yield pa.record_batch([pa.array(hit, pa.string())], names=["form"])

    if not model.words:
        return frozenset()
    return frozenset(r["form"] for r in plain.mapInArrow(trimmed(run), "form string").collect())


def _training(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model)
        for batch in batches:
            f = [_features(*x, model.weight) for part in _texts(batch.column("text")) for x in scan.hits(part)]
            cols = np.array(f, float).reshape(-1, FEATURES)
            yield pa.record_batch([batch.column("h"), batch.column("toxic"), *(pa.array(cols[:, k]) for k in range(FEATURES))], names=["h", "toxic", *(f"f{k}" for k in range(FEATURES))])

    names = [f"f{k}" for k in range(FEATURES)]
    got = rows.mapInArrow(trimmed(run), "h long, toxic int, " + ", ".join(f"{c} double" for c in names)).collect()  # at most TRAIN_ROWS short rows
    got.sort(key=tuple)
    return np.array([[r[c] for c in names] for r in got], float).reshape(-1, FEATURES), np.array([r["toxic"] for r in got], float)


def _regress(model: Model, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> None:
    """Newton steps on the penalised likelihood."""
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    beta = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.beta = beta


def probability(model: Model, features: np.ndarray) -> np.ndarray:
    if model.beta is None:
        return np.full(len(features), 0.5)
    z = model.beta[0] + ((features - model.mean) / model.scale) @ model.beta[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ---------------------------------------------------------------- scoring


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for lo, hi, _, _ in blocks(column):
        yield [x or "" for x in column.slice(lo, hi - lo).to_pylist()]


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns and score (0 to 1) of every row."""
    carry = ["doc_id"] if carry is None else carry
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text_"))
    out = docs.select(*carry).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model)
        for batch in batches:
            f = [_features(*x, model.weight) for part in _texts(batch.column("text_")) for x in scan.hits(part)]
            p = probability(model, np.array(f, float).reshape(-1, FEATURES))
            yield pa.record_batch([*(batch.column(k) for k in range(len(carry))), pa.array(p)], names=out.names)

    return rows.mapInArrow(trimmed(run), out)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Each hit: doc_id, start and end (code points), its text, the form, the edits and the context weight."""
    forms = model.forms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model)
        for batch in batches:
            ids, rows = iter(batch.column("doc_id").cast(pa.int64()).to_pylist()), []
            for part in _texts(batch.column("text")):
                for t, (_, hits) in zip(part, scan.hits(part), strict=True):
                    i = next(ids)
                    rows += [(i, s, e, t[s:e], forms[k], d, c) for s, e, k, d, c in hits]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "end", "found", "form", "edits", "weight"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, start long, end long, found string, form string, edits int, weight double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
