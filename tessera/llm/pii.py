"""Personal data by a semi-Markov conditional random field over whole spans.

The base finders (email, ip, card, phone) are fixed patterns and their spans stay. The
field adds spans the patterns miss: it scores candidate segments of up to ``LONGEST``
tokens by features of the whole span (its shape, digits, checks such as Luhn or octet
ranges, the words before it), and bounded-entity dynamic programming chooses the
boundaries and types of a zone jointly, a segment's type also by the one before it. Zones are the tokens around digits, ``@``,
key words and addresses said in words ("at ... dot"; a bare "at" before a domain written
with points is prose), cut where three plain words follow each other and nowhere else, so
clean prose costs nothing; the program is linear in a zone's length and holds no segments.
The weights are fitted by gradient ascent on the conditional likelihood of seeded
sentences made from ``TEMPLATES``.

Types of the field: the base kinds and ``secret`` (keys and tokens). A span that
overlaps a base span is dropped.

Defined results: a null text is empty and has no span; offsets are code points, ends
exclusive; every row is searched by itself, so repeated rows repeat; an empty table
gives no row; other columns are ignored (``mask_documents`` keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed
from .words import blocks

KINDS = ["email", "ip", "card", "phone"]
TYPES = ["plain", *KINDS, "secret"]
LONGEST = 14

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# digits before a start would have been part of it, so the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind, then start. Linear in the text's length."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGITS.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ------------------------------------------------------------------ the field

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_]+|[^\sA-Za-z0-9]", re.ASCII)
_KEY_WORDS = {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "bearer", "mail", "email", "phone", "tel", "call", "card", "ip"}
_SHAPES: list[tuple[str, re.Pattern]] = [
    ("mail", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("mail said", re.compile(r"[A-Za-z0-9._-]+ ?[\[(]?at[\])]? ?[A-Za-z0-9-]+( ?[\[(]?(dot|\.)[\])]? ?[A-Za-z0-9-]+)+")),
    ("four numbers", re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")),
    ("plus digits", re.compile(r"\+[0-9][ ().0-9-]*[0-9]")),
    ("area digits", re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}")),
    ("three groups", re.compile(r"(1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("digit groups", re.compile(r"[0-9]{4}([ -]?[0-9]{4}){3}")),
    ("hex", re.compile(r"[0-9a-f]{24,}")),
    ("mixed", re.compile(r"(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}")),
    ("letters", re.compile(r"[^\W0-9_]+")),
    ("digits", re.compile(r"[0-9]+")),
    ("one mark", re.compile(r"[^\w\s]")),
]
_FEATURES = [*(n for n, _ in _SHAPES), "luhn", "octets", "no luhn", "d0", "d1-3", "d4-7", "d8-15", "d16-19", "d20+", "after secret word", "after mark", "before mark", "one token", "2-4 tokens", "5+ tokens", "always"]
_AT = {n: k for k, n in enumerate(_FEATURES)}


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int, words: list[str]) -> list[int]:
    span = text[tokens[i][0] : tokens[j][1]]
    out = [k for k, (_, p) in enumerate(_SHAPES) if p.fullmatch(span)]
    digits = "".join(_DIGITS.findall(span))
    n = len(digits)
    out.append(_AT["d0" if n == 0 else "d1-3" if n < 4 else "d4-7" if n < 8 else "d8-15" if n < 16 else "d16-19" if n < 20 else "d20+"])
    if 16 <= n <= 19:
        out.append(_AT["luhn" if luhn(digits) else "no luhn"])
    if span.count(".") == 3 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in span.split(".")):
        out.append(_AT["octets"])
    if any(w in _KEY_WORDS for w in words[max(0, i - 4) : i]):
        out.append(_AT["after secret word"])
    if i and not words[i - 1].isalnum() and tokens[i - 1][1] == tokens[i][0]:
        out.append(_AT["after mark"])
    if j + 1 < len(words) and not words[j + 1].isalnum() and tokens[j + 1][0] == tokens[j][1]:
        out.append(_AT["before mark"])
    size = j - i + 1
    out.append(_AT["one token" if size == 1 else "2-4 tokens" if size < 5 else "5+ tokens"])
    out.append(_AT["always"])
    return out


def _segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Features of each candidate segment (first, last token), by first, then last."""
    words = [text[a:b].lower() for a, b in tokens]
    for i in range(len(tokens)):
        yield i, i, _features(text, tokens, i, i, words)
        for j in range(i + 1, min(len(tokens), i + LONGEST)):
            if tokens[j][0] - tokens[j - 1][1] > 1:
                break
            first, last = words[i][0], words[j][-1]
            if (first.isalnum() or first in "+(") and last.isalnum():
                yield i, j, _features(text, tokens, i, j, words)


def _score(i: int, j: int, features: list[int], weights: np.ndarray) -> np.ndarray:
    s = weights[features].sum(axis=0)
    if j > i:
        s[0] = -1e9  # plain segments are single tokens
    return s


class Field:
    """Weights of segment features (feature, type) and of a segment's type after another's."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(_FEATURES), len(TYPES)))
        self.follows = np.zeros((len(TYPES), len(TYPES)))


def decode(n: int, segments: Iterable[tuple[int, int, list[int]]], field: Field) -> list[tuple[int, int, int]]:
    """The best segmentation: (first, last token, type) of the segments that are not plain.

    Segments come by first token, so what ends before one is settled, and none is held."""
    best = np.full((n + 1, len(TYPES)), -np.inf)
    start = np.zeros((n + 1, len(TYPES)), np.int64)
    before = np.zeros((n + 1, len(TYPES)), np.int64)  # the type that a segment from here follows
    reach, at = np.zeros(len(TYPES)), 0
    for i, j, f in segments:
        if i != at:
            at = i
            ways = best[i][:, None] + field.follows
            before[i] = ways.argmax(axis=0)
            reach = ways.max(axis=0)
        s = reach + _score(i, j, f, field.weights)
        better = s > best[j + 1]
        best[j + 1][better] = s[better]
        start[j + 1][better] = i
    if not n:
        return []
    out, at, k = [], n, int(best[n].argmax())
    while at > 0:
        i = int(start[at, k])
        if k:
            out.append((i, at - 1, k))
        at, k = i, int(before[i, k])
    return out[::-1]


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _gradient(n: int, segments: dict[tuple[int, int], list[int]], gold: dict[tuple[int, int], int], field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected counts of features and of successions (forward and backward sums
    over segmentations)."""
    scores = {(i, j): _score(i, j, f, field.weights) for (i, j), f in segments.items()}
    ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j in scores:
        ends[j].append((i, j))
        begins[i].append((i, j))
    types = len(TYPES)
    into = np.zeros((n + 1, types))  # sums of all that ends before a segment of a type from here
    fore, away, aft = np.zeros((n + 1, types)), np.zeros((n + 1, types)), np.zeros((n + 1, types))
    for j in range(n):
        fore[j + 1] = _total(np.array([into[i] + scores[i, j] for i, _ in ends[j]]), 0)
        into[j + 1] = _total(fore[j + 1][:, None] + field.follows, 0)
    for i in range(n - 1, -1, -1):
        away[i] = _total(np.array([scores[i, j] + aft[j + 1] for _, j in begins[i]]), 0)
        aft[i] = _total(field.follows + away[i][None, :], 1)
    z = _total(fore[n], 0)
    out, follow = np.zeros_like(field.weights), np.zeros_like(field.follows)
    for (i, j), f in segments.items():
        p = -np.exp(into[i] + scores[i, j] + aft[j + 1] - z)
        if (i, j) in gold:
            p[gold[i, j]] += 1
        for k in f:
            out[k] += p
    for i in range(1, n):
        follow -= np.exp(fore[i][:, None] + field.follows + away[i][None, :] - z)
    row = [k for _, k in sorted(gold.items())]
    for x, y in zip(row, row[1:], strict=False):
        follow[x, y] += 1
    return out, follow


#: Sentences the field learns from: {kind} is a sampled value ({said} an email), w a plain word.
TEMPLATES = [
    "w w w {email} w w", "w {email} w. w", "w w {ip} w w", "w | {ip} | w", "w. {phone} w w", "w {phone}, w", "w w {card} w. w", "w {card} w w",
    'w token = "{secret}" w w', "w w key: {secret} w", "password={secret} w w", "w w w w w. w", "w {number} w, w", "w {long} w w", "w w {year} w ({small}) w", "w {version} w w", "w {long}. w", "w w {half} w", "w: {small}, {small} w {year}",
    "w*** w%%% w### {ip} w&&& w$$$ w***", 'w### w*** token = "{secret}"### w&&& w%%%', "w%%% w$$$ {phone}%%% w### w", "w&&& w### {number} w*** w%%% w", "W!! W!! {card}!! w!! w!!", "w | w at w | {small} | w dot w | w",
    "w w {said} w w", "w {said}, w w",
    "w w: {email}; w w", "<{email}> w w", "w ({email}) w", "w {ip}:{small} w", "w w [{ip}] w", "w w={ip}, w", "tel {phone} w w", "w w: {phone}. w", "w {phone} / {phone} w",
    "w w w: {card}, w {small}/{small}", "api_key={secret}; w", "w secret {secret} w w", "Bearer {secret}\\nw w", "w w: '{secret}', w", "w w token w w", "w key w {small} w w",
    "w w {date} w w", "w w {time} w", "w {price} w, {price} w", "w w {date} {time} w", "w {small}-{small} w", "w ({year}) {small}: {small}-{small}", "w w w{small} w", "w {long} w {date}", "w {word40} w w", "w w/w/w-w_w w", "#{number} w w",
]


def _value(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(r.randint(2, 9)))
    if kind == "email":
        return r.choice([f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com", f"{word()}@{word()}.org", f"{word()} at {word()} dot com"])
    if kind == "said":  # longer ways to say an address
        return r.choice([f"{word()} (at) {word()} (dot) org", f"{word()}.{word()} [at] {word()}.{word()}.com", f"{word()}.{word()} at {word()} dot {word()} dot co dot uk", f"{word()} at {word()}-{word()} dot com"])
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "phone":
        return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}"])
    if kind == "card":
        x = d(15)
        x += next(c for c in "0123456789" if luhn(x + c))
        return r.choice([x, " ".join(x[k : k + 4] for k in range(0, 16, 4)), "-".join(x[k : k + 4] for k in range(0, 16, 4))])
    if kind == "secret":
        any_ = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 2)) + d(1) + r.choice("kQz")
        return r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), any_(r.randint(24, 48)), f"{r.choice(['pk', 'tok', 'live'])}_{any_(28)}"])
    if kind == "long":  # looks like a card but fails its check
        x = d(16)
        return x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)
    return {"number": d(r.randint(5, 9)), "year": str(r.randint(1900, 2030)), "small": d(2), "version": f"{d(1)}.{d(1)}.{d(2)}", "date": f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", "time": f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", "price": f"{r.randint(1, 99)},{d(3)}.{d(2)}", "word40": "".join(r.choice("aeinorstlu") for _ in range(26)), "half": f"{d(2)}.{d(2)}"}[kind]


@lru_cache(maxsize=1)
def model(seed: int = 0, sentences: int = 800, epochs: int = 10, rate: float = 0.3) -> Field:
    """The field, fitted once per process."""
    r = random.Random(seed)
    data = []
    for k in range(sentences):
        text, gold_spans = "", []
        for piece in re.split(r"(\{\w+\})", TEMPLATES[k % len(TEMPLATES)]):
            if piece.startswith("{"):
                value = _value(piece[1:-1], r)
                kind = {"said": "email"}.get(piece[1:-1], piece[1:-1])
                if kind in TYPES:
                    gold_spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += re.sub(r"\bw\b", lambda _: "".join(r.choice("aeinorstlhdu") for _ in range(r.randint(1, 9))), piece)
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        gold = {(first[a], last[b]): TYPES.index(kind) for kind, a, b in gold_spans}
        inside = {t for i, j in gold for t in range(i, j + 1)}
        gold |= {(t, t): 0 for t in range(len(tokens)) if t not in inside}
        data.append((len(tokens), {(i, j): f for i, j, f in _segments(text, tokens)}, gold))
    field = Field()
    held = [(field.weights, np.full(field.weights.shape, 1e-6)), (field.follows, np.full(field.follows.shape, 1e-6))]
    for _ in range(epochs):
        r.shuffle(data)
        for n, segments, gold in data:
            for (w, seen), g in zip(held, _gradient(n, segments, gold, field), strict=True):
                g = g - 1e-4 * w
                seen += g * g
                w += rate * g / np.sqrt(seen)
    return field


#: The rest of a word and three more; a run without blanks counts as words of 400 characters.
_ON = re.compile(r"\S{0,400}(?:\s{0,400}\S{1,400}){0,3}")
_REST = re.compile(r"\S{0,400}")
_LABEL = r"[A-Za-z0-9-]{1,63}+"
#: Digits, @, key words as tokens, and addresses said: "at", labels, "dot" and a label; with "at" in brackets a point does for "dot".
_TRIGGER = re.compile(
    rf"[0-9@]|(?<![A-Za-z0-9])(?:(?:{'|'.join(sorted(_KEY_WORDS))})(?![A-Za-z0-9])"
    rf"|at[\])]? ?{_LABEL}(?:\.{_LABEL}){{0,9}}+(?: ?[\[(]?dot(?![A-Za-z0-9])[\])]? ?{_LABEL}){{1,9}}+"
    rf"|(?<=[\[(])at[\])] ?{_LABEL} ?\.{_LABEL})",
    re.IGNORECASE,
)
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers: back over two words, on until three words in a row hold no
    trigger. Stretches that meet are one zone, and no bound splits a token."""
    start, end, word = 0, -1, 0  # the zone, and the end of its last trigger's word
    for m in _TRIGGER.finditer(text):
        if m.end() <= word:
            continue
        if m.start() >= end:
            lo = m.start()
            for _ in range(3):  # to a blank, or over 40 characters without one
                back = max(0, lo - 40)
                lo = max(text.rfind(" ", back, lo), text.rfind("\n", back, lo), back)
            while lo > max(0, end) and text[lo - 1] in _LETTERS and text[lo] in _LETTERS:
                lo -= 1
            if lo > end:
                if end >= 0:
                    yield start, end
                start = lo
        word, hi = _REST.match(text, m.end()).end(), _ON.match(text, m.end()).end()
        if hi > end:
            while hi < len(text) and text[hi - 1] in _LETTERS and text[hi] in _LETTERS:
                hi += 1
            end = hi
    if end >= 0:
        yield start, end


def field_spans(text: str, field: Field) -> list[Span]:
    """Spans the field finds in a text."""
    out: list[Span] = []
    for lo, hi in _zones(text):
        tokens = [t.span() for t in _TOKEN.finditer(text, lo, hi)]
        found = decode(len(tokens), _segments(text, tokens), field)
        out += [(TYPES[k], tokens[i][0], tokens[j][1]) for i, j, k in found]
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in the order of kinds, then starts."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    extra = []
    for kind, a, b in field_spans(text, field):
        if not any(x < b and a < y for x, y in taken):
            extra.append((kind, a, b))
    order = {k: n for n, k in enumerate(TYPES)}
    return base, sorted(base + extra, key=lambda s: (order[s[0]], s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans with their number and
    that of the secrets among them."""
    field = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi, b, off in blocks(batch.column("text")):
                raw = b.tobytes()
                counts, digests, spans, more = [], [], [], []
                for k in range(hi - lo):
                    base, every = all_spans(raw[off[k] : off[k + 1]].decode(), field)
                    counts.append([sum(s[0] == kind for s in base) for kind in KINDS])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                    more.append([sum(s[0] == "secret" for s in every), len(every)])
                each, extra = list(zip(*counts, strict=True)), list(zip(*more, strict=True))
                yield pa.record_batch([ids.slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in each), pa.array(digests), pa.array(spans), *(pa.array(c, pa.int64()) for c in extra)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def mask_documents(docs: DataFrame) -> DataFrame:
    """The same rows with each span replaced by its kind in brackets, and n_chars to match."""
    field, schema = model(), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    pieces, at = [], 0
                    for kind, a, b in sorted(all_spans(text, field)[1], key=lambda s: (s[1], -s[2])):
                        if b <= at:
                            continue
                        pieces += [text[at:a], f"[{kind}]"] if a >= at else []
                        at = b
                    text = "".join([*pieces, text[at:]])
                texts.append(text)
            cols = []
            for f in schema.fields:
                if f.name == "text":
                    cols.append(pa.array(texts, pa.string()))
                elif f.name == "n_chars":
                    cols.append(pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column("n_chars").type))
                else:
                    cols.append(batch.column(f.name))
            yield pa.record_batch(cols, names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)
