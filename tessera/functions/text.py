"""Text functions as column expressions (JVM side). What Spark has no functions for, NFKC and
case folding beyond Latin and the reading of HTML, are Arrow functions; texts of plain
Latin letters pass them by as nulls.

Defined results: null gives null; an empty text is empty, has no tokens and no n-grams, and is
one approximate token; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]+"

# Tags whose content is skipped, tags that break lines, query patterns.
SKIPPED_TAGS = ["script", "style", "noscript", "template"]
BLOCK_TAGS = ["p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article"]
QUOTED_PATTERN = r'"[^"]{2,}"'
SYMBOL_PATTERN = r"[A-Za-z_]\w*(::|->|\.)[A-Za-z_]\w*\(?|\b[0-9a-f]{8}-[0-9a-f]{4}-|\b[A-Z]{2,}[-_]?\d{2,}\b|\b\w*_\w+\b|\b\d{5,}\b"


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def _fold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s.casefold())


#: Any character but ASCII and the Latin ones that NFKC leaves alone and that fold as lower case (and sharp s as ss);
#: ASCII is passed by one test, as the ranges are tried one by one.
_OTHER = "(?=[^\\x00-\\x7F])[^\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff]"


@F.pandas_udf(StringType())
def _nfkc_fold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def _odd(x: Column) -> Column:
    """Texts with such characters, the others as null; plain ASCII is known by its length in bytes."""
    return F.when((F.octet_length(x) > F.length(x)) & x.rlike(_OTHER), x)


def nfkc(x: Column) -> Column:
    """The compatible composed form."""
    return F.coalesce(_nfkc(_odd(x)), x)


def folded(x: Column) -> Column:
    """The case-folded compatible form, by one function call."""
    return F.coalesce(_nfkc_fold(_odd(x)), F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))


def casefold(x: Column) -> Column:
    """Full case folding alone."""
    return F.coalesce(_fold(_odd(x)), F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))


def _tidy(x: Column) -> Column:
    x = F.regexp_replace(x, r"[\x00-\x08\x0B-\x1F]", "")
    x = F.regexp_replace(x, "[\u0085\u2028\u2029]", "\n")
    x = F.regexp_replace(x, r" [ \t]+|\t[ \t]*", " ")  # single blanks are left as they are
    x = F.regexp_replace(x, r" \n ?|\n ", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", ""))


def clean(x: Column) -> Column:
    """NFKC; control characters go, blanks collapse, lines are stripped, blank lines are two at most."""
    return _tidy(nfkc(x))


def content_hash(x: Column) -> Column:
    """Of the clean text, case-folded; folding first is the same, as it leaves blanks and controls alone."""
    return F.sha2(_tidy(folded(x)), 256)


_CONTROLS = bytes([*range(9), *range(11, 32)])


def content_digest(text: str) -> str:
    """`content_hash` of one text, for functions that need all of a text where it is."""
    x = text.encode().lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold().encode()
    x = x.translate(None, _CONTROLS)
    for line_end in ("\u0085", "\u2028", "\u2029"):
        x = x.replace(line_end.encode(), b"\n")
    x = re.sub(rb"  +", b" ", x.replace(b"\t", b" ")).replace(b" \n", b"\n").replace(b"\n ", b"\n")
    return hashlib.sha256(re.sub(rb"\n{3,}", b"\n\n", x).strip(b" \n")).hexdigest()


def quality_reason(x: Column, min_chars: int = 40, max_symbol_ratio: float = 0.5) -> Column:
    alnum = F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(x) < min_chars, "too_short").when(alnum / F.greatest(F.length(x), F.lit(1)) < 1 - max_symbol_ratio, "mostly_symbols").otherwise("ok")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def approx_tokens(x: Column) -> Column:
    """About 1.3 ids a word, and one."""
    return (F.floor(F.size(words(x)) * F.lit(1.3)) + 1).cast("long")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(folded(x), F.lit(TOKEN), F.lit(0))


#: Bytes of ASCII as words: capitals small, all that is in no word a blank.
_ASCII = bytes(c if chr(c).isalnum() or c == 0x5F else 0x20 for c in (ord(chr(i).lower()) for i in range(128))) + b" " * 128
_WORD = re.compile(r"\w+")  # letters, numbers of any kind and the underscore, as in TOKEN


def token_list(text: str) -> list[bytes]:
    """`tokens` of one text, as UTF-8, for functions that need all words of a text where it is."""
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    return [t.encode() for t in _WORD.findall(unicodedata.normalize("NFKC", text).casefold())]


def normalize(x: Column) -> Column:
    return F.trim(F.regexp_replace(folded(x), r"\s+", " "))


def format_query(x: Column, tenant: Column | None = None) -> Column:
    return F.concat(_tenant(tenant) if tenant is not None else F.lit(""), F.lit("query: "), normalize(x))


def format_document(x: Column, tenant: Column | None = None) -> Column:
    return F.concat(_tenant(tenant) if tenant is not None else F.lit(""), F.lit("document: "), normalize(x))


def _tenant(tenant: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tenant: "), tenant, F.lit(" | ")), F.lit(""))


def classify(x: Column) -> Column:
    """Queries that quote or name a symbol go to the lexical index."""
    return F.when(x.rlike(QUOTED_PATTERN) | x.rlike(SYMBOL_PATTERN), "lexical").otherwise("semantic")


def ngrams(tokens_: Column, n: int) -> Column:
    """Distinct n-grams of a token array; none when it is shorter."""
    return F.when(F.size(tokens_) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens_) - n + 1), lambda i: F.array_join(F.slice(tokens_, i, F.lit(n)), " "))))


def jaccard(a: Column, b: Column, if_empty: Column) -> Column:
    """Similarity of two distinct arrays; `if_empty` where either has nothing."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), if_empty).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


#: Comments, tags (with quoted values that may hold ">"), declarations.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[!?][^>]*>", re.DOTALL)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style")}


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _entity(found: re.Match) -> str:
    """What an entity stands for; names that are none stay, as do those cut off before their semicolon."""
    known = found[0][1] == "#" or found[0][1:] in html.entities.html5
    return html.unescape(found[0]) if known else found[0]


def _page_text(page: str, read: Callable[[str], str] = html.unescape) -> str:
    """Text outside of skipped elements; tags that break lines are line feeds; entities are read."""
    out, at, hidden = [], 0, 0
    while at < len(page):
        mark = _MARKUP.search(page, at)
        stop = mark.start() if mark else len(page)
        if stop > at and not hidden:
            out.append(read(page[at:stop]))
        if not mark:
            break
        at, tag = mark.end(), (mark["tag"] or "").lower()
        if tag in BLOCK_TAGS:
            out.append("\n")
        elif tag in SKIPPED_TAGS:
            hidden = max(0, hidden + (-1 if mark["end"] else 1))
            if not mark["end"] and tag in _RAW:  # its content is no markup
                close = _RAW[tag].search(page, at)
                at = close.start() if close else len(page)
    return "".join(out)


@F.pandas_udf(StringType())
def html_to_text(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else _page_text(s))


@F.pandas_udf(StringType())
def html_to_text_closed(x: pd.Series) -> pd.Series:
    """The same, but entities without their semicolon stay as they are."""
    return x.map(lambda s: None if s is None else _page_text(s, lambda t: _ENTITY.sub(_entity, t)))


def pieces(x: Column, max_tokens: int) -> Column:
    """Paragraphs, or their sentences where too long, or runs of words where still too long."""
    step = max(1, int(max_tokens / 1.3))

    def runs(s: Column) -> Column:
        w = words(s)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / step).cast("int")), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(step)), " "))

    def of_sentence(s: Column) -> Column:
        return F.when(approx_tokens(s) <= max_tokens, F.array(s)).otherwise(runs(s))

    def of_paragraph(p: Column) -> Column:
        return F.when(approx_tokens(p) <= max_tokens, F.array(p)).otherwise(F.flatten(F.transform(F.split(p, r"(?<=[.!?])\s+"), of_sentence)))

    paragraphs = F.filter(F.split(x, "\n\n"), lambda p: F.trim(p) != "")
    return F.flatten(F.transform(paragraphs, of_paragraph))


def chunk(x: Column, max_tokens: int = 512) -> Column:
    """Units of at most `max_tokens`: pieces joined greedily, in order."""
    # the state keeps word counts, so that no text is split again
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        n = F.size(words(p))
        fits = F.floor((s["n"] + n) * F.lit(1.3)) + 1 <= max_tokens
        return (
            F.when(s["cur"] == "", F.struct(s["done"].alias("done"), p.alias("cur"), n.alias("n")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit("\n\n"), p).alias("cur"), (s["n"] + n).alias("n")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), p.alias("cur"), n.alias("n")))
        )

    return F.aggregate(pieces(x, max_tokens), zero, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
