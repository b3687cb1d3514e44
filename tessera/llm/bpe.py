"""Exact bulk tokenisation with the public ``tokenizers`` library.

Both vocabularies split a text into pieces before any merge, and no piece
crosses white space or the border of ASCII letters or digits and punctuation.  A
batch is therefore cut into such chunks with NumPy, the distinct chunks are found by Arrow's hash table, the library encodes
each chunk it has not seen lately, and the id sequence is gathered back.  Texts
holding white space outside ASCII are given to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .hashing import slice_hashes

#: Text bytes handled at once; bounds the memory of a task.
BLOCK_BYTES = 2 << 20
#: Chunks a Python worker remembers; beyond it those not met since the last clearing go.
CACHE_CHUNKS = 1_500_000
#: New chunks held apart until they are merged into the sorted table.
YOUNG_CHUNKS = 1 << 17


_CODE = np.arange(256)
_ALNUM = ((_CODE >= 48) & (_CODE <= 57)) | ((_CODE >= 65) & (_CODE <= 90)) | ((_CODE >= 97) & (_CODE <= 122))
#: ASCII punctuation but the apostrophe, which contractions hold.
_PUNCT = (_CODE > 32) & (_CODE < 127) & ~_ALNUM & (_CODE != 39)
_LOWER = np.where((_CODE >= 65) & (_CODE <= 90), _CODE + 32, _CODE).astype(np.uint8)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _odd_space(b: np.ndarray) -> np.ndarray:
    """Positions where white space outside ASCII begins."""
    if len(b) < 2 or not np.any(b >= 0xC2):
        return np.zeros(0, np.int64)
    a, c = b[:-1], b[1:]
    d = np.append(b[2:], 0)
    hit = (a == 0xC2) & ((c == 0x85) | (c == 0xA0))
    hit |= (a == 0xE1) & (c == 0x9A) & (d == 0x80)
    hit |= (a == 0xE2) & (c == 0x80) & ((d <= 0x8A) | (d == 0xA8) | (d == 0xA9) | (d == 0xAF)) & (d >= 0x80)
    hit |= (a == 0xE2) & (c == 0x81) & (d == 0x9F)
    hit |= (a == 0xE3) & (c == 0x80) & (d == 0x80)
    return np.flatnonzero(hit)


def _chunk_keys(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each byte string, and its first eight bytes with its length mixed in:
    strings of up to seven bytes differ in the second, longer ones would have to agree in both."""
    off = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, chunks.offset * 8)
    raw = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    start, end = off[:-1] - off[0], off[1:] - off[0]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    window = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + 1,), (1,))
    size = end - start
    head = window[start] & _HEAD[np.minimum(size, 8)]
    return slice_hashes(raw, start, end), head ^ (size.astype(np.uint64) << np.uint64(56))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Table:
    """Sorted keys with the first bytes and the place of each chunk."""

    def __init__(self, key: np.ndarray | None = None, head: np.ndarray | None = None, place: np.ndarray | None = None):
        if key is None:
            self.key, self.head, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        else:
            order = np.argsort(key, kind="stable")
            self.key, self.head, self.place = key[order], head[order], place[order]
        self.used = np.zeros(len(self.key), bool)

    def find(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Places, -1 for what is not there."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (self.head[at] == head)
        self.used[at[hit]] = True
        return np.where(hit, self.place[at], -1)

    def merge(self, other: _Table) -> None:
        at = np.searchsorted(self.key, other.key)
        self.key, self.head, self.place = (np.insert(x, at, y) for x, y in ((self.key, other.key), (self.head, other.head), (self.place, other.place)))
        self.used = np.insert(self.used, at, other.used)

    def used_part(self) -> _Table:
        return _Table(self.key[self.used], self.head[self.used], self.place[self.used])


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``
    with control strings read as ordinary text."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.tok.encode_special_tokens = True
        model = json.loads(definition)
        pre = json.dumps(model.get("pre_tokenizer") or {})
        # white space is kept by the byte-level scheme and dropped by the word scheme
        self.keeps_space = '"Removed"' not in pre
        self.lower = '"Lowercase"' in json.dumps(model.get("normalizer") or {})
        self._reset()

    def _reset(self) -> None:
        self.old, self.young = _Table(), _Table()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.n_ids = self.n_chunks = 0

    def _turn(self) -> None:
        """Merges the young table into the old one, and clears that once it is full."""
        if len(self.young.key) < YOUNG_CHUNKS:
            return
        self.old.merge(self.young)
        self.young = _Table()
        if len(self.old.key) < CACHE_CHUNKS:
            return
        kept, ids, start, length = self.old.used_part(), self.ids, self.start, self.length
        self._reset()
        if len(kept.key) <= CACHE_CHUNKS // 2:
            flat, size = _ranges(ids, start[kept.place], length[kept.place]), length[kept.place]
            kept.place = self._append(flat, size) + np.arange(len(size))
            self.old = kept

    def _append(self, flat: np.ndarray, length: np.ndarray) -> int:
        first = self.n_chunks
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while first + len(length) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.length = np.concatenate([self.length, np.zeros(len(self.length), np.int64)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        ends = np.cumsum(length)
        self.start[first : first + len(length)] = self.n_ids + ends - length
        self.length[first : first + len(length)] = length
        self.n_ids += len(flat)
        self.n_chunks += len(length)
        return first

    def _library(self, texts: list[str], alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has. Chunks go in as the words of
        one input (a call's overhead is larger than a word's merges); whole texts alone."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if alone:
            each = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array(sum(each, []), np.uint32), np.array([len(x) for x in each], np.int64)
        flats, lengths = [], []
        for i in range(0, len(texts), 4096):
            part = texts[i : i + 4096]
            e = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            flats.append(np.array(e.ids, np.uint32))
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(flats), np.concatenate(lengths)

    def _index(self, chunks: pa.Array) -> np.ndarray:
        """Place of each distinct chunk in the store."""
        self._turn()
        key, head = _chunk_keys(chunks)
        order = np.argsort(key)  # neighbours in the tables are looked up together
        key, head = key[order], head[order]
        out = self.young.find(key, head)
        rest = np.flatnonzero(out < 0)
        out[rest] = self.old.find(key[rest], head[rest])
        rest = rest[out[rest] < 0]
        if len(rest):
            flat, length = self._library([c.decode() for c in chunks.take(pa.array(order[rest])).to_pylist()])
            out[rest] = self._append(flat, length) + np.arange(len(rest))
            self.young.merge(_Table(key[rest], head[rest], out[rest]))
        back = np.empty(len(out), np.int64)
        back[order] = out
        return back

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of the texts and the number of ids of each, the end id included."""
        flats, counts, lo = [], [], 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
            f, c = self._block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end_id)
            flats.append(f)
            counts.append(c)
            lo = hi
        if not flats:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(flats), np.concatenate(counts)

    def _block(self, b: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(off) - 1
        if self.lower:  # ASCII case is gone anyway; fewer distinct chunks
            b = _LOWER[b]
        bounds, kept = self._bounds(b, off)
        odd = _odd_space(b)
        whole = np.unique(np.searchsorted(off, odd, "right") - 1) if len(odd) else odd
        doc_of = np.searchsorted(off, bounds[:-1], "right") - 1
        if len(whole):
            kept &= ~np.isin(doc_of, whole)
        arr = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(b))])
        pick = np.flatnonzero(kept)
        if len(pick) < len(kept):
            arr = arr.take(pa.array(pick))
        enc = arr.dictionary_encode()
        store = self._index(enc.dictionary) if len(pick) else np.zeros(0, np.int64)
        place = store[enc.indices.to_numpy(zero_copy_only=False)] if len(pick) else store
        start, length, owner = self.start[place], self.length[place], doc_of[pick]
        ids = self.ids
        if len(whole):
            texts = [bytes(b[off[d] : off[d + 1]]).decode() for d in whole]
            flat, size = self._library(texts, alone=True)
            ends = np.cumsum(size)
            start = np.concatenate([start, self.n_ids + ends - size])
            ids = np.concatenate([ids[: self.n_ids], flat])
            length, owner = np.concatenate([length, size]), np.concatenate([owner, whole])
            order = np.argsort(owner, kind="stable")
            start, length, owner = start[order], length[order], owner[order]
        if end_id is not None:  # one more chunk behind each text
            at = np.searchsorted(owner, np.arange(n_docs), "right")
            ids = np.append(ids[: max(self.n_ids, len(ids))], np.uint32(end_id))
            start = np.insert(start, at, len(ids) - 1)
            length = np.insert(length, at, 1)
            owner = np.insert(owner, at, np.arange(n_docs))
        counts = np.bincount(owner, weights=length, minlength=n_docs).astype(np.int64) if len(owner) else np.zeros(n_docs, np.int64)
        return _ranges(ids, start, length), counts

    def _bounds(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk boundaries (first 0, last len) and which chunks hold ids."""
        n = len(b)
        if n == 0:
            return np.zeros(1, np.int64), np.zeros(0, bool)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        begins = np.zeros(n + 1, bool)
        begins[off] = True
        # both schemes part letters or digits from punctuation
        alnum, punct = _ALNUM[b], _PUNCT[b]
        begins[1:n] |= (alnum[1:] & punct[:-1]) | (punct[1:] & alnum[:-1])
        prev = np.empty(n, bool)
        prev[0] = False
        prev[1:] = space[:-1]
        prev[off[:-1][off[:-1] < n]] = False  # nothing stands before a text
        if self.keeps_space:
            # a run of white space before a word: all but its last character, then that
            # character, which a plain space shares with the word
            begins[:n] |= space & ~prev
            nxt = np.empty(n, bool)
            nxt[:-1] = ~space[1:]
            nxt[-1] = False
            last = off[1:][off[1:] > 0] - 1
            nxt[last] = False  # nothing stands behind a text
            begins[:n] |= space & nxt
            after = np.flatnonzero(~space & prev)
            begins[after[b[after - 1] != 32]] = True
            bounds = np.flatnonzero(begins)
            return bounds, np.ones(len(bounds) - 1, bool)
        begins[:n] |= space != prev
        first = off[:-1][off[:-1] < n]
        begins[first] = True
        bounds = np.flatnonzero(begins)
        return bounds, ~space[bounds[:-1]]


def _ranges(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """ids[start:start + length] of all, one after another."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, ids.dtype)
    return ids[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]


_HELD: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer definition (kept between tasks)."""
    key = hash(definition)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(definition)
    return _HELD[key]
