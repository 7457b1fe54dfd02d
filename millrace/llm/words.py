"""Words of Arrow text columns as 64-bit hashes, computed a buffer at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. All of a batch is handled in numpy: no
Python object is made for a word. Two different words share a hash with odds near 2**-58; whatever must be exact beyond
that compares the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit (splitmix64's finaliser)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1B873593) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray, counts: bool = False):
    """The sorted distinct values, by sorting (numpy's own `unique` hashes, which is slower on such arrays); also how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return (x[first], np.diff(first, append=len(x))) if counts else x[first]


_VALUE = mix(np.arange(256, dtype=np.uint64), 7)
_VALUE[65:91] = _VALUE[97:123]
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _MULT), dtype=np.uint64)])
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls are empty) and each text's offsets in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: White space and ASCII punctuation, for comparisons that punctuation should not disturb.
MARKS = _SPACE.copy()
MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def hash_words(texts: pa.Array, prefix: tuple[int, ...] = (), breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, ...]:
    """(hashes, offsets): the hashes of all words, and where each text's words begin and end among them.

    prefix: also return the hashes of the words' first so many characters, a row for each length, as a third array.
    breaks: by byte, whether it stands between words. Works through the column in
    pieces of about 1 MB, cut between words, so that memory does not follow the length of a text.
    """
    raw, offsets = buffers(texts)
    starts, out, heads = [], [], []
    texts_at = np.unique(offsets[:-1])
    at = 0
    while at < len(raw):
        end = min(at + _CHUNK, len(raw))
        while end < len(raw) and not breaks[raw[end]]:  # a piece ends before white space
            rest = np.flatnonzero(breaks[raw[end : end + _CHUNK]])
            end += int(rest[0]) if len(rest) else min(_CHUNK, len(raw) - end)
        piece = raw[at:end]
        word = ~breaks[piece]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inside = texts_at[np.searchsorted(texts_at, at) : np.searchsorted(texts_at, end)] - at
        begins[inside[word[inside]]] = True  # words do not run on from one text to the next
        place = np.flatnonzero(word)
        if len(place):
            first = np.flatnonzero(begins[place])
            length = np.diff(first, append=len(place))
            position = np.arange(len(place)) - np.repeat(first, length)
            value = _VALUE[piece[place]] * powers(int(length.max()))[position]
            out.append(mix(np.add.reduceat(value, first), 1))
            starts.append(place[first] + at)
            if prefix:
                char = np.cumsum((piece[place] & 0xC0) != 0x80)
                char -= np.repeat(char[first], length)
                heads.append(np.stack([mix(np.add.reduceat(np.where(char < p, value, np.uint64(0)), first), 2 + p) for p in prefix]))
        at = end
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(begin, offsets)
    return (hashes, bounds, np.concatenate(heads, axis=1) if heads else np.zeros((len(prefix), 0), np.uint64)) if prefix else (hashes, bounds)


def rows(batch: pa.RecordBatch, text: str = "text", limit: int = 4 << 20):
    """Slices of a batch of about `limit` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
