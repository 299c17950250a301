"""Word shingles of texts as arrays of 64-bit hashes, many texts at a time.

Words are runs of characters other than ASCII white space, A-Z in lower case.  A text
of n words has n-4 shingles of five words, one shingle of all its words if it has
fewer than five, and none if it has no word.  Shingles form a multiset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are worked on together, beyond which a text goes alone.
CHUNK = 1 << 19

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, _U))


with np.errstate(over="ignore"):
    _LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], _U)
    _BYTE = mix(_LOWER + _U(0x9E3779B97F4A7C15))
    _IN_WORD = _powers(0x9FB21C651E98DF25, 4096)
    _IN_TEXT = [_powers(b, 1 << 16) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    _IN_SHINGLE = _powers(0xE7037ED1A0B428DB, WORDS)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and each one's text."""
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[firsts] = ~space[firsts]
    at = np.flatnonzero(~space)
    if not len(at):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    heads = np.flatnonzero(starts[at])
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    hashed = mix(np.add.reduceat(_BYTE[data[at]] * _IN_WORD[place & 4095] + (place >> 12).astype(_U), heads))
    return hashed, np.searchsorted(bounds, at[heads], "right") - 1


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As above, with a long single text taken in slices that end in white space."""
    if len(data) <= 2 * CHUNK or len(bounds) > 2:
        return _word_hashes(data, bounds)
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    hashed = np.concatenate(parts)
    return hashed, np.zeros(len(hashed), np.int64)


def text_hashes(words: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 128-bit hash of the words of each text in order, and their number."""
    n = np.bincount(text, minlength=texts)
    full = n > 0
    heads = (np.cumsum(n) - n)[full]
    out = []
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    for powers in _IN_TEXT:
        h = np.zeros(texts, _U)
        if len(words):
            salted = mix(words + (place >> 16).astype(_U) * _U(0x8EBC6AF09C88C6E3))
            h[full] = mix(np.add.reduceat(salted * powers[place & 0xFFFF], heads) + n[full].astype(_U))
        out.append(h)
    return out[0], out[1], n


def shingles(words: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles and each one's text, ordered by text, then hash."""
    n = np.bincount(text, minlength=texts)
    found, of = [], []
    if len(words) >= WORDS:
        whole = text[WORDS - 1 :] == text[: 1 - WORDS]
        total = np.zeros(len(whole), _U)
        for j in range(WORDS):
            total += words[j : len(words) - WORDS + 1 + j] * _IN_SHINGLE[j]
        found.append(mix(total[whole]))
        of.append(text[WORDS - 1 :][whole])
    short = (n > 0) & (n < WORDS)
    if short.any():
        own = short[text]
        w, t = words[own], text[own]
        heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        place = np.arange(len(t)) - np.repeat(heads, np.diff(np.append(heads, len(t))))
        found.append(mix(np.add.reduceat(w * _IN_SHINGLE[place], heads) + _U(1)))
        of.append(t[heads])
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, t = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((h, t))
    return h[order], t[order]


def occurrences(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """0, 1, 2... for equal shingles of a text, which lie next to each other."""
    if not len(h):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
    return np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of a string column's rows; null is empty."""
    texts = texts.fill_null("")
    size = "i8" if pa.types.is_large_string(texts.type) else "i4"
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, size, len(texts) + 1, texts.offset * int(size[1])).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1)
        yield row, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end
