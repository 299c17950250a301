"""Packing token sequences into fixed windows by multiway differencing.

A document becomes its token ids and an end id.  Every full window it can fill is a
sequence of its own; what is left is cut into pieces of at most ``piece`` tokens and
dealt over windows by Karmarkar-Karp differencing: partial partitions with the
largest spread are merged with their imbalances opposed until one is left, whose
windows are nearly equal.  If a window then exceeds the capacity, the number of
windows rises and the differencing starts again.

Scale.  Texts are read once; ids never leave the task that made them, only lengths
and checksums do.  Pieces are dealt at random over shards of a bounded number of
pieces, each packed in one task's memory; a shard wastes less than one window more
than an unsharded packing would, so padding does not grow with the input.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 4096
END_ID = 2
PIECE = 1024
SHARD_PIECES = 2000
#: Distinct words, and pieces between white space, whose ids a Python worker keeps, and the bytes of the longest one kept;
#: beyond the number it starts anew.  A worker outlives its stage, so what it keeps is missing in all that follow.
CACHED_WORDS, CACHED_PIECES, CACHED_BYTES = 200_000, 100_000, 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


#: The tokenizer's pattern for words, over the characters of the quick way.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-zß-öø-ÿœ0-9]+")
#: Characters whose case, class or composition the quick way leaves to the
#: tokenizer itself, and what may be the name of a special token.
UNSAFE = re.compile(r"[^\x21-\x7eÀ-ÖØ-öø-ÿŒœ]|<\|")


# How a tokenizer prepares texts if the quick way gives its ids.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Words(dict):
    """Word of the tokenizer's pattern -> its ids, little-endian unsigned 32-bit."""

    def __init__(self, tokenizer, most: int) -> None:
        super().__init__()
        self.tokenize, self.most = tokenizer.model.tokenize, most
        # Byte-level vocabularies write a byte as a printable character: itself, or
        # the next one from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in plain)
        self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        # The quick way's ASCII characters all show as themselves.
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        ids = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        if len(shown) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder(dict):
    """Token ids of whole texts, by looking up the pieces between ASCII white space.

    The tokenizer lower-cases, splits into words that never cross white space, and
    encodes each word for itself, so ids can be kept by piece and by word.  A piece
    with a character outside the quick way goes to the tokenizer whole, and so does every
    whole text if the tokenizer splits texts in another way than this.
    """

    def __init__(self, path: str, most_words: int = CACHED_WORDS, most: int = CACHED_PIECES) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.words = Words(self.tokenizer, most_words)
        parts = json.loads(self.tokenizer.to_str())
        self.quick = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER and parts["post_processor"] is None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        data = text.encode("utf-8", "replace")
        if not self.quick:
            return array("I", self.tokenizer.encode(data.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, data.split()))

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        if piece.isalpha():  # ASCII letters alone are one word
            ids = self.words[text.lower()]
        elif UNSAFE.search(text):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            ids = b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        if len(piece) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int = CAPACITY, piece: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc) of a document's pieces: full windows, then the rest."""
    n = len(ids) // 4
    start, view = 0, memoryview(ids)
    while start < n:
        length = capacity if n - start >= capacity else min(piece, n - start)
        yield start, length, zlib.crc32(view[4 * start : 4 * (start + length)])
        start += length


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size, by k-way Karmarkar-Karp differencing.

    A partial partition holds k sums, ascending and less their least, and for each the
    root of a binary tree of the items in it.  The heap gives the two with the largest
    spread; the larger sums of one meet the smaller sums of the other.
    """
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right, free = [-1] * (2 * n), [-1] * (2 * n), n
    # Only windows with items are kept; the others all have sum zero.
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        # Both ascend; the empty windows of one take the largest sums of the other.
        both = len(a) + len(b) - k
        if both <= 0:
            sums, roots = np.concatenate([a, b]), np.concatenate([ra, rb])
        else:
            sums = np.concatenate([a[:both] + b[:both][::-1], a[both:], b[both:]])
            joined = np.empty(both, np.int64)
            for j, (x, y) in enumerate(zip(ra[:both].tolist(), rb[:both][::-1].tolist(), strict=True)):
                left[free], right[free], joined[j] = x, y, free
                free += 1
            roots = np.concatenate([joined, ra[both:], rb[both:]])
        by = np.argsort(sums, kind="stable")
        sums, roots = sums[by], roots[by]
        if len(sums) == k:
            sums = sums - sums[0]
        heapq.heappush(heap, (-int(sums[-1]), order, sums, roots))
        order += 1
    out = np.zeros(n, np.int64)
    for window, root in enumerate(heap[0][3].tolist()):
        stack = [root]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = window
            else:
                stack += [left[x], right[x]]
    return out


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows of pieces, none above the capacity, as few as differencing finds."""
    window = np.zeros(len(sizes), np.int64)
    full = sizes >= capacity
    window[full] = np.arange(full.sum())
    rest = sizes[~full].astype(np.int64)
    if len(rest):
        k = max(1, math.ceil(int(rest.sum()) / capacity))
        while True:
            found = differencing(rest, k)
            sums = np.bincount(found, rest, minlength=k)
            if sums.max() <= capacity:
                break
            k += max(1, int(np.maximum(sums - capacity, 0).sum() // capacity))
        window[~full] = found + full.sum()
    return window


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, piece: int = PIECE,
) -> DataFrame:
    """One row per piece: id, start, length, checksum of its ids, tokens of the document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids, starts, lengths, crcs, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = encode(text.as_py() or "") + end
                for start, length, crc in cut(tokens, capacity, piece):
                    ids.append(doc)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(crc)
                    totals.append(len(tokens) // 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs, totals)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, piece: int = PIECE, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone.  Every id of a document is in exactly
    one piece, every piece in exactly one sequence of at most ``capacity`` ids, and the
    pieces of a sequence follow one another from offset 0 without a gap.  Rows with the
    same id, or none, are packed each.  An empty table gives an empty result; columns other than
    the two named are not read.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, piece), "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_pieces))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("shard").sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window = pack_sizes(rows["length"].to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(window + (key[0].as_py() << 32)))
        rows = rows.sort_by([("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        sequence, length = rows["sequence_id"].to_numpy(), rows["length"].to_numpy()
        upto = np.cumsum(length) - length
        heads = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
        return rows.append_column("offset", pa.array(upto - np.repeat(upto[heads], np.diff(np.append(heads, len(sequence))))))

    # Dealt by place in the written table: rows that repeat an id spread like others.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(place, PACKED)
