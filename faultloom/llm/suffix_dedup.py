"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.

Such strings are found in shards.  Content-defined anchors (the least of the hashes of
all ``GRAM``-byte strings in every string of ``length`` bytes) bring equal strings
together: equal strings have the same anchor, so the neighbourhood of every anchor
that occurs twice goes to the shard of its hash.  A shard sorts the suffixes of its
neighbourhoods by induced sorting, computes permuted common prefixes, and finds the
strings that start at two places; neighbourhoods that overlap in one document do not
count as two places.

Scale.  Only anchors occurring twice send bytes, so a shard array never holds the
unique part of the corpus.  Shards have a bounded size whatever the input.  The pieces
around an anchor with more than ``hot`` occurrences do not go to one shard: each is
compared with one of them, its hub; what they have in common is done with, and where
they differ from the hub tells apart groups of pieces, which then go to shards or are
split once more.  Texts travel packed.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shingles import mix
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 200
GRAM = 64
#: Bytes that a shard holds on average, and occurrences that make an anchor hot.
SHARD_BYTES, HOT = 1 << 20, 4_000
#: Bytes of a text that are looked at together.
SLICE = 1 << 19

_U = np.uint64
_STEP = 0xD6E8FEB86659FD93
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(256, dtype=_U) + _U(0x9E3779B97F4A7C15))
    _UP = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(SLICE + LENGTH, _STEP, _U)]))
    _DOWN = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(SLICE + LENGTH, pow(_STEP, -1, 1 << 64), _U)]))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of ``size`` bytes; at most ``SLICE`` + ``LENGTH`` bytes."""
    n = len(data)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * _UP[:n])])
    return mix((total[size:] - total[: n - size + 1]) * _DOWN[: n - size + 1])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text and their hashes.

    In every string of ``length`` bytes the leftmost of its least grams is an anchor.
    """
    places, hashes = [], []
    window = length - gram + 1
    for at in range(0, max(len(data) - length + 1, 0), SLICE):
        part = data[at : at + SLICE + length - 1]
        h = gram_hashes(part, gram)
        m = len(h)
        key = (h & ~_U((1 << 20) - 1)) | np.arange(m, dtype=_U)
        blocks = np.concatenate([key, np.full(-m % window, 0xFFFFFFFFFFFFFFFF, _U)]).reshape(-1, window)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: m - window + 1], left[window - 1 : m])
        chosen = np.unique(least[np.append(True, least[1:] != least[:-1])] & _U((1 << 20) - 1)).astype(np.int64)
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return places, hashes[first]


def repeated_starts(pieces: list[bytes], places: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the starts of strings of ``length`` bytes that occur at two places.

    ``pieces`` are distinct byte strings; ``places`` has, for each, the numbers of its
    first bytes, where equal numbers mean the same byte of the same document.
    """
    gap = b"\xff"  # never a byte of UTF-8
    raw = np.frombuffer(gap.join(pieces) + gap, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.append((raw.astype(np.int16) + 2) % 257 + 1, 0)
    sa = suffix_array(s, 259)
    common = permuted_prefixes(raw, sa)
    low, high = (np.repeat(np.array([f(p) for p in places], np.int64) - starts, sizes + 1) + np.arange(len(raw)) for f in (min, max))
    valid = np.arange(len(raw)) + length <= np.repeat(starts + sizes, sizes + 1)
    order = sa[1:]
    heads = np.flatnonzero(np.append(True, common[order[1:]] < length))
    twice = np.minimum.reduceat(low[order], heads) != np.maximum.reduceat(high[order], heads)
    found = np.zeros(len(raw), bool)
    found[order] = np.repeat(twice, np.diff(np.append(heads, len(order))))
    found &= valid
    return [np.flatnonzero(found[b : b + n]) for b, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the runs covered by strings that start at ``starts``, ascending."""
    if not len(starts):
        return starts, starts
    heads = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + length))
    return starts[heads], starts[np.append(heads[1:] - 1, len(starts) - 1)] + length


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, hashes = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p, h = anchors(np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8), length, gram)
                ids.append(np.full(len(p), row))
                places.append(p)
                hashes.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (hashes, ids, places)], ["anchor", "id", "place"]
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zstandard.compress((t.as_py() or "").encode("utf-8", "replace"), 3) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])


def _around(length: int, gram: int):
    """Pieces of text around anchors, by shard; around hot anchors one piece each, by anchor.

    In comes ``id, packed, at`` with places, shards and hot anchors (else null) of a
    text's anchors.  Neighbourhoods of one text that overlap in one shard are one piece.
    Of equal pieces of one text around a hot anchor one comes out, and the span of them
    all, with its end in ``place`` and without a piece.
    """
    before, after = length - gram, length
    names = ["shard", "id", "begin", "piece", "key", "place"]

    def pieces(place: np.ndarray, shard: np.ndarray, size: int):
        order = np.lexsort((place, shard))
        place, shard = place[order], shard[order]
        begin, end = np.maximum(place - before, 0), np.minimum(place + after, size)
        heads = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (begin[1:] > end[:-1])))
        lasts = np.append(heads[1:] - 1, len(place) - 1)
        return shard[heads].tolist(), begin[heads].tolist(), end[lasts].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            at = batch.column(2)
            offsets, flat = at.offsets.to_numpy(), at.values
            places, shards, keys = (flat.field(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in range(3))
            for i, (row, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data, own = zstandard.decompress(packed.as_py()), slice(offsets[i], offsets[i + 1])
                place, cold = places[own], shards[own] >= 0
                if cold.any():
                    for k, b, e in zip(*pieces(place[cold], shards[own][cold], len(data)), strict=True):
                        for column, value in zip(out, (k, row, b, data[b:e], None, None), strict=True):
                            column.append(value)
                seen: dict[tuple[int, bytes], list[int]] = {}
                for p, key in zip(place[~cold].tolist(), keys[own][~cold].tolist(), strict=True):
                    if len(piece := data[max(p - before, 0) : p + after]) >= length:
                        seen.setdefault((key, piece), []).append(p)
                for (key, piece), several in seen.items():
                    rows = [(None, row, max(several[0] - before, 0), piece, key, several[0])]
                    if len(several) > 1:  # equal pieces of one text: all but one are done
                        begins = np.sort(np.maximum(np.array(several) - before, 0))
                        rows += [(None, row, b, None, None, e) for b, e in zip(*map(np.ndarray.tolist, runs(begins, len(piece))), strict=True)]
                    for column, values in zip(out, zip(*rows, strict=True), strict=True):
                        column.extend(values)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)

    return run


_HOT = ("key", "id", "place", "begin", "piece", "low", "high")


def _with_hub(length: int, gram: int):
    """Compares pieces around a hot anchor with one of them, the hub.

    A string is named by how many of its bytes lie before the anchor, ``low`` to
    ``high``.  Those that the piece has in common with the hub are done: a row without a
    piece.  Another string has the first byte before the anchor that differs or, if it
    has not, the first behind it.  Of such strings only those of pieces that differ from
    the hub there too, and by the same byte, can be equal: a row with a longer key.
    """
    spare = length - gram

    def same(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))

    def key(old: int, side: int, depth: int, byte: int) -> int:
        with np.errstate(over="ignore"):
            return int(mix(np.array([old], np.int64).view(_U) + _U(_STEP) * _U(1 + side + 4 * byte + 1024 * depth)).view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for old, row, place, begin, piece, low, high, hub in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub["id"], hub["place"]) == (row, place):
                    continue
                at, hub_at, other = place - begin, hub["place"] - hub["begin"], hub["piece"]
                word = piece[at : at + gram]
                if word != other[hub_at : hub_at + gram]:  # equal hashes of unequal anchors
                    out.append((key(old, 2, 0, zlib.crc32(word)), row, place, begin, piece, low, high))
                    continue
                left = min(same(piece[:at][::-1], other[:hub_at][::-1]), spare)
                right = min(same(piece[at + gram :], other[hub_at + gram :]), spare)
                first, last = max(low, spare - right, hub["low"]), min(high, left, hub["high"])
                if first <= last:
                    out.append((old, row, place, begin, None, first, last))
                if left < high:
                    out.append((key(old, 0, left, piece[at - left - 1]), row, place, begin, piece, max(low, left + 1), high))
                if low <= min(high, left, spare - right - 1):
                    deeper = key(old, 1, right, piece[at + gram + right])
                    out.append((deeper, row, place, begin, piece, low, min(high, left, spare - right - 1)))
            columns = list(zip(*out, strict=True)) or [()] * len(_HOT)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "piece" else pa.int64()) for n, c in zip(_HOT, columns, strict=True)], list(_HOT))

    return run


def _settle_hot(rows: DataFrame, length: int, gram: int, hot: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Spans that pieces around hot anchors have in common with hubs, and pieces for the shards.

    Each round compares the pieces of a hot key with its hub and gives those that differ
    keys of their own, by where and how they do; keys that are no longer hot go to shards.
    A piece's strings are dealt out, never copied, and what is common is one row.
    """
    begin = (F.col("place") - F.col("high")).alias("begin")
    span = F.col("id"), begin, (F.col("place") - F.col("low") + length).alias("end")
    spans, cold = [], []
    while True:
        sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hot-keys")
        cut = F.substring("piece", (F.col("place") - F.col("high") - F.col("begin") + 1).cast("int"), (F.col("high") - F.col("low") + length).cast("int"))
        some = rows.join(sizes.filter(F.col("n") <= hot), "key")
        cold.append(materialize(some.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "id", begin, cut.alias("piece")), "cold"))
        if sizes.filter(F.col("n") > hot).isEmpty():
            return _all_of(spans), _all_of(cold)
        own = rows.join(sizes.filter(F.col("n") > hot).select("key"), "key").withColumn("hash", F.xxhash64("piece"))
        # The hub is one of the most frequent pieces; of equally frequent ones any, not the first.
        often = own.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"))
        often = often.groupBy("key").agg(F.max_by("hash", F.struct("n", F.xxhash64("hash"))).alias("hash"))
        widest = F.struct(F.col("low") - F.col("high"), "id", "place")
        hubs = own.join(often, ["key", "hash"]).groupBy("key").agg(F.min_by(F.struct(*_HOT[1:]), widest).alias("hub"))
        hubs = materialize(hubs, "hubs")
        shape = "key long, id long, place long, begin long, piece binary, low long, high long"
        told = materialize(own.join(hubs, "key").select(*_HOT, "hub").mapInArrow(_with_hub(length, gram), shape), "hot")
        done = told.filter("piece IS NULL")
        # What any piece has in common with the hub, the hub has in common with it.
        back = done.select("key", "low", "high").distinct().join(hubs, "key")
        back = back.select(F.col("hub.id").alias("id"), F.col("hub.place").alias("place"), "low", "high").select(*span)
        spans.append(done.select(*span).union(materialize(back, "back")))
        rows = told.filter("piece IS NOT NULL")


def _all_of(parts: list[DataFrame]) -> DataFrame | None:
    return functools.reduce(DataFrame.union, parts) if parts else None


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Spans of repeated bytes, ``id, begin, end``, unmerged.

    ``texts`` has a unique ``id`` and ``text``.  All occurrences of an anchor go to one
    shard, named by the first text that has it: texts that share much share that first
    text, so their neighbourhoods join to long pieces.  The anchors of a first text that
    would fill more than a shard are dealt over several.
    """
    all_anchors = materialize(texts.mapInArrow(_anchored(length, gram), "anchor long, id long, place long"), "anchors")
    repeated = materialize(
        all_anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"), "repeated"
    )
    total = repeated.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total * length / shard_bytes))
    loads = repeated.groupBy("first").agg(F.sum("n").alias("load"))
    lots = F.ceil(F.col("load") * length / shard_bytes)
    slot = F.pmod(F.xxhash64("first", F.pmod("anchor", lots)), F.lit(shards)).cast("int")
    shard = F.when(F.col("n") <= hot, slot).otherwise(F.lit(-1))
    routed = materialize(repeated.join(loads, "first").select("anchor", shard.alias("shard")), "routed")
    hot_anchor = F.when(F.col("shard") < 0, F.col("anchor")).alias("key")
    places = all_anchors.join(routed, "anchor").groupBy("id").agg(F.collect_list(F.struct("place", "shard", hot_anchor)).alias("at"))
    packed = texts.mapInArrow(_packed, "id long, packed binary")
    shape = "shard int, id long, begin long, piece binary, key long, place long"
    around = materialize(packed.join(places, "id").select("id", "packed", "at").mapInArrow(_around(length, gram), shape), "pieces")

    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, list[int]] = {}
        for i, piece in enumerate(rows["piece"]):
            found.setdefault(piece, []).append(i)
        ids, first = pd.factorize(rows["id"])[0], rows["begin"].to_numpy()
        number = (ids.astype(np.int64) << 40) + first
        pieces = list(found)
        starts = repeated_starts(pieces, [number[found[p]] for p in pieces], length)
        out = []
        for piece, own in zip(pieces, starts, strict=True):
            a, b = runs(own, length)
            for i in found[piece] if len(a) else ():
                out.append((np.full(len(a), rows["id"].iat[i]), first[i] + a, first[i] + b))
        columns = map(np.concatenate, zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("id", "begin", "end"), columns, strict=True)))

    low = F.greatest(F.lit(0), F.col("place") + length - F.col("begin") - F.octet_length("piece"))
    high = F.least(F.lit(length - gram), F.col("place") - F.col("begin"))
    inside = around.filter("piece IS NULL").select("id", "begin", F.col("place").alias("end"))
    hot_rows = around.filter("key IS NOT NULL").select("key", "id", "place", "begin", "piece", low.cast("long").alias("low"), high.cast("long").alias("high"))
    common, split = _settle_hot(hot_rows.filter("low <= high"), length, gram, hot, shards)
    cold = around.filter("shard IS NOT NULL").select("shard", "id", "begin", "piece").union(split)
    spans = cold.groupBy("shard").applyInPandas(scan, "id long, begin long, end long")
    return _all_of([spans, inside] + ([common] if common is not None else []))


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES, hot: int = HOT,
) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept_text``.

    Texts are UTF-8 bytes; a null text is empty.  A byte is removed if a string of
    ``length`` bytes within its document covers it and starts at another place too, in
    this or another document, overlaps included.  ``n_spans`` counts the maximal removed
    runs, ``kept_text`` is what is left, decoded with replacement where a character was
    cut.  Texts shorter than ``length`` stay whole.  Ids need not be unique: rows are
    told apart by their place in the input.  An empty table gives an empty result, and
    columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    unique = docs.select(F.count(F.col(id_col)).alias("n"), F.count_distinct(F.col(id_col)).alias("k"), F.count(F.lit(1)).alias("rows")).first()
    if unique["k"] == unique["rows"]:
        texts, names = rows.select(F.col("doc").alias("id"), "text"), None
    else:
        kept = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "texts")
        texts, names = kept.select("id", "text"), kept.select("id", "doc")
    spans = repeated_spans(texts, length, gram, shard_bytes, hot)
    packed = texts.mapInArrow(_packed, "id long, packed binary")
    per_text = materialize(spans.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "text-spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, count, digest, left = [], [], [], [], []
            for i in range(batch.num_rows):
                data, kept, end, removed, n = zstandard.decompress(batch.column(1)[i].as_py()), [], 0, 0, 0
                for x in sorted((x["begin"], x["end"]) for x in batch.column(2)[i].as_py() or ()):
                    if x[0] > end or not n:
                        kept.append(data[end : x[0]])
                        n += 1
                        removed += x[1] - x[0]
                    elif x[1] > end:
                        removed += x[1] - end
                    end = max(end, x[1])
                kept.append(data[end:])
                rest = b"".join(kept)
                size.append(len(data))
                gone.append(removed)
                count.append(n)
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, count)), pa.array(digest, pa.string()), pa.array(left, pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    shape = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    out = packed.join(per_text, "id", "left").select("id", "packed", "spans").mapInArrow(remove, shape)
    if names is not None:
        return out.join(names, "id").select(F.col("doc").alias(id_col), *out.columns[1:])
    return out.withColumnRenamed("id", id_col)
