"""Near-duplicate detection by BagMinHash signatures, banding and verification.

A text is the multiset of its word shingles.  The signature of a multiset is the
first point, per register, of Poisson processes over (time, level): a shingle of
weight w has the points of level below w.  Levels are discretised into the intervals
(0,1], (1,2], (2,4], (4,8]...; an interval that w cuts is split by the level of each
point.  Two signatures agree in a register with probability equal to the weighted
Jaccard similarity.  Processing stops at a time at which, by the text's total weight,
all registers should have a point, and goes on only if one has none.

Texts that agree in a band of registers are candidates; a link is a pair whose exact
multiset overlap reaches the threshold, and classes are connected components of links.

Scale.  Copies (equal word sequences) are one node.  In a bucket every member is first
compared with one member, its hub: the one with the most companions over all bands, so
that a cluster has the same hub in most of its buckets.  A hot bucket costs its size,
not its square.  Those that are linked to no hub are then compared with a few drawn
members, which joins clusters without their hub.  What is left, texts with a hub in
common but in different components, is settled exactly by what each differs from the
hub in (``_open_pairs``).  Components are found by alternating large and small stars on
tables; nothing that grows with the input comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import materialize, materialize_by

BANDS, ROWS = 20, 4
THRESHOLD = 0.8
#: A register is empty at the stopping time with probability exp(-SURE) / registers.
SURE = 6.0
#: Members drawn from a bucket that those its hub did not link are compared with.
DRAWS = 2
#: Pairs of one hub that a task compares.
LOT = 500

_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _points(seed, rate, low, weight, text, after, until, registers):
    """Points of the processes with after < time <= until, as (cell, time, name)."""
    cells, times, names = [], [], []
    clock, step = np.zeros(len(seed)), 0
    while len(seed):
        with np.errstate(over="ignore"):
            first = S.mix(seed + _U(2 * step + 1) * _U(0x9E3779B97F4A7C15))
        clock = clock - np.log(_uniform(first)) / rate
        live = clock <= until[text]
        seed, rate, low, weight, text, clock, first = (v[live] for v in (seed, rate, low, weight, text, clock, first))
        with np.errstate(over="ignore"):
            second = S.mix(seed + _U(2 * step + 2) * _U(0x9E3779B97F4A7C15))
        level = low + (second & _U(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * rate
        new = (level < weight) & (clock > after[text])
        cells.append(text[new] * registers + ((second[new] >> _U(32)) % _U(registers)).astype(np.int64))
        times.append(clock[new])
        names.append(first[new])
        step += 1
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (cells, times, names))


def bag_signatures(h: np.ndarray, t: np.ndarray, texts: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x registers) of multisets of shingles, and which texts have one."""
    sign = np.zeros(texts * registers, _U)
    has = np.zeros(texts, bool)
    if not len(h):
        return sign.reshape(texts, registers), has
    heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
    weight = np.diff(np.append(heads, len(h))).astype(np.float64)
    h, t = h[heads], t[heads]
    total = np.bincount(t, weight, minlength=texts)
    has = total > 0
    # one process for each interval of levels that lies, in part, below the weight
    seeds, rates, lows, weights, of = [h], [np.ones(len(h))], [np.zeros(len(h))], [weight], [t]
    low = 1.0
    while True:
        more = weight > low
        if not more.any():
            break
        h, t, weight = h[more], t[more], weight[more]
        seeds.append(S.mix(h ^ _U(int(low) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        rates.append(np.full(len(h), low))
        lows.append(np.full(len(h), low))
        weights.append(weight)
        of.append(t)
        low *= 2
    seed, rate, lo, weight, text = map(np.concatenate, (seeds, rates, lows, weights, of))
    done = np.zeros(texts * registers, bool)
    span = registers * (np.log(registers) + SURE) / np.maximum(total, 1.0)
    after, until = np.zeros(texts), np.where(has, span, -1.0)
    while True:
        cell, time, name = _points(seed, rate, lo, weight, text, after, until, registers)
        order = np.argsort(-time, kind="stable")
        cell, name = cell[order].astype(np.int64), name[order].astype(_U)
        # the earliest point of a cell is written last; earlier rounds stay
        late = done[cell]
        cell, name = cell[~late], name[~late]
        sign[cell] = name
        done[cell] = True
        lacking = has & ~done.reshape(texts, registers).all(axis=1)
        if not lacking.any():
            return sign.reshape(texts, registers), has
        mine = lacking[text]
        seed, rate, lo, weight, text = (v[mine] for v in (seed, rate, lo, weight, text))
        after, until = until.copy(), np.where(lacking, until + span, -1.0)


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in S.chunks(batch.column(1)):
                n = len(bounds) - 1
                words, of = S.word_hashes(data, bounds)
                a, b, count = S.text_hashes(words, of, n)
                sign, has = bag_signatures(*S.shingles(words, of, n), n, bands * rows)
                key = np.zeros((n, bands), _U)
                for j in range(rows):
                    key = S.mix(key + sign.reshape(n, bands, rows)[:, :, j] + _U(j + 1))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(count.astype(np.int64)), keys],
                    ["id", "h1", "h2", "n_words", "bands"],
                )

    return run


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of a text as the sorted hashes of (shingle, occurrence).

    In comes ``id, h1, h2, text``; rows whose text has not these hashes are left out.
    """
    for batch in batches:
        named = [batch.column(k).to_numpy().view(_U) for k in (1, 2)]
        for row, data, bounds in S.chunks(batch.column(3)):
            n = len(bounds) - 1
            words, of = S.word_hashes(data, bounds)
            a, b, _ = S.text_hashes(words, of, n)
            own = (a == named[0][row : row + n]) & (b == named[1][row : row + n])
            h, t = S.shingles(words, of, n)
            units = S.mix(h + S.occurrences(h, t).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
            units = units[np.lexsort((units, t))]
            ends = np.cumsum(np.bincount(t, minlength=n))
            bags = [units[e - c : e].tobytes() for e, c in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
            found = pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(bags, pa.binary())], ["id", "bag"])
            yield found.filter(pa.array(own))


def overlap(a: bytes, b: bytes) -> float:
    """The weighted Jaccard similarity of two bags."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def _both_bags(pairs: DataFrame, one: str, hub: str, bags: DataFrame) -> DataFrame:
    """``pairs`` with the bag ``x`` of ``one`` and ``y`` of ``hub``; a hub of many pairs goes to several tasks.

    Its bag is copied once for ``LOT`` pairs, so the copies are few beside the bags ``x``.
    """
    lots = pairs.groupBy(hub).agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, hub).withColumn("lot", F.pmod(F.xxhash64(one), F.col("lots")).cast("int")).drop("lots")
    hubs = bags.select(F.col("id").alias(hub), F.col("bag").alias("y")).join(lots, hub)
    hubs = hubs.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return dealt.join(bags.select(F.col("id").alias(one), F.col("bag").alias("x")), one).join(hubs, [hub, "lot"])


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose bags overlap enough, with ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], float)
            keep = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "similarity"]).filter(keep)

    both = _both_bags(pairs.select("a", "b"), "a", "b", bags)
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id of ``edges`` (``a, b``): root is the least of its component."""
    tall = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = materialize(edges.select(*tall).filter("u <> v").distinct(), "stars")
    mark = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                stars.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        mark = state
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")


def _alike(x: str, y: str, threshold: float):
    """Whether two texts are near enough in size for a link."""
    return F.least(x, y) + 1e-6 >= F.greatest(x, y) * threshold


def _drawn_pairs(members: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Pairs of members that their hubs did not link with some drawn from their bucket.

    In a bucket of several components the largest is left aside, ``DRAWS`` of the other
    members are drawn, and each of the others is paired with these.
    """
    rooted = members.join(components(links), "id", "left").select("id", "size", "band", "bucket", F.coalesce("root", "id").alias("root"))
    sides = rooted.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    main = sides.groupBy("band", "bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    minor = materialize(rooted.join(main.filter("roots > 2"), ["band", "bucket"]).filter("root <> main").select(*rooted.columns), "minor")
    draws = (F.min(F.struct(F.xxhash64("id", F.lit(j)), "id", "size", "root")) for j in range(DRAWS))
    drawn = minor.groupBy("band", "bucket").agg(F.array_distinct(F.array(*draws)).alias("drawn"))
    both = minor.join(drawn.select("band", "bucket", F.explode("drawn").alias("y")), ["band", "bucket"])
    apart = (F.col("root") != F.col("y.root")) & _alike("size", "y.size", threshold)
    return both.filter(apart).select(F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b")).distinct()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units that a text has and its hub has not, or the other way round, one row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            units = [
                np.setxor1d(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U), assume_unique=True).view(np.int64)
                for x, y in zip(part.column(4), part.column(5), strict=True)
            ]
            d = np.array([len(u) for u in units])
            index = pa.array(np.repeat(np.arange(len(d)), d))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(index) for i in range(4)), pa.array(np.repeat(d, d)), pa.array(np.concatenate(units))],
                ["hub", "id", "size", "root", "d", "unit"],
            )


def _open_pairs(stars: DataFrame, links: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of texts with a hub in common, in different components, that may be linked.

    Let D(x) be the units by which x differs from the hub.  x and y differ by the units
    in one of D(x) and D(y) only, and are linked if these are at most s = (1-t)/(1+t) of
    both sizes; so D(x) and D(y) have c = (|D(x)| + |D(y)| - s) / 2 units in common.
    Two texts in different components are not both as near to the hub as to need none
    (c > 0).  With the units in one order, rarest first, their first common unit is so
    early that c of them can follow it.  In a group of near copies most differences are
    a text's own, and of texts with many differences nearly all would have to be
    common, so few pairs are made, and the common part of the group plays no role.
    """
    s = (1 - threshold) / (1 + threshold)
    rooted = stars.join(components(links), "id", "left").select("hub", "id", "size", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("hub")
    rooted = materialize(rooted.join(mixed, "hub"), "open")
    both = _both_bags(rooted, "id", "hub", bags)
    units = both.select("hub", "id", "size", "root", "x", "y").mapInArrow(_differences, "hub long, id long, size long, root long, d long, unit long")
    units = materialize(units, "units")
    # Units of one component alone join nothing: they come first, and are only counted.
    spread = units.groupBy("hub", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    known = units.join(spread.select("hub", "unit", "n"), ["hub", "unit"])
    own = Window.partitionBy("hub", "id")
    place = F.row_number().over(own.orderBy("n", "unit")) + F.col("d") - F.count(F.lit(1)).over(own)
    early = known.withColumn("place", place).filter(F.col("place") <= F.col("size") * ((1 - threshold) / threshold) + 1 + 1e-6)
    early = materialize(early.select("hub", "unit", "id", "size", "root", "d", (F.col("d") - F.col("place") + 1).alias("left")), "early")
    other = early.select("hub", "unit", *(F.col(c).alias(f"y_{c}") for c in ("id", "size", "root", "d", "left")))
    common = (F.col("d") + F.col("y_d") - (F.col("size") + F.col("y_size")) * s) / 2
    fits = (F.col("id") < F.col("y_id")) & (F.col("root") != F.col("y_root")) & _alike("size", "y_size", threshold)
    pairs = early.join(other, ["hub", "unit"]).filter(fits & (F.least("left", "y_left") + 1e-6 >= common))
    return pairs.select(F.col("id").alias("a"), F.col("y_id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: ``id_col, class_id, class_size, kept``.

    ``class_id`` is the smallest id of the document's class and ``kept`` marks that
    document.  Two texts are linked if the weighted Jaccard similarity of their
    multisets of five-word shingles is at least ``threshold``, and they agree in a band;
    classes are the connected components of all links.  Equal word sequences are one
    class.  Texts without a word, null or empty, are alone.  Rows that repeat an id
    belong to one class.  Rows with a null id have a null class and are kept.  An empty
    table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(
        texts.mapInArrow(_signed(bands, rows), "id long, h1 long, h2 long, n_words long, bands array<long>"), "signatures"
    )
    some = signed.filter("n_words > 0 AND id IS NOT NULL")
    size = F.greatest(F.col("n_words") - (S.WORDS - 1), F.lit(1)).alias("size")
    # A node is a word sequence; its number, unlike the least of its ids, is its own.
    texts_of = some.groupBy("h1", "h2").agg(F.min(F.struct("id", "n_words", "bands")).alias("one")).select("h1", "h2", "one.*")
    nodes = materialize(texts_of.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("id").alias("least"), size, "bands"), "nodes")
    placed = nodes.select(F.col("node").alias("id"), "size", "least", F.posexplode("bands").alias("band", "bucket"))
    crowds = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(placed.join(crowds, ["band", "bucket"]), "members")
    degree = materialize(members.groupBy("id").agg(F.sum("n").alias("degree")), "degree")
    needed = nodes.join(degree.select(F.col("id").alias("node")), "node").select("node", "h1", "h2", F.col("least").alias("id"))
    # The same plan at every size: a merge join, and then no more shuffle of the bags.
    known = texts.join(needed.hint("merge"), "id").select(F.col("node").alias("id"), "h1", "h2", "text")
    bags = materialize_by(known.mapInArrow(_bagged, "id long, bag binary"), "bags", "id")
    central = F.max_by(F.struct("id", "size"), F.struct("degree", -F.col("least"))).alias("y")
    hubs = members.join(degree, "id").groupBy("band", "bucket").agg(central)
    stars = members.join(hubs, ["band", "bucket"]).filter(F.col("id") != F.col("y.id"))
    stars = materialize(stars.select(F.col("y.id").alias("hub"), F.col("y.size").alias("hub_size"), "id", "size").distinct(), "stars")
    first = stars.filter(_alike("size", "hub_size", threshold)).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    links = materialize(verified(first, bags, threshold), "links")
    drawn = materialize(_drawn_pairs(members, links, threshold), "pairs")
    links = links.union(materialize(verified(drawn, bags, threshold), "links"))
    rest = materialize(_open_pairs(stars, links, bags, threshold), "pairs")
    links = links.union(materialize(verified(rest, bags, threshold), "links"))
    # Rows that repeat an id with another text tie the nodes of both.
    again = some.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node").distinct()
    first_of = again.groupBy("id").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = again.join(first_of, "id").filter("node <> a").select("a", F.col("node").alias("b"))
    roots = materialize(components(links.select("a", "b").union(ties)), "roots")
    rooted = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").select("h1", "h2", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("name")), "names")
    belongs = rooted.join(named, "root").select("h1", "h2", F.col("name").alias("root"))
    has_words = F.col("has_words") & F.col("id").isNotNull()
    placed_rows = materialize(
        signed.select("id", "h1", "h2", (F.col("n_words") > 0).alias("has_words"))
        .join(materialize(belongs, "belongs"), ["h1", "h2"], "left")
        .select("id", F.when(has_words, F.col("root")).otherwise(F.col("id")).alias("class_id")),
        "classes",
    )
    sizes = materialize(placed_rows.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1"), "sizes")
    return placed_rows.join(sizes, "class_id", "left").select(
        F.col("id").alias(id_col),
        "class_id",
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"),
    )
