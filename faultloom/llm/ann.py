"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of nearness, its permutation.
The index keeps one inverted file a pivot: the vectors that have it in their
permutation, with its rank.  A query walks the files of its own permutation, which adds
up each vector's footrule distance to it; those that are near enough are reranked by
the exact measure, the inner product in double precision.  How near is enough is read
off a bounded sample of vectors for each query: the footrule that the nearest ``share``
of them reach.

Scale.  Copies of a vector are one entry with its smallest ids, made with map-side
combine.  Entries are dealt to blocks by their nearest pivot, so a block holds the files
of one region; a region with too many entries is split.  A query first searches the
block of its own nearest pivot.  Its k-th score there is one it can only better, so
of the other blocks it goes to those alone whose region can have a better one, by the
angles between query, pivots and the region's outermost entry.  Each block is one task
of bounded size that returns only such better rows.  Vectors without any cluster have no
region that can be left out; then every query does go to every block, and the work grows
with queries times rows, of which a fraction ``share`` is reranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS = 1024
#: Length of the permutations: nearest pivots that an entry is posted under, and a query walks.
NEAREST = 64
#: Share of the entries that a query reranks, by the sample, and how many at least.
SHARE, LEAST = 0.15, 256
#: Sampled vectors, beside the pivots, that footrules are read off.
SAMPLE = 2048
#: Entries of a block, and queries that a copy of a block takes.
BLOCK_ROWS, QUERY_ROWS = 8192, 65536


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that makes all lengths equal: order by inner product stays."""
    rest = longest**2 - (vectors**2).sum(axis=1)
    return np.hstack([vectors, np.sqrt(rest.clip(0.0))[:, None]])


class Pivots:
    """Pivots and a sample of other vectors, and what can be said of a vector by them."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int, nearest: int, share: float, least: int, rows: int) -> None:
        sample = sample[np.random.default_rng(5).permutation(len(sample))]
        count = max(1, min(pivots, len(sample) // 2))
        self.longest, self.points = longest, _lifted(sample[:count], longest)
        self.nearest = min(nearest, count)
        others = sample[count : count + SAMPLE] if len(sample) > 1 else sample
        self.sample = Files(self.permutations(_lifted(others, longest)), count)
        self.above = len(others) - math.ceil(len(others) * max(share, least / rows))

    def enough(self, walk: np.ndarray) -> float:
        """The nearness by footrule from which on an entry is reranked."""
        return np.partition(self.sample.nearness(walk), self.above)[self.above] if self.above > 0 else -math.inf

    def permutations(self, lifted: np.ndarray) -> np.ndarray:
        return np.argsort(-(lifted @ self.points.T), axis=1, kind="stable")[:, : self.nearest].astype(np.int32)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and the cosine of the angle to it."""
        products = _lifted(vectors, self.longest) @ self.points.T
        cell = products.argmax(axis=1)
        return cell, products[np.arange(len(cell)), cell] / self.longest**2

    def angles(self, queries: np.ndarray) -> np.ndarray:
        """Angles between queries and pivots."""
        products = _lifted(queries, 0.0) @ self.points.T
        return np.arccos((products / np.maximum(np.linalg.norm(queries, axis=1), 1e-300)[:, None] / self.longest).clip(-1.0, 1.0))


class Files:
    """Inverted files of permutations: entries and ranks by pivot."""

    def __init__(self, permutations: np.ndarray, pivots: int) -> None:
        self.entries, self.nearest = permutations.shape
        posts = np.argsort(permutations, axis=None, kind="stable")
        self.rows, self.ranks = np.divmod(posts.astype(np.int32), np.int32(max(self.nearest, 1)))
        self.starts = np.concatenate([[0], np.bincount(permutations.ravel(), minlength=pivots).cumsum()]).tolist()

    def nearness(self, walk: np.ndarray) -> np.ndarray:
        """A constant less half the footrule of each entry to ``walk``.

        The footrule of two prefixes of length m, absent pivots at place m, is a constant
        less twice the sum of m - max(rank, rank) over the pivots they share.
        """
        lots = [slice(self.starts[p], self.starts[p + 1]) for p in walk.tolist()]
        rows = np.concatenate([self.rows[at] for at in lots])
        own = np.repeat(np.arange(len(walk)), [at.stop - at.start for at in lots])
        ranks = np.maximum(np.concatenate([self.ranks[at] for at in lots]), own)
        return np.bincount(rows, self.nearest - ranks, minlength=self.entries)


class Block:
    """The files of one region: distinct vectors with the ids of their copies, ascending."""

    def __init__(self, pivots: Pivots, vectors: np.ndarray, ids: list[np.ndarray]) -> None:
        self.pivots, self.vectors, self.ids = pivots, vectors, ids
        self.files = Files(pivots.permutations(_lifted(vectors, pivots.longest)), len(pivots.points))

    def search(self, query_id: int, query: np.ndarray, walk: np.ndarray, k: int, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products, ``at_least`` or more, of the best ``k`` rows found."""
        near, least = self.files.nearness(walk), max(len(self.vectors) - k - 1, 0)
        enough = min(self.pivots.enough(walk), np.partition(near, least)[least])  # always k besides the query
        found = np.flatnonzero(near >= enough)
        scores = np.einsum("ij,j->i", self.vectors[found], query)
        good = scores >= at_least
        found, scores = found[good], scores[good]
        if len(found) > k + 1:  # the query itself may be one
            best = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            found, scores = found[best], scores[best]
        copies = [(c := self.ids[e])[c != query_id][:k] for e in found.tolist()]
        ids = np.concatenate([np.zeros(0, np.int64), *copies])
        scores = np.repeat(scores, [len(c) for c in copies])
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def regions(pivots: np.ndarray, entries: np.ndarray, block_rows: int) -> list[list[int]]:
    """Blocks of each pivot's cell, given how many entries it has.

    Neighbouring cells share a block as long as they fit; a cell that does not fit in
    one has several to itself.
    """
    blocks: list[list[int]] = [[] for _ in entries]
    left, number = set(np.flatnonzero(entries).tolist()), 0
    for cell in [c for c in left if entries[c] > block_rows]:
        left.remove(cell)
        count = math.ceil(entries[cell] / block_rows)
        blocks[cell] = list(range(number, number + count))
        number += count
    while left:
        first, held = min(left), 0
        for cell in np.argsort(-(pivots @ pivots[first]), kind="stable").tolist():
            if cell in left:
                if held + entries[cell] > block_rows and held:
                    break
                held += entries[cell]
                blocks[cell] = [number]
                left.remove(cell)
        number += 1
    return blocks


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, nearest: int = NEAREST, share: float = SHARE, least: int = LEAST,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` nearest rows found for each query.

    Nearness is the inner product, largest first, ties to the smaller id; a query's own
    id is no candidate.  Vectors that are null, of another length than most, all zero,
    or with null or non-finite components take no part, as rows or as queries.  Rows
    that repeat an id are candidates each; queries that repeat an id are one query (the
    least of their vectors).  With fewer candidates than ``k`` all are returned; an
    empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    # Adding zero makes -0.0 the same component as 0.0, of which copies may have either.
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    clean = lambda df: df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), plain.alias("v"))
    rows = clean(vectors).filter("id IS NOT NULL").groupBy("v", "id").agg(F.count(F.lit(1)).alias("times"))
    # Of copies of a vector the k + 1 smallest ids are enough, a query's own among them.
    smallest = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    listed = F.sort_array(F.collect_list(F.struct("id", F.least("times", F.lit(k)).alias("times"))))
    entries = materialize(smallest.groupBy("v").agg(listed.alias("ids")), "entries")
    sizes = entries.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"))
    top = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not top:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    d, n, longest = top[0]["d"], top[0]["n"], math.sqrt(top[0]["longest"])
    entries = entries.filter(F.size("v") == d)
    sample = entries.orderBy(F.xxhash64("v"), "v").select("v").limit(pivots + SAMPLE).collect()
    by = Pivots(np.array([r["v"] for r in sample]), longest, pivots, nearest, share, least, n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            cell, cosine = by.cells(x)
            yield pa.RecordBatch.from_arrays([_packed(x), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(cosine)], ["v", "ids", "cell", "cosine"])

    shape = "v binary, ids array<struct<id:long,times:long>>, cell int, cosine double"
    entries = materialize(entries.select("v", F.col("ids").cast("array<struct<id:long,times:long>>")).mapInArrow(placed, shape), "posted")
    cells = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()
    held, radius = np.zeros(len(by.points), np.int64), np.zeros(len(by.points))
    for r in cells:
        held[r["cell"]], radius[r["cell"]] = r["n"], math.acos(max(-1.0, min(1.0, r["least"])))
    blocks = regions(by.points, held, block_rows)
    count = max((b[-1] for b in blocks if b), default=0) + 1
    of_block = [[c for c in range(len(blocks)) if b in blocks[c]] for b in range(count)]
    spread = F.array(*(F.array(*map(F.lit, b or [0])) for b in blocks))
    own = F.element_at(spread, F.col("cell") + 1)
    asked = clean(queries).filter((F.size("v") == d) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "queries")
    teams = max(1, math.ceil(asked.count() / query_rows))
    index = entries.withColumn("block", F.element_at(own, F.pmod(F.xxhash64("v"), F.size(own)).cast("int") + 1)).withColumn(
        "team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1)))
    )

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries' home blocks, or, with a k-th score, the others that may better it."""
        for batch in batches:
            x = _matrix(batch.column(1), d)
            ids, known = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            angle = by.angles(x)
            angle[:, held == 0] = np.inf
            home = [blocks[c][0] for c in angle.argmin(axis=1).tolist()]
            best = np.linalg.norm(x, axis=1)[:, None] * longest * np.cos((angle - radius).clip(0.0, np.pi))
            bound = np.stack([best[:, c].max(axis=1) for c in of_block], axis=1)
            goes = np.zeros(bound.shape, bool)
            goes[np.arange(len(x)), home] = True
            later = ~np.isnan(known)
            goes[later] = ~goes[later] & (bound[later] >= known[later, None] - 1e-9 * (1 + np.abs(known[later, None])))
            row, block = np.nonzero(goes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), _packed(x[row]), pa.array(known[row]), pa.array(block.astype(np.int32))], ["id", "v", "known", "block"]
            )

    def search(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asks):
            ids = [np.repeat([x["id"] for x in c], [x["times"] for x in c]) for c in own["ids"]]
            block = Block(by, np.stack([np.frombuffer(x) for x in own["v"]]), ids)
            for at in range(0, len(asks), 1024):
                some = asks.iloc[at : at + 1024]
                points = np.stack([np.frombuffer(x) for x in some["v"]])
                walks = by.permutations(_lifted(points, 0.0))
                known = some["known"].fillna(-np.inf).to_numpy()
                for i, query_id in enumerate(some["id"].tolist()):
                    found, scores = block.search(query_id, points[i], walks[i], k, known[i])
                    out.append((np.full(len(found), query_id), found, scores))
        columns = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    def found_in(asks: DataFrame) -> DataFrame:
        sent = asks.mapInArrow(routed, "id long, v binary, known double, block int").withColumn("team", F.pmod(F.xxhash64("id"), F.lit(teams)).cast("int"))
        pairs = index.select("v", "ids", "block", "team").groupBy("block", "team").cogroup(sent.groupBy("block", "team"))
        return pairs.applyInPandas(search, "query_id long, id long, score double")

    home = materialize(found_in(asked.select("id", "v", F.lit(None).cast("double").alias("known"))), "home")
    # With fewer than k found at home, any score is welcome.
    kth = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("score")).alias("known"))
    rest = asked.join(kth, "id", "left").select("id", "v", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    found = home.union(found_in(rest)) if count > 1 else home
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
    )


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())
