"""Normalising, combining and ranking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

# Score of the first, second... kept frame of a trace, and of all later ones.
RANK_SCORES = (1.0, 0.5, 0.33, 0.25, 0.2, 0.17, 0.14, 0.12, 0.11, 0.1)
LOG_PATH_SCORE = 0.1


def minmax(df: DataFrame, keys: list[str], score: str = "score", absent: Column | None = None) -> DataFrame:
    """Scores scaled to 0..1 within ``keys``; all 1 where all are equal; zeros leave after.

    ``absent``: true where rows of score 0 were never made, so that the least is 0.
    """
    w = Window.partitionBy(*keys)
    low = F.min(score).over(w)
    if absent is not None:
        low = F.when(absent, F.least(low, F.lit(0.0))).otherwise(low)
    high = F.max(score).over(w)
    out = df.withColumn("__low", low).withColumn("__high", high)
    scaled = F.when(F.col("__high") == F.col("__low"), 1.0).otherwise((F.col(score) - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return out.withColumn(score, scaled).drop("__low", "__high")


def nonzero(df: DataFrame, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) != 0)


def stack_rank_scores(frames: DataFrame, title: str = "title", trace: str = "trace", pos: str = "pos", method: str = "method") -> DataFrame:
    """Best score of each method by its place among the kept frames of a trace."""
    place = F.row_number().over(Window.partitionBy(title, trace).orderBy(pos))
    table = F.array(*map(F.lit, RANK_SCORES))
    scored = frames.withColumn("__place", place).withColumn("score", F.element_at(table, F.least(F.col("__place"), F.lit(len(RANK_SCORES)))))
    return scored.groupBy(title, method).agg(F.max("score").alias("score"))


def log_path_scores(paths: DataFrame, title: str = "title", method: str = "method") -> DataFrame:
    return paths.select(title, method).distinct().withColumn("score", F.lit(LOG_PATH_SCORE))


def summed(*parts: DataFrame, keys: tuple[str, ...] = ("title", "method"), digits: int | None = 2) -> DataFrame:
    """Scores of several tables added by key, rounded as they are kept."""
    out = parts[0].select(*keys, "score")
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, "score"))
    total = F.sum("score")
    return out.groupBy(*keys).agg((F.round(total, digits) if digits is not None else total).alias("score"))


def path_scores(nodes: DataFrame, vsm: DataFrame, coverage: DataFrame, vsm_share: float = 0.2) -> DataFrame:
    """``title, method, score`` of path nodes: similarity, and PageRank times coverage.

    ``nodes`` has ``title, method, pagerank``; the two others ``title, method, score``
    and are matched by simple key, the best score counting.  Only positive scores stay.
    """
    best = lambda df, name: df.groupBy("title", names.simple_key(F.col("method")).alias("key")).agg(F.max("score").alias(name))
    joined = (
        nodes.withColumn("key", names.simple_key(F.col("method")))
        .join(best(vsm, "v"), ["title", "key"], "left")
        .join(best(coverage, "c"), ["title", "key"], "left")
    )
    score = vsm_share * F.coalesce("v", F.lit(0.0)) + (1 - vsm_share) * F.col("pagerank") * F.coalesce("c", F.lit(0.0))
    scored = joined.select("title", names.dotted(F.col("method")).alias("method"), score.alias("score"))
    scored = scored.groupBy("title", "method").agg(F.max("score").alias("score")).filter("score > 0")
    return minmax(scored, ["title"]).filter("score > 0")


def fuse(log: DataFrame, path: DataFrame, vsm: DataFrame, vsm_weight: float = 0.12, log_weight: float = 1.0, path_weight: float = 1.0) -> DataFrame:
    """Weighted sum of the normalised channels by dotted method name.

    A channel without rows adds nothing.  Zeros of the similarity channel make no entry.
    """
    part = lambda df, w: minmax(df, ["title"]).select("title", F.col("method"), (F.col("score") * w).alias("score"))
    similar = nonzero(part(vsm, vsm_weight)).withColumn("method", names.without_source_root(F.col("method")))
    every = part(log, log_weight).unionByName(part(path, path_weight)).unionByName(similar)
    return every.groupBy("title", names.dotted(F.col("method")).alias("method")).agg(F.sum("score").alias("score"))


def ranked(scores: DataFrame, keys: list[str], item: str = "method", top: int | None = None) -> DataFrame:
    """Rows with their ``rank`` within ``keys``: score descending, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), item)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def locations(ranking: DataFrame, top: int = 5) -> DataFrame:
    """``title, location``: the first methods of each report in order."""
    best = ranking.filter(F.col("rank") <= top).groupBy("title").agg(F.array_sort(F.collect_list(F.struct("rank", "method"))).alias("l"))
    return best.select("title", F.transform("l", lambda x: x["method"]).alias("location"))
