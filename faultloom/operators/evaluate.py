"""Accuracy@N and mean reciprocal rank against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def first_hits(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """``title, first_hit``: the best rank that hits a true method, null if none does.

    ``truth`` has one row per title and method; names are compared by what follows the
    last dot (ranking) or the last slash (truth).  A title without ranking has no hit.
    """
    wanted = truth.select("title", names.after_last(F.col("method"), "/").alias("key")).distinct()
    hits = ranking.select("title", "rank", names.after_last(F.col("method"), ".").alias("key")).join(wanted, ["title", "key"])
    best = hits.groupBy("title").agg(F.min("rank").alias("first_hit"))
    return truth.select("title").distinct().join(best, "title", "left")


def metrics(hits: DataFrame, system: Column, n: int | None = 5) -> DataFrame:
    """``system, count, accuracy_at_n, mrr`` by system, and ``Overall``."""
    within = F.col("first_hit").isNotNull() if n is None else F.coalesce(F.col("first_hit") <= n, F.lit(False))
    one = hits.select(system.alias("system"), within.cast("double").alias("hit"), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr"))
    rolled = one.rollup("system").agg(
        F.count(F.lit(1)).alias("count"), F.avg("hit").alias("accuracy_at_n"), F.avg("rr").alias("mrr"), F.grouping("system").alias("g")
    )
    return rolled.select(F.when(F.col("g") == 1, "Overall").otherwise(F.col("system")).alias("system"), "count", "accuracy_at_n", "mrr")


def average_precision(hits: DataFrame) -> DataFrame:
    """Precision at the first hit, after which the search stops: the reciprocal rank."""
    return hits.select("title", F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("average_precision"))
