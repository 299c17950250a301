"""Pairwise TF-IDF similarity of token sets, as an inverted-index join.

Fitted on two sets of distinct tokens, smoothed TF-IDF with unit vectors has a closed
form in the size of the sets and of their intersection, so similarity is an equi-join
on tokens and a count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Square of the weight of a token that only one of the two sets has.
OWN = (1.0 + math.log(1.5)) ** 2


def pair_similarity(common: Column, left: Column, right: Column, digits: int = 4) -> Column:
    """Cosine of two sets with ``left`` and ``right`` tokens, ``common`` of them shared."""
    c = common.cast("double")
    return F.round(c / F.sqrt((c + (left - c) * F.lit(OWN)) * (c + (right - c) * F.lit(OWN))), digits)


def set_similarity(reports: DataFrame, segments: DataFrame, on: tuple[str, ...] = (), broadcast_rows: int = 0) -> DataFrame:
    """``report, segment, similarity`` of every pair that shares a token.

    ``reports`` has ``report, tokens``, ``segments`` has ``segment, tokens``; ``on`` names
    columns, such as the project, that must agree.  Both token arrays are sets.  With
    ``broadcast_rows`` the reports are broadcast if they have no more tokens than that.
    """
    left = reports.select(*on, "report", F.size("tokens").alias("n_left"), F.explode("tokens").alias("token"))
    right = segments.select(*on, "segment", F.size("tokens").alias("n_right"), F.explode("tokens").alias("token"))
    if broadcast_rows and left.limit(broadcast_rows + 1).count() <= broadcast_rows:
        left = F.broadcast(left)
    shared = right.join(left, [*on, "token"]).groupBy("report", "segment", "n_left", "n_right").agg(F.count(F.lit(1)).alias("common"))
    return shared.select("report", "segment", pair_similarity(F.col("common"), F.col("n_left"), F.col("n_right")).alias("similarity"))


def method_similarity(pairs: DataFrame, method_of: Column) -> DataFrame:
    """The best similarity over the segments of a method."""
    return pairs.groupBy("report", method_of.alias("method")).agg(F.max("similarity").alias("score"))
