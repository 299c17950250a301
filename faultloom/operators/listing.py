"""Listings of versions, of classes with their methods, and of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = ("version", "class_ord", "method_ord")


def versions(reports: DataFrame) -> DataFrame:
    """``version, reports``: every version and how many reports name it, in order of names."""
    return reports.filter("version IS NOT NULL").groupBy("version").agg(F.count(F.lit(1)).alias("reports")).orderBy("version")


def with_versions(reports: DataFrame, listed: DataFrame) -> DataFrame:
    """``reports`` with the version listed for their title, null if none is.

    Of a title listed twice the first version by name counts, so no report is doubled.
    """
    return reports.drop("version").join(listed.groupBy("title").agg(F.min("version").alias("version")), "title", "left")


def missing_versions(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct versions of ``needed`` that ``present`` does not have."""
    return needed.select("version").distinct().join(present.select("version"), "version", "left_anti")


def class_listing(methods: DataFrame, calls: DataFrame, logs: DataFrame) -> DataFrame:
    """``version, class_ord, class, methods``: methods of a class in order, with calls and logs.

    Tables are as ``schemas.CG_METHOD``, ``CG_CALL`` and ``CG_LOG``.  A row holds what one
    source class has, so it is bounded by a source file.
    """
    def part(df: DataFrame, at: str, *columns: str) -> DataFrame:
        return df.groupBy(*_PLACE).agg(_in_order(at, *columns).alias(at))

    placed = methods.join(part(calls, "call_ord", "callee", "line"), list(_PLACE), "left").join(part(logs, "log_ord", "template", "level", "line"), list(_PLACE), "left")
    placed = placed.withColumnsRenamed({"call_ord": "calls", "log_ord": "logs"})
    return placed.groupBy("version", "class_ord", "class").agg(_in_order("method_ord", "method", "file", "line", "calls", "logs").alias("methods"))


def _in_order(at: str, *columns: str) -> Column:
    """The structs of a group by ``at``, without it."""
    rows = F.array_sort(F.collect_list(F.struct(at, *columns)), lambda a, b: F.when(a[at] < b[at], -1).when(a[at] > b[at], 1).otherwise(0))
    return F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in columns)))


def path_text(chain: Column) -> Column:
    """A path of methods as a JSON list."""
    return F.to_json(chain)
