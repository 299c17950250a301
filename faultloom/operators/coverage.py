"""Static test coverage from call facts, and the scores it gives."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .graph import closure, cut

# Where main and test code lies in each source layout (SQL LIKE patterns).
LAYOUTS = {
    "cassandra": (("src/java/%",), ("test/%",)),
    "hadoop021": (
        ("common/src/java/%", "hdfs/src/java/%", "mapred/src/java/%"),
        ("common/src/test/%", "hdfs/src/test/%", "mapred/src/test/%"),
    ),
    "hadoop023": (("%/src/main/java/%",), ("%/src/test/java/%",)),
    "hbase90": (("src/main/java/%",), ("src/test/java/%",)),
    "hbase95": (("%/src/main/java/%",), ("%/src/test/java/%",)),
    "zookeeper": (("src/java/main/%", "src/java/generated/%"), ("src/java/test/%", "src/java/systest/%")),
}
#: Tests' labels are broadcast if there are no more than these.
BROADCAST_LABELS = 100_000


def file_kind(callables: DataFrame, layout: str | Column) -> DataFrame:
    """``callables`` with ``is_main`` and ``is_test`` by their files and layout.

    ``layout`` names one for all rows, or is a column; rows of no known layout are neither.
    """
    layout = F.lit(layout) if isinstance(layout, str) else layout

    def placed(which: int) -> Column:
        out = F.lit(False)
        for name, patterns in LAYOUTS.items():
            out = out | ((layout == name) & functools.reduce(Column.__or__, (F.like("file", F.lit(p)) for p in patterns[which])))
        return F.coalesce(out, F.lit(False))

    return callables.withColumns({"is_main": placed(0), "is_test": placed(1)})


def method_listing(callables: DataFrame, pattern: str = "src/java/%") -> DataFrame:
    return callables.filter(F.like("file", F.lit(pattern))).select("class", "name")


def direct_edges(calls: DataFrame, constructions: DataFrame) -> DataFrame:
    """``src, dst``: method calls and constructor calls together, an edge as often as it is called."""
    part = lambda df: df.select(F.col("enclosing").alias("src"), F.col("callee").alias("dst"))
    return part(calls).union(part(constructions))


def covered_sites(sites: DataFrame, test_edges: DataFrame) -> DataFrame:
    """``enclosing, total, hit``: call sites of a method, and those some test calls too."""
    called = test_edges.select(F.col("dst").alias("callee")).distinct().withColumn("hit", F.lit(1))
    return (
        sites.select("id", "enclosing", "callee").distinct().join(called, "callee", "left")
        .groupBy("enclosing").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hit"))
    )


def coverage_summary(callables: DataFrame, sites: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per main method and test that reaches it, with covered call sites.

    ``callables`` as ``schemas.CALLABLE`` with ``is_main, is_test``; only what tests reach
    is closed over.  Edges may come more than once.

    The closure runs over the callables that call others.  Tests that reach the same of them
    are of one kind, told by their number and 128 bits of hashes, and all edges are met once
    for a kind, not for a test; only the rows of the result pair tests and methods.
    """
    label = F.concat_ws("@", F.concat_ws(".", "class", "name"), F.col("start_line").cast("string")).alias("coveringTest")
    tests = callables.filter("is_test")
    calling = cut(edges.select(F.col("src").alias("node")).distinct())
    starts = tests.select(F.col("id").alias("node")).join(calling, "node", "left_semi").distinct()
    within = closure(edges.join(calling.select(F.col("node").alias("dst")), "dst", "left_semi"), starts)
    alike = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("other"), "node")).alias("y")]
    signed = cut(within.groupBy("start").agg(*alike))
    kinds = cut(signed.join(signed.groupBy("n", "x", "y").agg(F.min("start").alias("kind")), ["n", "x", "y"]).select("start", "kind"))
    inner = within.join(kinds.select(F.col("kind").alias("start")).distinct(), "start").select(F.col("start").alias("kind"), "node")
    outer = inner.join(edges, inner["node"] == edges["src"]).select("kind", F.col("dst").alias("node"))
    # a test that calls nothing reaches itself, a row only if it counts as main code too
    alone = tests.filter("is_main").join(calling.withColumnRenamed("node", "id"), "id", "left_anti")
    nodes = inner.union(outer).union(alone.select("id", "id")).distinct()
    kind_of = kinds.union(alone.select("id", "id"))
    # tests of one label are one test
    labels = cut(
        tests.select(F.col("id").alias("start"), label).join(kind_of, "start")
        .groupBy("coveringTest").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    )
    counts = covered_sites(sites, edges.join(starts.select(F.col("node").alias("src")), "src", "left_semi"))
    main = callables.filter("is_main").select(F.col("id").alias("node"), F.col("file").alias("filePath"), F.concat_ws(".", "class", "signature").alias("methodSig"))
    rows = (
        labels.select("kinds").distinct().select("kinds", F.explode("kinds").alias("kind")).join(nodes, "kind").join(main, "node")
        .join(counts, F.col("node") == F.col("enclosing"), "left")
        .select("kinds", "filePath", "methodSig", F.coalesce("hit", F.lit(0)).cast("int").alias("internalCovered"), F.coalesce("total", F.lit(0)).cast("int").alias("internalTotal"))
        .distinct()
    )
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(labels) if few else labels, "kinds").drop("kinds")


def method_coverage(raw: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Best covered share of each method and the set of its tests."""
    share = F.when(F.col("internalTotal") == 0, 0.0).otherwise(F.col("internalCovered") / F.col("internalTotal"))
    return raw.groupBy(*keys, F.col("methodSig").alias("method_sig")).agg(
        F.max(share).alias("coverage"), F.array_sort(F.collect_set(names.test_label(F.col("coveringTest")))).alias("covering_tests")
    )


def inverse_coverage(methods: DataFrame, coverage: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``title, method, score``: the fewer tests reach a method, the higher.

    ``methods`` has ``title, method``.  The total starts at 1, as one test more than
    there are; methods are matched by simple key with dots for ``$``.
    """
    by_key = (
        coverage.select(names.after_last(names.dotted(names.signature_key(F.col("method_sig"))), ".").alias("key"), F.explode("covering_tests").alias("test"))
        .groupBy("key").agg(F.count_distinct("test").alias("tests"))
    )
    found = methods.distinct().withColumn("key", names.simple_key(F.col("method"))).join(by_key, "key", "left")
    counted = found.select("title", "method", F.coalesce("tests", F.lit(0)).alias("tests"))
    w = Window.partitionBy("title")
    total, n = 1 + F.sum("tests").over(w), F.count(F.lit(1)).over(w)
    score = 1 - (F.col("tests") + smoothing) / (total + smoothing * n)
    return counted.select("title", "method", score.alias("score")).filter("score > 0")


def ordered(raw: DataFrame) -> DataFrame:
    """Raw coverage in the order in which it is listed."""
    return raw.orderBy("filePath", "methodSig", "coveringTest")
