"""Call graphs as edge tables: callers, chains, closures, PageRank.

Fixpoints are loops over tables on the driver; each round is a join with the frontier
only.  Lineage is cut through the checkpoint folder, so a lost executor costs a read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

#: Used only where the session names no checkpoint folder and driver and executors are one process.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the session's folder (a default one in tests)."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or LOCAL_CHECKPOINTS)
    return df.checkpoint()


def caller_map(calls: DataFrame) -> DataFrame:
    """``callee, callers``: distinct callers in order of name."""
    return calls.select("callee", F.col("method").alias("caller")).groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def upstream_chains(targets: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """``target, chain``: caller chains that end in the target, cycle-free, up to ``depth`` callers.

    ``edges`` has ``caller, callee``; the chain of the target alone is included.
    """
    level = targets.select(F.col("target"), F.array("target").alias("chain")).distinct()
    out = level
    e = edges.select("caller", "callee").distinct()
    for _ in range(depth):
        level = (
            level.withColumn("callee", F.element_at("chain", 1)).join(e, "callee")
            .filter(~F.array_contains("chain", F.col("caller")))
            .select("target", F.concat(F.array("caller"), "chain").alias("chain"))
        )
        out = out.unionByName(level)
    return out.distinct()


def closure(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``start, node``: what each start reaches, itself included (semi-naive)."""
    return _spread(cut(edges.select("src", "dst").distinct()), starts.select(F.col("node").alias("start"), "node"), most_rounds)


def _spread(e: DataFrame, reached: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``start, node`` rows and those that the edges ``e``, a checkpoint, lead to from them."""
    reached = cut(reached.distinct())
    frontier = reached
    for k in range(most_rounds):
        step = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        # frontiers are checkpoints: their union needs one of its own only now and then
        reached = reached.unionByName(frontier)
        reached = cut(reached) if k % 10 == 9 else reached
    return reached


def between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges on ways from any root to any root; ``roots`` has ``node``.

    All roots spread as one, so the work is in proportion to the edges, not to roots times nodes.
    """
    e = cut(edges.select("src", "dst").distinct())
    marked = roots.select(F.lit(0).alias("start"), "node")
    ahead = cut(e.join(_spread(e, marked).select(F.col("node").alias("src")), "src", "left_semi"))
    behind = _spread(cut(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), marked)
    return cut(ahead.join(behind.select(F.col("node").alias("dst")), "dst", "left_semi"))


def in_system(edges: DataFrame, system: str) -> DataFrame:
    """Edges whose both ends belong to the system: traversal never leaves it."""
    return edges.filter(F.contains("src", F.lit(system)) & F.contains("dst", F.lit(system)))


def resolved_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Call edges whose callee is the first method entry with its simple key.

    The entry's class must contain the callee's simple class name, which equal simple
    keys imply; the first in order of class and method wins.  Unknown callees stay leaves.
    """
    entries = methods.groupBy(names.simple_key(F.col("method")).alias("key")).agg(
        F.min_by("method", F.struct("class_ord", "method_ord")).alias("entry")
    )
    keyed = calls.select("method", "callee", names.simple_key(F.col("callee")).alias("key"))
    return keyed.join(entries, "key", "left").select(F.col("method").alias("src"), F.coalesce("entry", "callee").alias("dst")).distinct()


def execution_edges(edges: DataFrame, log_methods: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """``title, src, dst`` on ways from a report's log methods to log methods.

    ``log_methods`` has ``title, method``.  An edge stays if its source is reached from a
    log method of the title and its target reaches one; direct callers come on top.

    What is not between log methods is dropped before the closures, and titles with the same
    log methods are settled once: a title never meets all that its methods reach.
    """
    titles = cut(log_methods.filter("title IS NOT NULL").groupBy("title").agg(F.array_sort(F.collect_set("method")).alias("methods")))
    members = titles.select("methods").distinct().select("methods", F.explode("methods").alias("method"))
    roots = log_methods.select(F.col("method").alias("node")).distinct()
    edges = between(edges, roots)
    forward = closure(edges, roots)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    backward = closure(turned, roots).select(F.col("start").alias("goal"), F.col("node").alias("dst"))
    from_log = members.select("methods", F.col("method").alias("start")).join(forward, "start").select("methods", F.col("node").alias("src")).distinct()
    to_log = members.select("methods", F.col("method").alias("goal")).join(backward, "goal").select("methods", "dst").distinct()
    inner = edges.join(from_log, "src").join(to_log, ["methods", "dst"]).select("methods", "src", "dst").distinct()
    inner = titles.join(inner, "methods").select("title", "src", "dst")
    if callers is None:
        return inner
    above = log_methods.join(callers, log_methods["method"] == callers["callee"]).select("title", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return inner.unionByName(above).distinct()


def accepted_chains(chains: DataFrame) -> DataFrame:
    """Chains accepted one by one: longest first within a log method, methods in report order.

    ``chains`` has ``title, log_pos, chain`` (an array of methods).  A chain is accepted if
    its first method is in no chain accepted before for the title.  The fold runs over
    the chains of one report, which its log lines bound.
    """
    one = F.struct((F.col("log_pos")).alias("p"), (-F.size("chain")).alias("n"), F.col("chain").alias("c"))
    ordered = chains.groupBy("title").agg(F.array_sort(F.collect_list(one)).alias("all"))
    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc, x):
        new = ~F.array_contains(acc["seen"], F.element_at(x["c"], 1))
        taken = F.struct(F.array_union(acc["seen"], x["c"]).alias("seen"), F.concat(acc["out"], F.array(x["c"])).alias("out"))
        return F.when(new, taken).otherwise(acc)

    return ordered.select("title", F.explode(F.aggregate("all", empty, step, lambda a: a["out"])).alias("chain"))


def chain_edges(chains: DataFrame) -> DataFrame:
    """``title, src, dst`` of consecutive methods of chains."""
    pairs = F.arrays_zip(F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0))).alias("src"), F.slice("chain", 2, F.size("chain")).alias("dst"))
    return chains.select("title", F.explode(pairs).alias("e")).select("title", "e.src", "e.dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("title", F.col("src").alias("method")).union(edges.select("title", "dst")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, lone: DataFrame | None = None) -> DataFrame:
    """``title, method, pagerank`` of all titles' graphs at once.

    Mass of nodes without outgoing edge is spread evenly.  A title stops changing the
    test once its ranks move by less than ``tolerance`` times its nodes.  ``lone`` adds
    nodes without edges.  With ``tolerance`` 0 all ``rounds`` are made.
    """
    e = cut(edges.select("title", "src", "dst").distinct())
    every = nodes_of(e) if lone is None else nodes_of(e).union(lone.select("title", "method")).distinct()
    out = e.groupBy("title", "src").agg(F.count(F.lit(1)).alias("degree"))
    sizes = every.groupBy("title").agg(F.count(F.lit(1)).alias("nodes"))
    nodes = cut(
        every.join(sizes, "title").join(out.withColumnRenamed("src", "method"), ["title", "method"], "left")
        .select("title", "method", "nodes", F.coalesce("degree", F.lit(0)).alias("degree"))
    )
    ranks = nodes.withColumn("r", 1.0 / F.col("nodes"))
    for k in range(rounds):
        sent = (
            e.join(ranks.select("title", F.col("method").alias("src"), F.try_divide("r", "degree").alias("share")), ["title", "src"])
            .groupBy("title", F.col("dst").alias("method")).agg(F.sum("share").alias("got"))
        )
        loose = ranks.groupBy("title").agg(F.sum(F.when(F.col("degree") == 0, F.col("r")).otherwise(0.0)).alias("loose"))
        new = (
            ranks.join(sent, ["title", "method"], "left").join(loose, "title")
            .select(
                "title", "method", "nodes", "degree", F.col("r").alias("old"),
                ((1 - damping) / F.col("nodes") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("nodes"))).alias("r"),
            )
        )
        if tolerance > 0 or k % 3 == 2:
            new = cut(new)
        ranks = new
        if tolerance > 0:
            moving = new.groupBy("title").agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("d"), F.first("nodes").alias("n")).filter(F.col("d") >= F.col("n") * tolerance)
            if moving.isEmpty():
                break
        ranks = ranks.drop("old")
    return ranks.select("title", "method", F.col("r").alias("pagerank"))
