"""The whole localisation run: reports, sources and coverage to ranked methods."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LocalizationConfig
from ..functions import logs, names, text
from ..operators import coverage, graph, matching, scoring, vsm


@dataclass
class Inputs:
    """Tables of a run; see ``schemas`` for their columns."""

    reports: DataFrame  # REPORT
    methods: DataFrame  # project, method_path, code
    calls: DataFrame  # CG_CALL
    call_methods: DataFrame  # CG_METHOD
    templates: DataFrame  # CG_LOG with class
    coverage: DataFrame  # COVERAGE


def similarity_channel(inputs: Inputs, config: LocalizationConfig) -> DataFrame:
    """``title, method, score``: best similarity of a method's segments to the report."""
    tokens = lambda c: text.similarity_tokens(text.tokens(c, config.language))
    reports = inputs.reports.select(
        names.project_of(F.col("version")).alias("project"), F.col("title").alias("report"), tokens(text.report_text(F.col("title"), F.col("description"))).alias("tokens")
    )
    parts = text.segments(
        inputs.methods.select("project", "method_path", text.tokens(F.col("code"), config.language).alias("tokens")), size=config.segment_size
    ).select("project", F.struct("method_path", "segment_no").alias("segment"), text.similarity_tokens(F.col("tokens")).alias("tokens"))
    pairs = vsm.set_similarity(reports, parts, on=("project",))
    return vsm.method_similarity(pairs, F.col("segment.method_path")).select(F.col("report").alias("title"), "method", "score")


def report_events(inputs: Inputs) -> DataFrame:
    """Log events of reports with ``event_id`` in report order."""
    system = F.lower(names.system_of(names.project_of(F.col("version"))))
    lines = inputs.reports.select("title", "version", system.alias("system"), F.posexplode("logs").alias("log_pos", "line"))
    parsed = lines.select("title", "version", "log_pos", logs.log_fields(F.col("line"), F.col("system")).alias("e")).filter("e IS NOT NULL")
    return parsed.select("title", "version", "log_pos", F.struct("title", "log_pos").alias("event_id"), "e.class", "e.type", "e.content")


def frames(inputs: Inputs, causes_first: bool) -> DataFrame:
    """Kept frames of the traces: ``title, trace, pos, method``."""
    system = F.lower(names.system_of(names.project_of(F.col("version"))))
    traces = inputs.reports.select("title", system.alias("system"), F.posexplode("stack_traces").alias("trace", "raw"))
    raw = logs.causes_first(F.col("raw")) if causes_first else F.col("raw")
    lines = traces.select("title", "system", "trace", F.posexplode(F.split(raw, "\n")).alias("pos", "line"))
    kept = lines.filter(logs.frame_method(F.col("line")).isNotNull() & logs.frame_is_kept(F.col("line"), F.col("system")))
    return kept.select("title", "trace", "pos", logs.frame_method(F.col("line")).alias("method"))


def path_edges(inputs: Inputs, config: LocalizationConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of log paths, of stack chains, and the log methods of reports."""
    events = report_events(inputs)
    system = F.split(names.project_of(F.col("version")), "-")[0].alias("system")
    matched = graph.cut(matching.match_templates(events, inputs.templates).select("title", system, "log_pos", "method"))
    edges = graph.cut(graph.resolved_calls(inputs.calls, inputs.call_methods))
    callers = inputs.calls.select(F.col("method").alias("caller"), "callee").distinct()
    # A traversal never leaves the system under test; there are as many runs as systems.
    systems = sorted(r["system"] for r in matched.select("system").distinct().collect() if r["system"])
    own_of = lambda s: matched.filter((F.col("system") == s) & F.contains("method", F.lit(s))).select("title", "method").distinct()
    parts = [graph.execution_edges(graph.in_system(edges, s), own_of(s)) for s in systems]
    inner = functools.reduce(DataFrame.unionByName, parts) if parts else graph.execution_edges(edges, matched.select("title", "method").limit(0))
    chains = graph.upstream_chains(matched.select(F.col("method").alias("target")), callers, config.upstream_depth)
    own = matched.join(chains, matched["method"] == chains["target"]).select("title", "log_pos", "chain")
    if config.greedy_chains:
        own = graph.accepted_chains(own)
    log_edges = inner.unionByName(graph.chain_edges(own.select("title", "chain"))).distinct()
    following = F.lead("method").over(Window.partitionBy("title", "trace").orderBy("pos"))
    stack_edges = frames(inputs, causes_first=False).withColumn("dst", following).filter("dst IS NOT NULL").select("title", F.col("method").alias("src"), "dst").distinct()
    return log_edges, stack_edges, matched


def localize(inputs: Inputs, config: LocalizationConfig = LocalizationConfig()) -> DataFrame:  # noqa: B008
    """``title, rank, method, score`` of all methods any channel scores."""
    similar = graph.cut(similarity_channel(inputs, config))
    log_edges, stack_edges, matched = path_edges(inputs, config)
    lone = matched.select("title", "method").union(frames(inputs, False).select("title", "method")).distinct()
    ranks = graph.pagerank(log_edges.unionByName(stack_edges), config.damping, lone=lone)
    by_coverage = coverage.inverse_coverage(ranks.select("title", "method"), inputs.coverage, config.smoothing)
    path = scoring.path_scores(ranks, scoring.minmax(similar, ["title"]), by_coverage, config.path_vsm_share)
    log_nodes = graph.nodes_of(log_edges).union(matched.select("title", "method")).distinct()
    log = scoring.summed(scoring.stack_rank_scores(frames(inputs, True)), scoring.log_path_scores(log_nodes))
    fused = scoring.fuse(log, path, similar, config.vsm_weight, config.log_weight, config.path_weight)
    return scoring.ranked(fused, ["title"]).select("title", "rank", "method", "score")
