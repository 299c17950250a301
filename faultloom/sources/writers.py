"""Writers of intermediate and final results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import coverage


def json_files(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def parquet_by(df: DataFrame, path: str, by: str, mode: str = "append") -> None:
    """Partitioned Parquet, one file a partition value and task."""
    df.repartition(F.col(by)).write.mode(mode).partitionBy(by).parquet(path)


def score_lines(df: DataFrame, path: str, digits: int | None = None, mode: str = "error") -> None:
    """``method: score`` lines per title, best first; with ``digits`` that many decimals, zeros too."""
    score = F.col("score") if digits is None else F.format_string(f"%.{digits}f", F.col("score").cast("double"))
    lines = df.repartition("title").sortWithinPartitions("title", F.desc("score"), "method").select("title", F.concat_ws(": ", "method", score.cast("string")).alias("value"))
    lines.write.mode(mode).partitionBy("title").text(path)


def total_scores(ranking: DataFrame, path: str, top: int = 5, mode: str = "error") -> None:
    """``title`` and the ``top`` methods of its ranking, best first, as one line of JSON a title."""
    best = F.array_sort(F.collect_list(F.struct("rank", "method", "score")))
    rows = ranking.filter(F.col("rank") <= top).groupBy("title").agg(best.alias("methods"))
    rows.select("title", F.transform("methods", lambda m: F.struct(m["method"].alias("method"), m["score"].alias("score"))).alias("methods")).write.mode(mode).json(path)


def missing_only(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose result does not exist yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def links_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("title", "link").write.mode(mode).option("sep", "\t").csv(path)


def file_safe(name: Column) -> Column:
    """A name with slashes and backslashes as underscores."""
    return F.translate(name, "/\\", "__")


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Metrics as lines of text, ``Overall`` last."""
    value = F.format_string("%s: Accuracy@N %.4f, MRR %.4f, reports %d", "system", "accuracy_at_n", "mrr", "count")
    return metrics.orderBy(F.col("system") == "Overall", "system").select(value.alias("value"))


def token_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """The tokens of a report's segments, one on a line and in order, a folder a title."""
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "tokens"))), lambda s: s["tokens"])), "\n")
    df.groupBy("title").agg(text.alias("value")).repartition("title").write.mode(mode).partitionBy("title").text(path)


def documents_by_name(df: DataFrame, path: str, stamp: str, mode: str = "append") -> None:
    """``name, text`` as a folder a document, the crawl's ``stamp`` before its safe name."""
    named = df.select(F.concat(F.lit(stamp + "_"), file_safe(F.col("name"))).alias("name"), F.col("text").alias("value"))
    named.repartition("name").write.mode(mode).partitionBy("name").text(path)


def coverage_csv(raw: DataFrame, path: str, mode: str = "error") -> None:
    """Raw coverage in its order, with a header, as ``readers.coverage_csv`` reads it."""
    coverage.ordered(raw).write.mode(mode).option("header", True).csv(path)
