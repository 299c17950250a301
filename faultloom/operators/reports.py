"""Structured reports from the paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logs


def structured_reports(docs: DataFrame) -> DataFrame:
    """``file, title, description, logs, stack_traces`` of ``file, paras``.

    The first two paragraphs are title and description if there are more than one.  A
    log line closes an open trace; a stack line opens or continues one, from
    ``Caused by`` on if it has that; other lines continue an open trace if they name an
    exception, an error or a frame.
    """
    more = F.size("paras") > 1
    heads = docs.select(
        "file", F.when(more, F.trim(F.get("paras", F.lit(0)))).otherwise("").alias("title"), F.when(more, F.trim(F.get("paras", F.lit(1)))).otherwise("").alias("description")
    )
    line = F.translate(F.trim("line"), "　", " ")
    lines = docs.select("file", F.posexplode("paras").alias("pos", "line")).withColumn("line", line).filter("line <> ''")
    goes_on = F.rlike("line", F.lit(r"Exception|Error|at "))
    kept = logs.line_islands(lines, "file", "pos", logs.is_log_line(F.col("line")), logs.is_stack_line(F.col("line")), goes_on)
    cause = F.when(F.contains("line", F.lit("Caused by")), F.regexp_extract("line", r"(?s)(Caused by.*)$", 1)).otherwise(F.trim("line"))
    ordered = lambda text: F.array_sort(F.collect_list(F.struct("pos", text.alias("text"))))
    texts = lambda c: F.transform(c, lambda x: x["text"])
    log_lines = kept.filter("kind = 'log'").groupBy("file").agg(ordered(F.trim("line")).alias("l")).select("file", texts("l").alias("logs"))
    traces = kept.filter("kind = 'stack'").groupBy("file", "island").agg(ordered(cause).alias("l"), F.min("pos").alias("pos")).select("file", "pos", F.array_join(texts("l"), "\n").alias("text"))
    stacks = traces.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l")).select("file", texts("l").alias("stack_traces"))
    none = F.array().cast("array<string>")
    return heads.join(log_lines, "file", "left").join(stacks, "file", "left").select("file", "title", "description", F.coalesce("logs", none).alias("logs"), F.coalesce("stack_traces", none).alias("stack_traces"))


def totals(reports: DataFrame) -> DataFrame:
    """Documents, log lines and traces of a batch."""
    return reports.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("logs")).alias("logs"), F.sum(F.size("stack_traces")).alias("traces"))
