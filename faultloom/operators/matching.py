"""Matching log events to the methods whose templates could have written them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logs, names


def _level_fits() -> Column:
    return (F.col("type") == "UNKNOWN") | (F.lower("type") == F.lower("level"))


def match_templates(events: DataFrame, templates: DataFrame) -> DataFrame:
    """``events`` columns and the ``method`` of the last template that fits.

    ``events`` has ``event_id, class, type, content``; ``templates`` has ``class, method,
    template, level, class_ord, method_ord``.  Templates of the same simple class come
    first; events they leave over are matched against all other classes, where a
    template needs two characters besides its placeholders.  Events that nothing fits
    are left out.

    The first pass is an equi-join on the class.  The second is one on the level, which all
    templates have that of unknown events, and on the first word, which a template fixes
    if a blank follows it before any placeholder; those that fix none have no word, as
    has a second row of each event.
    """
    simple = lambda c: names.simple_key(F.col(c))
    ev = events.select("event_id", simple("class").alias("key"), "type", F.trim("content").alias("content"))
    head = F.substring_index(F.trim("template"), "{}", 1)
    tp = (
        templates.withColumn("template", F.coalesce("template", F.lit("{}"))).filter(F.length("template") > 0)
        .select(
            simple("class").alias("tkey"), "method", "template", F.lower("level").alias("level"), logs.template_like(F.col("template")).alias("like"),
            F.when(F.contains(head, F.lit(" ")), F.substring_index(head, " ", 1)).otherwise("").alias("word"), "class_ord", "method_ord",
        )
    )
    fits = F.expr("content LIKE like")
    last = F.max_by("method", F.struct("class_ord", "method_ord")).alias("method")
    own = ev.join(tp, (F.col("key") == F.col("tkey")) & _level_fits() & fits).groupBy("event_id").agg(last)
    over = ev.join(own, "event_id", "left_anti")
    solid = tp.filter(F.length(F.trim(F.replace("template", F.lit("{}"), F.lit("")))) >= 2)
    over = over.select(
        "event_id", "key", "content", F.when(F.col("type") == "UNKNOWN", F.col("type")).otherwise(F.lower("type")).alias("at_level"),
        F.explode(F.array_distinct(F.array(F.substring_index("content", " ", 1), F.lit("")))).alias("at_word"),
    )
    solid = solid.withColumn("level", F.explode(F.array("level", F.lit("UNKNOWN"))))
    on = (F.col("at_level") == F.col("level")) & (F.col("at_word") == F.col("word"))
    found = over.join(solid, on & (F.col("key") != F.col("tkey")) & fits).groupBy("event_id").agg(last)
    return events.join(own.union(found), "event_id")
