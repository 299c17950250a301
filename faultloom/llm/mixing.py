"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key divided by its quality weight
(Efraimidis-Spirakis); sorted by that key within its source, documents are taken
while the prefix sum of their sizes stays within the source's token budget.  A
budget beyond the source's size takes whole epochs first and samples the rest.

Scale.  No source is sorted as a whole.  Keys are cut into ``buckets`` ranges of
equal probability; sizes are summed per range with map-side combine, and only the
running sums over ranges (at most ``buckets`` rows a source) and the rows inside a
range are ordered.  A hot source is thus spread over ``buckets`` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Share the total size among sources by weight, each at most ``max_epochs`` times its size.

    ``sizes`` has ``no_source boolean, site string, source_size long``, one row a
    source.  The water level at which the uncapped sources stop is found by running
    sums over the sources, ordered by where they reach their cap.
    """
    order = Window.orderBy("no_source", "site")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "site").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("sum_w", F.sum("w").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(by_cap), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("sum_w") - F.col("w_before")))
    )
    # The first source, in this order, whose cap is above the level ends the search.
    free = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))
    level = F.min(free).over(everything)["level"]
    return levels.withColumn("stop", level).select(
        "no_source",
        "site",
        "source_size",
        F.when(F.col("stop").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("stop") * F.col("w")))
        .alias("target"),
    )


def uniform(id_col: str, seed: int):
    """A reproducible number in (0, 1) from the id: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def label_weights(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Quality weights from labels: 2 for good, 0.5 for bad; others are left out."""
    return labels.select(
        id_col, F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight")
    ).filter(F.col("weight").isNotNull())


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: int = 17,
    buckets: int = 4096,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken, copies``.

    ``size`` is the number of words (runs of characters other than ASCII white
    space; a null text has 0), ``taken`` the words the mix takes from the document,
    repeats counted, ``copies`` how often it takes it.  ``quality`` has ``id_col`` and a positive ``weight``; documents
    without one weigh 1.  Sources are ordered by code point with null last.  The last
    document of a budget is taken if that brings the source nearer to its target.
    Rows with the same id count as separate documents; ties of the key go by id, then
    size.  An empty table gives an empty result; if all sizes are 0, so are targets.
    Only the named columns are read, so extra or clashing ones do no harm.  A null id
    draws by the text, so that such rows do not all have one key.  ``carry`` names
    columns that are handed through after the others, such as a row's own key.
    """
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("site"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col(id_col).cast("string"), F.md5(text.cast("binary"))).alias("draw"),
        *(F.col(c).alias(f"__{c}") for c in carry),
    )
    if quality is not None:
        weight = (
            quality.select(F.col(id_col).alias("id"), F.col("weight").cast("double"))
            .groupBy("id")
            .agg(F.max("weight").alias("weight"))
        )
        base = base.join(weight, "id", "left")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    key = -F.log(uniform("draw", seed)) / F.coalesce("weight", F.lit(1.0))
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).cast("int")
    base = materialize(base.withColumn("key", key).withColumn("bucket", bucket).drop("draw"), "mix")

    spot = ["no_source", "site", "bucket"]
    sums = base.groupBy(*spot).agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("no_source", "site").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("no_source", "site").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(
        targets, ["no_source", "site"]
    )
    inside = Window.partitionBy(*spot).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        base.withColumn("upto", F.sum("size").over(inside))
        .join(starts, spot)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("middle", 2 * (F.col("start") + F.col("upto")) - F.col("size"))
        .withColumn("copies", (F.col("epochs") + (F.col("middle") < 2 * F.col("rest")).cast("long")).cast("long"))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).alias("taken"),
            "copies",
            *(F.col(f"__{c}").alias(c) for c in carry),
        )
    )
