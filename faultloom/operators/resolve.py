"""Resolving simple type names and qualifiers, as prioritised look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

# Core classes known by simple name.
CORE_CLASSES = {
    "System": "java.lang.System", "Thread": "java.lang.Thread", "Object": "java.lang.Object", "String": "java.lang.String",
    "Integer": "java.lang.Integer", "Long": "java.lang.Long", "List": "java.util.List", "Map": "java.util.Map",
    "Set": "java.util.Set", "ArrayList": "java.util.ArrayList", "HashMap": "java.util.HashMap", "PrintStream": "java.io.PrintStream",
}


def resolve_types(uses: DataFrame, inner: DataFrame, declared: DataFrame, imports: DataFrame, project: DataFrame) -> DataFrame:
    """``uses`` (``class, package, name``) with ``resolved``, the full name.

    Tried in turn: core classes; inner classes of the class (``inner``: ``class, name``);
    classes of the file (``declared``: ``class, name``); single imports (``imports``:
    ``class, path, wildcard, static``); wildcard imports of project packages (``project``:
    ``package, name``); the own package; else the own package's name or an unknown one.
    """
    core = F.create_map(*(F.lit(x) for kv in CORE_CLASSES.items() for x in kv))
    plain = imports.filter(~F.col("static"))
    single = (
        plain.filter(~F.col("wildcard")).select("class", F.substring_index("path", ".", -1).alias("name"), "path")
        .groupBy("class", "name").agg(F.min("path").alias("imported"))
    )
    wild = (
        plain.filter("wildcard").select("class", F.regexp_replace("path", r"\.\*$", "").alias("package"))
        .join(project.select("package", "name"), "package").groupBy("class", "name").agg(F.min(F.concat_ws(".", "package", "name")).alias("starred"))
    )
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = (
        uses.join(flag(inner, ["class", "name"], "is_inner"), ["class", "name"], "left")
        .join(flag(declared, ["class", "name"], "is_declared"), ["class", "name"], "left")
        .join(single, ["class", "name"], "left").join(wild, ["class", "name"], "left")
        .join(flag(project, ["package", "name"], "in_package"), ["package", "name"], "left")
    )
    own = F.when(F.coalesce(F.length("package"), F.lit(0)) > 0, F.concat_ws(".", "package", "name"))
    resolved = F.coalesce(
        core[F.col("name")],
        F.when(F.col("is_inner"), F.concat_ws("$", "class", "name")),
        F.when(F.col("is_declared"), F.coalesce(own, F.col("name"))),
        F.col("imported"), F.col("starred"), F.when(F.col("in_package"), own), own, F.concat(F.lit("unknown.package."), F.col("name")),
    )
    return out.select(*uses.columns, resolved.alias("resolved"))


def resolve_qualifiers(calls: DataFrame, variables: DataFrame, fields: DataFrame, types: DataFrame, returns: DataFrame) -> DataFrame:
    """``calls`` (``class, scope, qualifier, member``) with ``callee``.

    No qualifier, ``this`` and ``super`` mean the class; else the first part is a local
    variable (``variables``: ``scope, name, type``), a field (``fields``: ``class, name,
    type``) or a type (``types``: ``class, name, resolved``), and each further part the
    return type of that method (``returns``: ``owner, name, type``), as far as known.
    All parts are walked: there are as many rounds as the longest qualifier needs.
    """
    own = F.col("qualifier").isNull() | F.col("qualifier").isin("", "this", "super")
    parts = calls.withColumn("__own", own).withColumn("__parts", F.split(F.coalesce("qualifier", F.lit("")), r"\.")).withColumn("name", F.element_at("__parts", 1))
    base = (
        parts.join(variables.select("scope", "name", F.col("type").alias("__v")), ["scope", "name"], "left")
        .join(fields.select("class", "name", F.col("type").alias("__f")), ["class", "name"], "left")
        .join(types.select("class", "name", F.col("resolved").alias("__t")), ["class", "name"], "left")
        .withColumn("__type", F.when(F.col("__own"), F.col("class")).otherwise(F.coalesce("__v", "__f", "__t")))
    )
    longest = calls.agg(F.max(F.size(F.split("qualifier", r"\.")))).first()[0] or 0
    for k in range(2, longest + 1):
        step = returns.select(F.col("owner").alias("__type"), F.col("name").alias("__part"), F.col("type").alias("__next"))
        base = (
            base.withColumn("__part", F.get("__parts", F.lit(k - 1))).join(step, ["__type", "__part"], "left")
            .withColumn("__parts", F.when(F.col("__next").isNull(), F.slice("__parts", 1, k - 1)).otherwise(F.col("__parts")))
            .withColumn("__type", F.coalesce("__next", "__type")).drop("__next", "__part")
        )
        base = cut(base) if k % 8 == 0 else base  # bounds the plan of a very long chain
    callee = F.when(F.col("__type").isNull(), F.concat("class", F.lit(".unknown#"), "member")).otherwise(F.concat_ws("#", "__type", "member"))
    return base.select(*calls.columns, callee.alias("callee"))
