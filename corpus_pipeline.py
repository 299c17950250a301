"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the next stage's documents, the last one the packed pieces.  Each stage works on all
rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm import langid, line_dedup, minhash, mixing, packing
from faultloom.llm.common import materialize, sweep, table, written
from faultloom.llm.queries import default_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language must have this share of the score of all; below it a text is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, with null text, or in no language clearly.

    If the documents name no language, nothing can be learned and all rows with a
    letter stay.
    """
    model = langid.LanguageModel.fit(docs.filter(~langid.held_out("doc_id")))
    if not model.languages:
        return docs.select(*COLUMNS).filter(F.rlike("text", F.lit(r"\p{L}")))
    judged = langid.identify(docs, model, keep=COLUMNS[1:])
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source; ``n_chars`` follows the text."""
    left = line_dedup.drop_site_lines(docs.select(*COLUMNS), "text", "source")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that with the smallest id.

    Of rows that repeat the id that stays, one stays.
    """
    judged = minhash.near_duplicates(docs)
    gone = materialize(judged.filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    ids = docs.filter(F.col("doc_id").isNotNull()).agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] != ids[1]:
        known = left.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
        left = known.union(left.filter(F.col("doc_id").isNull()))
    return left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or drops documents so that sources reach their target weights.

    Each row is mixed for itself, also where ids are null or repeat: a written key, not
    the id, says which row the copies are of.
    """
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    copies = mixing.mix(rows, quality=weights, carry=("row",)).filter("copies > 0").select("row", "copies")
    repeated = rows.join(copies, "row")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; see ``faultloom.llm.packing.pack``."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL has no n-gram classifier, signature or tokenizer; tests check stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet before the next reads it."""
    docs, start = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        sweep(spark, start)  # the stage's own tables, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
