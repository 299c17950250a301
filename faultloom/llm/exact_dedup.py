"""Exact deduplication by a distributed content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally inside
each partition, and compared in full with their neighbours; of equal neighbours the
first in the order of ids stays.

Scale.  Splitters are sampled from a bounded key (first and last characters, length, two
hashes and the id), so the sample never carries whole texts to the driver.  Each text
is shuffled once.  The id is the last part of the key, so the copies of a hot text
spread over as many partitions as their share of the rows asks for (unless they have one
id, or none, in common); such a run of equal texts is cut at partition edges only.  A partition has one first and one last run, so
the cut runs are put together from at most two small rows a partition, which is a proven
bound for their broadcast.  A task keeps one text and the ids of one run, 8 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest128, materialize, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def sorted_texts(docs: DataFrame, id_col: str, text_col: str, keep: str, edge_chars: int) -> DataFrame:
    """``id, content``: rows range-partitioned and sorted so that equal texts are neighbours.

    Inside a run of equal texts ids descend (``keep="min"``: ascend), null last.
    """
    text = text_or_empty(text_col)
    content = ascii_lower(text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        ascii_lower(F.left(text, F.lit(edge_chars))).alias("head"),
        F.length(text).alias("chars"),
        ascii_lower(F.right(text, F.lit(edge_chars))).alias("tail"),
        content.cast("binary").alias("content"),
    )
    first, second = digest128(F.col("content"))
    rows = rows.withColumns({"h1": first, "h2": second})
    best_first = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    keys = ["head", "chars", "tail", "h1", "h2"]
    return rows.repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "content", best_first).select("id", "content")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their run's best id, size, digest and number, and whether it touches the partition's edge."""
    names = ["row_id", "keep_id", "group_size", "text_sha256", "part", "edge"]
    part = TaskContext.get().partitionId()
    content, lots, first = None, [], True

    def run(edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(lots)
        n = len(ids)
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        digest = hashlib.sha256(content).hexdigest()
        best = pa.repeat(ids[0], n)
        return pa.RecordBatch.from_arrays(
            [ids, best, same(n, pa.int64()), same(digest, pa.string()), same(part, pa.int32()), same(edge, pa.bool_())], names
        )

    def merged(done: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    for batch in batches:
        ids, texts, done, start = batch.column(0), batch.column(1), [], 0
        for i, text in enumerate(texts):
            text = text.as_py()
            if text != content:
                if content is not None:
                    if i > start:
                        lots.append(ids.slice(start, i - start))
                    done.append(run(first))
                    first = False
                content, lots, start = text, [], i
        if batch.num_rows > start:  # copied, since a slice would keep the batch and its texts
            lots.append(ids.slice(start).take(pa.array(range(batch.num_rows - start))))
        if done:
            yield merged(done)
    if content is not None:
        yield run(True)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", edge_chars: int = 64
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z.  A null text
    counts as empty, and all empty texts are one group.  Of a group the row with
    the largest id stays (``keep="min"``: the smallest); if that id occurs on
    several rows of the group, each of them is marked kept.  A null id never wins
    against another id; in a group of null ids only, ``keep_id`` is null and every
    row is kept.  An empty table gives an empty result, and further columns of the
    input, whatever their names, are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"row_id {kind}, keep_id {kind}, group_size long, text_sha256 string, part int, edge boolean"
    rows = materialize(sorted_texts(docs, id_col, text_col, keep, edge_chars).mapInArrow(_runs, shape), "runs")
    best = F.max if keep == "max" else F.min
    # One row for each run at an edge, then one for each text that has such runs.
    cut = rows.filter("edge").groupBy("text_sha256", "part").agg(best("keep_id").alias("keep_id"), F.max("group_size").alias("size"))
    cut = cut.groupBy("text_sha256").agg(best("keep_id").alias("whole_id"), F.sum("size").alias("whole_size"))
    out = rows.join(F.broadcast(cut.withColumn("edge", F.lit(True))), ["text_sha256", "edge"], "left")
    keep_id = F.when(F.col("edge"), F.col("whole_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("row_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(F.col("edge"), F.col("whole_size")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.col("row_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
