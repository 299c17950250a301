"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder and driver and executors are one process.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 8 << 20

#: What counts as white space between words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Tables that ``materialize`` wrote in this process, in order.
_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return jsc.getCheckpointDir().get().rstrip("/")


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python workers of ``BATCH_BYTES``, whatever the rows' size, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None) is None
    if own:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run, and
    several consumers do not compute the same thing again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/faultloom-{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """One row for each value of ``column``, bucketed and sorted by it: joins on it do not shuffle the table."""
    spark, kind = df.sparkSession, f"faultloom_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{kind}"
    count = shuffle_partitions(spark)
    one = df.repartition(count, column).dropDuplicates([column])
    with _small_batches(spark):
        one.write.bucketBy(count, column).sortBy(column).option("path", path).format("parquet").saveAsTable(kind)
    _written.append(path)
    found = spark.table(kind)
    found.schema  # resolved: what follows takes the name from the catalog, not the files
    spark.sql(f"DROP TABLE {kind}")
    return found


def written() -> int:
    """How many tables have been written so far; a mark for ``sweep``."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables written after the mark ``since``, but the last ``keep``.

    For callers that have written their result: a returned DataFrame still reads its
    tables, so queries leave theirs to the folder's retention.
    """
    end = len(_written) - keep
    for path in _written[since:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:end]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest128(*columns: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; together a 128-bit key."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7919), *columns)]
