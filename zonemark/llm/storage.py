"""Where steps leave what later steps read: always a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a stored table that is sent to all tasks; a larger one is joined by a shuffle.
FEW = 500_000
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in the one named in ``spark.checkpoint.dir``.  Where that is unset, one
    under /tmp if the session has a single machine, and an error if it has more."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    return f"{(told or 'file:///tmp/zonemark-shared').rstrip('/')}/zonemark-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that ``stored`` has written for this application: for when the results have been read."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its listeners hold on to the query that ended last, so one without a shuffle has to end first."""
    import gc

    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def batches(spark: SparkSession, rows: int) -> str:
    """Rows that go to workers at once from now on in this session; what it was before.  A batch of texts is
    held outside the executor's heap, some three times over."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    return before


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step's rows to the shared folder and read them again: lineage ends there, so a lost
    executor costs no more than the files it was writing.  Texts go to the step's workers in batches of
    ``BATCH_ROWS``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = batches(spark, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        batches(spark, int(before))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that is no longer read."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, f)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A ``stored`` table of a few narrow columns, marked to be sent to all tasks if its rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def parts_of(rows: DataFrame, text: str, part_bytes: int, least: int = 16) -> int:
    """How many parts of about ``part_bytes`` a table's texts make."""
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-total // part_bytes))
