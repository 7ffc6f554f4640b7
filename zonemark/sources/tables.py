"""Tables with code columns: locked columns, layouts that prefix searches can prune, binary files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.registry import Registry


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a step's rows in a store that all executors share: ``spark.checkpoint.dir``, or the
    warehouse where that is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{told.rstrip('/')}/zonemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written to its folders: for when the results have been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x").rsplit("/", 1)[0])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A step's rows, written and read again: what comes after sees them once and for all."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lock_column(df: DataFrame, key: str, cc: str) -> DataFrame:
    """Lock a column to a country: its values are checked when the result is computed, and the lock is
    kept in the column's metadata, also in Parquet files."""
    meta = {**df.schema[key].metadata, C.LOCK: C._literal_country(cc)}
    return df.withColumns({key: C.enforce(key, cc)}).withMetadata(key, meta)


def lock_failures(df: DataFrame, key: str, cc: str) -> DataFrame:
    """The rows that a lock would refuse."""
    return df.filter(F.col(key).isNotNull() & (C.country(key) != C._literal_country(cc)))


def locked_columns(df: DataFrame) -> dict[str, str]:
    """The locked columns of a frame and their countries."""
    return {f.name: f.metadata[C.LOCK] for f in df.schema if C.LOCK in f.metadata}


def columns_view(spark: SparkSession, tables: list[str]) -> DataFrame:
    """table, column, locked_to_country over some tables of the catalog."""
    rows = [(t, c, cc) for t in tables for c, cc in locked_columns(spark.table(t)).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, locked_to_country string")


def read_locked(df: DataFrame, column: str, cc: str, key: str = "key", registry: Registry | None = None) -> DataFrame:
    """A text column of bare or prefixed codes of one country as a locked column; other text is an error."""
    return lock_column(df.withColumn(key, C.postal_code(column, cc, registry)), key, cc)


def append_locked(df: DataFrame, path: str, like: DataFrame) -> None:
    """Append rows to a Parquet table under the locks of the table's columns."""
    for c, cc in locked_columns(like).items():
        df = lock_column(df, c, cc)
    df.select(like.columns).write.mode("append").parquet(path)


def upsert_locked(table: DataFrame, rows: DataFrame, on: list[str], path: str) -> DataFrame:
    """``table`` with ``rows`` in place of those that have the same values of ``on``, or besides them, under
    the locks of the table's columns; written to ``path``. Null values are equal here. Several of ``rows``
    with the same values are an error."""
    for c, cc in locked_columns(table).items():
        rows = lock_column(rows, c, cc)
    twice = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if twice.take(1):
        raise ValueError("rows to be put in have the same values twice")
    same = [table[c].eqNullSafe(rows[c]) for c in on]
    stays = table.join(rows, same, "left_anti")
    return _replaced(stays.unionByName(rows.select(table.columns)), table, path)


def update_locked(table: DataFrame, where: Column, values: dict[str, Column], path: str) -> DataFrame:
    """``table`` with new values in the rows for which a condition holds, under its locks."""
    out = table.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})
    return _replaced(out, table, path)


def delete_where(table: DataFrame, where: Column, path: str) -> DataFrame:
    return _replaced(table.filter(~F.coalesce(where, F.lit(False))), table, path)


def _replaced(rows: DataFrame, table: DataFrame, path: str) -> DataFrame:
    """A table's new state is a new folder: readers of the old one are not disturbed."""
    for c, cc in locked_columns(table).items():
        rows = lock_column(rows, c, cc)
    rows.select(table.columns).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_clustered(df: DataFrame, path: str, key: str, by_country: bool = True) -> None:
    """Write a table so that a prefix search reads little: split by country, ranges of keys to files,
    keys sorted within them."""
    rows = df.withColumn("country", C.country(key))
    out = rows.repartitionByRange("country", key).sortWithinPartitions("country", key)
    writer = out.write.mode("overwrite")
    (writer.partitionBy("country") if by_country else writer).parquet(path)


def read_tsv_codes(spark: SparkSession, path: str, column: int, cc: str | None, registry: Registry | None = None) -> DataFrame:
    """Lines of tab-separated text; the code is one of their fields."""
    lines = spark.read.text(path)
    field = F.get(F.split("value", "\t"), F.lit(column))
    return lines.select("value", field.alias("code"), C.to_postal_code(field, cc, registry).alias("key"))


_SIGNATURE = b"PGCOPY\n\xff\r\n\x00"


def _copy_rows(data: bytes) -> Iterator[list[bytes | None]]:
    """Rows of the binary format that databases of the PostgreSQL family write with COPY."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a binary COPY file")
    at = len(_SIGNATURE) + 4
    at += 4 + struct.unpack_from(">I", data, at)[0]
    while True:
        (n,) = struct.unpack_from(">h", data, at)
        at += 2
        if n < 0:
            return
        row: list[bytes | None] = []
        for _ in range(n):
            (size,) = struct.unpack_from(">i", data, at)
            at += 4
            row.append(None if size < 0 else data[at : at + size])
            at += max(0, size)
        yield row


def copy_image(rows: list[list[bytes | None]]) -> bytes:
    """A binary COPY file of some rows."""
    out = [_SIGNATURE, struct.pack(">II", 0, 0)]
    for r in rows:
        out.append(struct.pack(">h", len(r)))
        out += [struct.pack(">i", -1) if v is None else struct.pack(">i", len(v)) + v for v in r]
    return b"".join(out) + struct.pack(">h", -1)


def write_copy(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """The binary columns of ``df`` as binary COPY files of bounded size, each task its own.

    A file is one record of Spark's text writer, which writes bytes as they are: an image less its last
    byte, which the writer puts behind each record."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes | None]] = []

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([copy_image(held)[:-1]], pa.binary())], ["image"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(list(row))
                if len(held) == rows_per_file:
                    yield image()
                    held = []
        if held:
            yield image()

    images = df.select(*[F.col(c).cast("binary") for c in columns]).mapInArrow(run, "image binary")
    out = images.select(F.col("image").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", "\xff").text(path)


def read_copy(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Binary COPY files as binary columns, a file a task (``write_copy`` bounds their size); decode with
    uk_receive, dps_receive, receive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                held = []
                for row in _copy_rows(data):
                    held.append(row)
                    if len(held) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], columns)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{c} binary" for c in columns))


def extract_values(df: DataFrame, value: str, by: list[str], max_chars: int = 60) -> DataFrame:
    """Distinct written values with their counts: cut at semicolons, spaces squeezed, long ones left out."""
    one = df.select(*by, F.explode(F.split(value, ";")).alias("value"))
    one = one.withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " ")))
    one = one.filter((F.col("value") != "") & (F.length("value") <= max_chars))
    return one.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def extract_files(spark: SparkSession, path: str, out: str, value: str = "value", by: tuple[str, ...] = ("source", "country")) -> DataFrame:
    """Tagged values in CSV files with a header, extracted and counted, to CSV files; gives what was written."""
    rows = spark.read.option("header", True).csv(path)
    extract_values(rows, value, list(by)).write.option("header", True).mode("overwrite").csv(out)
    return spark.read.option("header", True).schema(", ".join([*(f"{c} string" for c in by), "value string", "n long"])).csv(out)
