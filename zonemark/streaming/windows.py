"""Codes in streams. All column functions are row by row and deterministic, so they work on streams as
they are; a stream keeps the registry that it was started with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.registry import Registry


def with_codes(stream: DataFrame, code: str, cc: str | None = None, key: str = "key", registry: Registry | None = None) -> DataFrame:
    return stream.withColumn(key, C.to_postal_code(code, cc, registry))


def counts_by_outcode(
    stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours", countries: list[str] | None = None, registry: Registry | None = None
) -> DataFrame:
    """Events of a tumbling window by outcode; events later than ``late`` are left out. Works on batches."""
    rows = stream.withWatermark(ts, late).withColumn("_out", C.outcode(key, registry, countries))
    out = rows.groupBy(F.window(ts, window).alias("w"), "_out").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), C.to_text("_out", registry, countries).alias("outcode"), "n")
