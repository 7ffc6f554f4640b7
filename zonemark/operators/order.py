"""Places in an order over all rows, without bringing them to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept

_IN_PART = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the column ``name``: each row's place, from 1, in the order of the given columns.

    Rows are dealt out by ranges and sorted within them; the number of rows of each range is all that is
    gathered.  Rows that are equal in these columns get places in any order.
    """
    spark = df.sparkSession
    part = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    counts = sorted((r["p"], r["n"]) for r in part.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    first = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_p long, _before long")
    at = part.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(first), "_p")  # a row a range
    return at.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit(_IN_PART)) + 1).drop("_m", "_p", "_before")
