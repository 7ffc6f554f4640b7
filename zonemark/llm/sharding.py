"""Proportional stratified interleaving into shards (operator 8).

Rows of each source are put in a seeded random order; the row of rank r of n has the fractional rank
(r + 1/2) / n.  All rows are then sorted by fractional rank and cut into ``shards`` equal runs, so
any run, and any shard, holds the sources in the proportions of the whole.  Law: ``rows``.

Ranks come from range-partitioned sorts and the row counts of their partitions, so a source with a
third of all rows is spread over as many tasks as its rows need.  What is gathered is one count a
partition.

Defined cases: a null source is a source of its own; null texts have size 8 and the checksum of no
bytes; rows that are equal in all columns used are interchangeable; rows that share doc_id follow
their texts' checksum and size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import few, stored

_IN_PART = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the column ``name``: each row's place, from 0, in the order of the given columns."""
    spark = df.sparkSession
    part = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    counts = sorted((r["p"], r["n"]) for r in part.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    first = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_p long, _before long")
    # one row a partition of a sort: small whatever the input is
    at = part.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(first), "_p")
    return at.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit(_IN_PART))).drop("_m", "_p", "_before")


def seeded(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def shard_rows(
    docs: DataFrame,
    *,
    shards: int = 24,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; and the source."""
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("_s"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        seeded(seed, F.col(id_col)).alias("_h"),
    )
    tie = ["_h", "doc_id", "text_crc32", "size"]
    ranked = numbered(rows, ["_s", *tie], "_g")
    # a row a source: sent to the tasks while they are few, so that no source's rows meet in one
    strata = stored(ranked.groupBy("_s").agg(F.min("_g").alias("_lo"), F.count(F.lit(1)).alias("_n")), "strata")
    spread = ranked.join(few(strata), "_s").withColumn("_f", (F.col("_g") - F.col("_lo") + F.lit(0.5)) / F.col("_n"))
    placed = numbered(spread.drop("_g", "_lo", "_n"), ["_f", "_s", *tie], "_g")
    total = placed.count()
    shard = F.expr(f"_g * {shards} div {max(1, total)}")
    return placed.withColumn("_sh", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_sh").cast("int").alias("shard"),
        (F.col("_g") - F.expr(f"(_sh * {total} + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("_s") != "null", F.expr("substring(_s, 2)")).alias("source"),
    )


def oracle(shards: int = 24, seed: int = 17) -> str:
    """The query's rows in DuckDB's SQL; the checksum is worked out byte by byte."""
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS crc),
     d AS (SELECT doc_id, coalesce('=' || source, 'null') AS s, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
                  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM documents, t),
     f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS frac FROM d),
     g AS (SELECT *, row_number() OVER (ORDER BY frac, s, h, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * {shards} // n AS INTEGER) AS shard, CAST(g - ((g * {shards} // n) * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard,
       CASE WHEN s <> 'null' THEN substr(s, 2) END AS source FROM g"""
