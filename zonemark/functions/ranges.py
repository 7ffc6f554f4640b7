"""Half-open ranges [lo, hi) of keys, as structs of two longs; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import country_bits


def make(lo: Column, hi: Column) -> Column:
    return F.named_struct(F.lit("lo"), lo, F.lit("hi"), hi)


def lower(r: Column) -> Column:
    return F.when(~isempty(r), r["lo"])


def upper(r: Column) -> Column:
    return F.when(~isempty(r), r["hi"])


def isempty(r: Column) -> Column:
    return r["lo"] >= r["hi"]


def lower_inc(r: Column) -> Column:
    return ~isempty(r)


def upper_inc(r: Column) -> Column:
    return F.when(r.isNotNull(), F.lit(False))


def contains(r: Column, key: Column) -> Column:
    """r @> key."""
    return (key >= r["lo"]) & (key < r["hi"])


def contains_range(a: Column, b: Column) -> Column:
    """a @> b; an empty range is in every range."""
    return isempty(b) | ((a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"]) & ~isempty(a))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return (a["lo"] < b["hi"]) & (b["lo"] < a["hi"]) & ~isempty(a) & ~isempty(b)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    return ((a["hi"] == b["lo"]) | (b["hi"] == a["lo"])) & ~isempty(a) & ~isempty(b)


def before(a: Column, b: Column) -> Column:
    """a << b."""
    return (a["hi"] <= b["lo"]) & ~isempty(a) & ~isempty(b)


def after(a: Column, b: Column) -> Column:
    """a >> b."""
    return before(b, a)


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b."""
    return (a["hi"] <= b["hi"]) & ~isempty(a) & ~isempty(b)


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b."""
    return (a["lo"] >= b["lo"]) & ~isempty(a) & ~isempty(b)


def equals(a: Column, b: Column) -> Column:
    return (isempty(a) & isempty(b)) | ((a["lo"] == b["lo"]) & (a["hi"] == b["hi"]))


def intersection(a: Column, b: Column) -> Column:
    """a * b; an empty range where they do not meet."""
    lo = F.greatest(a["lo"], b["lo"])
    return make(lo, F.greatest(lo, F.least(a["hi"], b["hi"])))


def union(a: Column, b: Column) -> Column:
    """a + b; an error if the result would not be one range."""
    whole = F.when(isempty(a), b).when(isempty(b), a).when(overlaps(a, b) | adjacent(a, b), merge(a, b))
    gap = F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("result of range union would not be contiguous")).cast("struct<lo:bigint,hi:bigint>"))
    return F.coalesce(whole, gap)


def merge(a: Column, b: Column) -> Column:
    """The smallest range over both."""
    both = make(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))
    return F.when(isempty(a), b).when(isempty(b), a).otherwise(both)


def difference(a: Column, b: Column) -> Column:
    """a - b; an error if the result would be two ranges."""
    split = (a["lo"] < b["lo"]) & (b["hi"] < a["hi"]) & ~isempty(b)
    gap = F.raise_error(F.lit("result of range difference would not be contiguous")).cast("struct<lo:bigint,hi:bigint>")
    left = F.when((b["lo"] <= a["lo"]), make(F.least(a["hi"], F.greatest(a["lo"], b["hi"])), a["hi"])).otherwise(make(a["lo"], F.least(a["hi"], b["lo"])))
    return F.when(split, gap).when(isempty(b), a).otherwise(left)


def range_agg(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The disjoint ranges that a group's ranges make up, one row each. Ranges lie within a country, so a
    group's countries are worked on apart."""
    rows = df.filter(F.col(lo) < F.col(hi)).withColumn("_c", country_bits(lo))
    w = Window.partitionBy(*by, "_c").orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(lo) > reach).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*by, "_c", "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("_c", "_island")


def multirange(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Per group the sorted array of its disjoint ranges."""
    flat = range_agg(df, by, lo, hi)
    return flat.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def range_intersect_agg(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    out = df.groupBy(*by).agg(F.max(lo).alias("lo"), F.min(hi).alias("hi"))
    return out.withColumn("hi", F.greatest("lo", "hi"))
