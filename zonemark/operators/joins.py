"""Joins of codes with fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.registry import Registry

#: Fragments that are compared with all codes of their country; more are met by cells.
COMPARED_FRAGMENTS = 256
#: Fragments whose cells are sent to all tasks, 17 a fragment at most; more are met by a shuffle.
BROADCAST_FRAGMENTS = 200_000


def resolve_fragments(fragments: DataFrame, fragment: str = "fragment", registry: Registry | None = None) -> DataFrame:
    """The distinct fragments with their ranges lo, hi; what is no fragment is left out."""
    one = fragments.select(fragment).distinct()
    r = C.to_postal_prefix(F.col(fragment), registry)
    return one.withColumn("_r", r).filter("_r is not null").select(fragment, F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"))


def _level(width: Column) -> Column:
    """The cell size, a power of 16, of which a range has at most 17."""
    return F.ceil(F.greatest(F.lit(0), F.floor(F.log2(width.cast("double"))) - 3) / 4).cast("int") * 4


def prefix_join(
    df: DataFrame,
    fragments: DataFrame,
    key: str,
    fragment: str = "fragment",
    how: str = "inner",
    registry: Registry | None = None,
    compared_fragments: int = COMPARED_FRAGMENTS,
    broadcast_fragments: int = BROADCAST_FRAGMENTS,
) -> DataFrame:
    """Rows of ``df`` with each row of ``fragments`` whose fragment their code begins with (how: inner), or
    all rows of ``fragments`` with the codes that begin so (how: left).

    A few fragments are sent to all tasks and hashed by country. More are cut into cells by the size of
    their range and met by an equi-join on cells, one for each size that occurs, so a row is compared with
    a few fragments only, and no country is too large for a task; the cells are sent to all tasks while
    they are few enough, so that the codes need not move.
    """
    resolved = fragments.join(resolve_fragments(fragments, fragment, registry), fragment)
    n = resolved.count()
    if n <= compared_fragments:
        k = F.col(key)
        cond = (C.country_bits(k) == C.country_bits("lo")) & (k >= F.col("lo")) & (k < F.col("hi"))
        inner = df.join(F.broadcast(resolved), cond).drop("lo", "hi")
    else:
        cells = resolved.withColumn("_level", _level(F.col("hi") - F.col("lo")))
        levels = sorted(r[0] for r in cells.select("_level").distinct().collect())  # at most 16
        cells = cells.withColumn("_cell", F.explode(F.sequence(_down("lo", "_level"), _down(F.col("hi") - 1, "_level"))))
        keyed = df.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_cell", _down(key, "_level"))
        inner = keyed.join(F.broadcast(cells) if n <= broadcast_fragments else cells, ["_level", "_cell"])
        inner = inner.filter((F.col(key) >= F.col("lo")) & (F.col(key) < F.col("hi"))).drop("_level", "_cell", "lo", "hi")
    if how != "left":
        return inner
    rest = fragments.join(inner.select(fragment).distinct(), fragment, "left_anti")
    return inner.unionByName(rest, allowMissingColumns=True)


def _down(key, level: str) -> Column:
    return F.call_function("shiftright", F.col(key) if isinstance(key, str) else key, F.col(level))


def prefix_counts(df: DataFrame, fragments: DataFrame, key: str, fragment: str = "fragment", registry: Registry | None = None) -> DataFrame:
    """Every fragment with the number of codes that begin with it. Codes are counted before they are
    joined, so equal ones meet a fragment once."""
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hits = prefix_join(counted, fragments.select(fragment).distinct(), key, fragment, "inner", registry)
    sums = hits.groupBy(fragment).agg(F.sum("_n").alias("n"))
    return fragments.select(fragment).distinct().join(sums, fragment, "left").select(fragment, F.coalesce("n", F.lit(0)).alias("n"))


def group_by_level(df: DataFrame, key: str, level: str, registry: Registry | None = None, countries: list[str] | None = None) -> DataFrame:
    """Counts by everything up to and including a named part, as text; codes without it are one group."""
    reg_text = C.to_text(key, registry, countries)
    end = C.part_end(key, level, registry, countries)
    return df.groupBy(F.substring(reg_text, F.lit(1), end + 3).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def group_by_range(df: DataFrame, key: str, level: str, registry: Registry | None = None, countries: list[str] | None = None) -> DataFrame:
    """Counts by the range of the codes that share a named part: lo, hi, n."""
    r = C.prefix_of(key, level, registry, countries)
    return df.select(r.alias("_r")).groupBy(F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
