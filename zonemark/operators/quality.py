"""Cleaning feeds of codes, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..plans.registry import Registry, world_registry
from .order import numbered


def attribute_country(tagged: Column, file_countries: Column) -> Column:
    """A row's country: its own two-letter tag (UK is GB), else the only one of its file, else null."""
    t = F.upper(F.trim(tagged))
    own = F.when(t == "UK", "GB").when(t.rlike("^[A-Z]{2}$"), t)
    return F.coalesce(own, F.when(F.size(file_countries) == 1, F.get(file_countries, F.lit(0))))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are worked out once, whatever refers to them: the optimiser does not copy an
    expression through a generator."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_held")).select(*df.columns, *[F.col(f"_held.{n}").alias(n) for n in columns])


def with_codes(df: DataFrame, code: str, cc: str, key: str = "key", registry: Registry | None = None) -> DataFrame:
    """``df`` with the keys of its codes."""
    return _held(df, **{key: C.to_postal_code(code, F.col(cc), registry)})


def split_feed(df: DataFrame, code: str, cc: str, key: str = "key", registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose code was read, the others)."""
    rows = with_codes(df, code, cc, key, registry)
    return rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull()).drop(key)


def parse_rates(parsed: DataFrame, by: list[str], key: str = "key", weight: str | None = None) -> DataFrame:
    """Per group: values, values read, and the percentage."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    out = parsed.groupBy(*by).agg(F.sum(w).alias("n"), F.coalesce(F.sum(F.when(F.col(key).isNotNull(), w)), F.lit(0)).alias("read"))
    return out.withColumn("percent", F.round(F.lit(100.0) * F.col("read") / F.col("n"), 2))


def consistency(parsed: DataFrame, cc: str, key: str = "key", registry: Registry | None = None) -> DataFrame:
    """One row of counts of failures: text round trip, country, outcode idempotent and not above its code,
    binary round trip."""
    k, text = F.col(key), F.col("_text")
    rows = parsed.select(cc, F.explode(F.array(k)).alias(key)).filter(k.isNotNull())
    rows = _held(rows, _text=C.to_text(k, registry), _out=C.outcode(k, registry))
    again = _held(rows, _again=C.to_postal_code(text, None, registry), _out2=C.outcode("_out", registry))
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    return again.agg(
        F.count(F.lit(1)).alias("checked"),
        bad(F.col("_again") == k).alias("text_failures"),
        bad(C.country(k) == F.upper(F.col(cc))).alias("country_failures"),
        bad(F.col("_out").isNull() | ((F.col("_out") <= k) & (F.col("_out2") == F.col("_out")))).alias("outcode_failures"),
        bad(C.receive(C.send(k)) == k).alias("binary_failures"),
    )


def order_failures(parsed: DataFrame, key: str = "key", registry: Registry | None = None) -> DataFrame:
    """Distinct codes whose place by key and by text, within their country, differ. Both places are taken
    over all countries, one after the other, from ranges of the keys and of the texts."""
    rows = parsed.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_t", C.to_text(key, registry)).withColumn("_c", C.country(key))
    rows = numbered(numbered(rows, ["_c", key], "_a"), ["_c", "_t"], "_b")
    return rows.agg(F.count_if(F.col("_a") != F.col("_b")).alias("order_failures"))


def prefix_failures(parsed: DataFrame, lengths: list[int], key: str = "key", registry: Registry | None = None) -> DataFrame:
    """Text prefixes of codes for which the range has another number of codes than the text.

    Texts are tidied, so prefixes that end in a space are no fragments of their own. The UK format reads a
    fragment without a space as an area or a district, whatever texts begin so: its countries are held
    against outcode() by complete outcodes, and against the text by fragments with a space.
    """
    from .joins import prefix_counts

    reg = registry or world_registry()
    british = F.substring("_t", 1, 2).isin([c for c in reg.countries() if reg.format_name(c) == "GB"])
    rows = parsed.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_t", C.to_text(key, registry))
    rows = _held(rows, _out=F.when(british, C.to_text(C.outcode(key, registry), registry)))
    prefix = [F.when(F.length("_t") >= n, F.substring("_t", 1, n)) for n in lengths]
    prefix = [F.when(~p.endswith(" ") & (~british | p.contains(" ")), p) for p in prefix]
    by_text = rows.select(F.explode(F.array(*prefix, F.col("_out"))).alias("fragment"))
    by_text = by_text.filter("fragment is not null").groupBy("fragment").agg(F.count(F.lit(1)).alias("by_text"))
    by_range = prefix_counts(rows, by_text, key, "fragment", registry).withColumnRenamed("n", "by_range")
    return by_text.join(by_range, "fragment").filter("by_text <> by_range")


def reject_shapes(parsed: DataFrame, code: str, cc: str, key: str = "key", top: int = 5) -> DataFrame:
    """The most frequent shapes (letters A, digits N) of what was not read, ``top`` a country."""
    shape = F.regexp_replace(F.regexp_replace(F.upper(F.trim(code)), "[A-Z]", "A"), "[0-9]", "N")
    counts = parsed.filter(F.col(key).isNull()).groupBy(cc, shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("example"))
    rank = F.row_number().over(Window.partitionBy(cc).orderBy(F.desc("n"), "shape"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)
