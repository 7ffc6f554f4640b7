"""URL rules by a cascade of Bloom filters (operator 7), in DataFrame and SQL functions only.

A rule is a host and the start of a path; an empty start fits every path.  The keys a url could match are its host's suffixes joined
with the starts of its path of the lengths that rules have; all the keys of all urls are the key
universe.  For the allowing rules and for the blocking rules there is one cascade each: level 1 holds
the listed keys, level 2 those other keys of the universe that level 1 also accepts, level 3 the
listed keys that level 2 accepts, and so on until a level accepts nothing wrong.  The first level that
rejects a key tells, by its parity, whether the key is listed: for the keys of the universe that is
exact, and the pages meet no join.

All cascades' first levels meet the universe in one pass; later levels work on false positives only.  The
words of a cascade are a scalar subquery of the query that uses them, so what is held at once is bounded:
keys beyond ``MAX_LISTED`` are dealt by hash into groups of that size, each with cascades of its own over
its part of the universe, and each group is one more pass over the pages that keeps the longest rule so
far.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; a key both
allowed and blocked is blocked; a url that no rule fits is allowed (the cascades reject all its
keys); repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard, stored

#: Keys of a group's cascades: at 15 bits each some 8 MB of filter words.
MAX_LISTED = 4_000_000
#: The rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule for this url can have: host suffixes at label bounds, path starts."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    words: DataFrame  # one row, one array of 64-bit words
    bits: int
    hashes: int
    salt: int


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]


def _position(key: Column, i: int, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)) + F.lit(i) * F.xxhash64(F.lit(salt + 1), key).bitwiseAND(F.lit((1 << 40) - 1)), F.lit(bits))


def build_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the column ``key``: words of set bits, or-ed before and after one shuffle."""
    spark = keys.sparkSession
    bits = max(64, 64 * math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / max(1, count) * math.log(2)))
    hashes = min(hashes, 16)
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), i, salt, bits) for i in range(hashes)])).alias("p"))
    one = at.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    zero = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = one.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    return Level(stored(row, "bloom"), bits, hashes, salt)


def accepts(key: Column, words: Column, level: Level) -> Column:
    hit = F.lit(True)
    for i in range(level.hashes):
        p = _position(key, i, level.salt, level.bits)
        word = F.get(words, F.floor(p / 64).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
    return hit


def member(key: Column, words: list[Column], cascade: Cascade) -> Column:
    """Whether the cascade's list holds a key of its universe."""
    out = F.lit(len(cascade.levels) % 2 == 1)
    for k in range(len(cascade.levels) - 1, -1, -1):
        out = F.when(~accepts(key, words[k], cascade.levels[k]), F.lit(k % 2 == 1)).otherwise(out)
    return out


def build_cascades(lists: list[DataFrame], universe: DataFrame, *, rate: float = 0.001, salt: int = 0) -> list[Cascade]:
    """A cascade a list. ``lists`` and ``universe``: a column ``key`` each. The universe may hold repeated keys.

    Every level has hashes of its own and takes the keys that the last one was wrong about, a quarter of
    those before it or fewer, so there are as many levels as the logarithm of the false positives.
    """
    inside = [stored(x.select("key").filter(F.col("key").isNotNull()).distinct(), "listed") for x in lists]
    sizes = [x.count() for x in inside]
    of = lambda i, k: salt + 1000 * i + 2 * k
    first = [build_level(x, n, rate, of(i, 0)) if n else None for i, (x, n) in enumerate(zip(inside, sizes))]
    flags = [accepts(F.col("key"), x.words.scalar(), x) if x else F.lit(False) for x in first]
    names = [f"in{i}" for i in range(len(first))]
    kept = universe.select("key", *[f.alias(c) for f, c in zip(flags, names)]).filter(" or ".join(names))
    kept = stored(kept.distinct(), "accepted")  # the only pass over the universe
    out = []
    for i, level in enumerate(first):
        levels = [level] if level else []
        mine, other, n = inside[i], None, sizes[i]
        while n:
            if other is None:
                wrong = kept.filter(names[i]).select("key").join(inside[i], "key", "left_anti")
            else:
                levels.append(build_level(mine, n, 0.25, of(i, len(levels))))
                wrong = other.filter(accepts(F.col("key"), levels[-1].words.scalar(), levels[-1]))
            wrong = stored(wrong, "wrong")
            mine, other, n = wrong, mine, wrong.count()
        out.append(Cascade(tuple(levels)))
    discard(kept)
    return out


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", max_listed: int = MAX_LISTED) -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    lengths = [r[0] for r in rules.select(F.length("path")).filter(F.length("path") >= 0).distinct().collect()]  # at most a url's length
    keyed = rules.select(F.concat("host", "path").alias("key"), (F.col("verdict") == "block").alias("blocked"))
    keyed = stored(keyed.filter("key is not null").groupBy("key").agg(F.bool_or("blocked").alias("blocked")), "rules")
    groups = max(1, -(-keyed.count() // max_listed))
    group = F.pmod(F.xxhash64("key", F.lit(groups)), F.lit(groups))
    universe = rows.select(F.explode(candidates(F.col("host"), F.col("path"), lengths)).alias("key"))
    rows = rows.withColumn("_best", F.lit(None).cast("struct<n:int,key:string,blocked:boolean,allowed:boolean>"))
    for g in range(groups):
        mine, all_keys = (keyed, universe) if groups == 1 else (keyed.filter(group == g), universe.filter(group == g))
        block, allow = build_cascades([mine.filter("blocked"), mine.filter("not blocked")], all_keys, salt=1)
        names = [f"_b{k}" for k in range(len(block.levels))], [f"_a{k}" for k in range(len(allow.levels))]
        held = rows.select("*", *[x.words.scalar().alias(c) for x, c in zip(block.levels + allow.levels, names[0] + names[1])])
        bc, ac = [F.col(c) for c in names[0]], [F.col(c) for c in names[1]]
        keys = candidates(F.col("host"), F.col("path"), lengths)
        if groups > 1:
            keys = F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(groups)), F.lit(groups)) == g)
        verdicts = F.transform(
            keys,
            lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), member(k, bc, block).alias("blocked"), member(k, ac, allow).alias("allowed")),
        )
        best = F.array_max(F.filter(verdicts, lambda x: x["blocked"] | x["allowed"]))
        rows = held.select("page_id", "host", "path", F.greatest("_best", best).alias("_best") if groups > 1 else best.alias("_best"))
        if g + 1 < groups:
            rows = stored(rows, "judged")
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("_best.key").alias("rule"),
        F.when(F.coalesce(F.col("_best.blocked"), F.lit(False)), "block").otherwise("allow").alias("verdict"),
    )


def oracle(rules=RULES) -> str:
    """The query's rows in DuckDB's SQL."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(rh, rp, v) AS (VALUES {values}),
     s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
     f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
           FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id"""
