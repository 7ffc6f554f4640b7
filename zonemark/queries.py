"""Registered queries: codes are made from the integer keys of the driver's tables by expressions that
Spark and DuckDB read alike, go through the engine, and are held against plain SQL on the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import UK_AREAS, UK_UNIT_LETTERS
from .functions import columns as C
from .functions import ranges, uk
from .operators import joins, quality
from .operators.order import numbered
from .plans.language import resolve
from .plans.registry import world_registry
from .sources import tables
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Expressions over an integer k that both engines read.
def dig(e: str, n: int) -> str:
    return f"lpad(cast({e} as string), {n}, '0')"


def pick(letters: str, e: str, n: int = 1) -> str:
    return f"substr('{letters}', cast({e} as int), {n})"


CA1, CA2 = "ABCEGHJKLMNPRSTVXY", "ABCEGHJKLMNPRSTVWXYZ"
ZIP5, PLUS4 = dig("(k*7919+501)%100000", 5), dig("(k*31)%9999+1", 4)
US = f"({ZIP5} || case when k%3=0 then '-' || {PLUS4} else '' end)"
FSA = f"({pick(CA1, 'k%18+1')} || cast(k%10 as string) || {pick(CA2, '(k*7)%20+1')})"
LDU = f"(cast(k%10 as string) || {pick(CA2, '(k*11)%20+1')} || cast((k*3)%10 as string))"
CA = f"({FSA} || case when k%2=0 then ' ' || {LDU} else '' end)"
AREAS2 = "".join(f"{a:<2}" for a in UK_AREAS[:-1])
AREA = f"trim({pick(AREAS2, '(k%126)*2+1', 2)})"
SECTOR, WALK = "cast((k*3)%10 as string)", f"({pick(UK_UNIT_LETTERS, '(k*7)%20+1')} || {pick(UK_UNIT_LETTERS, '(k*11)%20+1')})"
OUT = f"({AREA} || cast(k%9+1 as string))"
UK = f"({OUT} || ' ' || {SECTOR} || {WALK})"
BR = f"({dig('(k*7919+501)%100000', 5)} || case when k%2=0 then '-' || {dig('(k*31)%1000', 3)} else '' end)"
IE = f"({pick('ACDEFHKNPRTVWXY', 'k%15+1')} || {dig('k%100', 2)} || case when k%2=0 then ' ' || {pick('0123456789ACDEFHKNPRTVWXY', 'k%25+1')} || {dig('(k*7)%1000', 3)} else '' end)"
FIVE = dig("(k*7919+501)%100000", 5)
CZ = f"(substr({FIVE}, 1, 3) || ' ' || substr({FIVE}, 4, 2))"
NL = f"(cast(k%9000+1000 as string) || case when k%2=0 then ' ' || {pick('ABCDE', 'k%5+1')} || {pick('GHJKL', '(k*3)%5+1')} else '' end)"
PL = f"({dig('k%100', 2)} || '-' || {dig('(k*7)%1000', 3)})"
TW = f"({dig('k%1000', 3)} || case when k%3=1 then '-' || {dig('k%100', 2)} when k%3=2 then '-' || {dig('k%1000', 3)} else '' end)"
MIXED_CC = "case k%6 when 0 then 'US' when 1 then 'GB' when 2 then 'CA' when 3 then 'PL' when 4 then 'NL' else 'CZ' end"
MIXED = f"case k%6 when 0 then {US} when 1 then {UK} when 2 then {CA} when 3 then {PL} when 4 then {NL} else {CZ} end"


def src(table: str, key: str) -> str:
    """The table's integer key as k, for DuckDB."""
    return f"(SELECT cast({key} as bigint) AS k FROM {table})"


CUSTOMER, ORDERS, PART, SUPPLIER, EVENTS = (
    ("customer", "c_custkey"),
    ("orders", "o_orderkey"),
    ("part", "p_partkey"),
    ("supplier", "s_suppkey"),
    ("events", "event_id"),
)


def table(spark: SparkSession, d: str, of: tuple[str, str]) -> DataFrame:
    return spark.read.parquet(f"{d}/{of[0]}.parquet").select(F.col(of[1]).cast("long").alias("k"))


def coded(spark: SparkSession, d: str, of: tuple[str, str], text: str, cc: str | None) -> DataFrame:
    """k, t (the text), key."""
    rows = table(spark, d, of).withColumn("t", F.expr(text))
    return rows.withColumn("key", C.to_postal_code("t", cc))


def mixed(spark: SparkSession, d: str, of: tuple[str, str] = CUSTOMER) -> DataFrame:
    rows = table(spark, d, of).withColumn("cc", F.expr(MIXED_CC)).withColumn("t", F.expr(MIXED))
    return quality.with_codes(rows, "t", "cc")


def _round_trip(name: str, of: tuple[str, str], text: str, cc: str, canonical: str | None = None, written: str | None = None) -> None:
    """A query that reads texts of one country and writes them again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = coded(spark, d, of, written or text, cc)
        return rows.select("k", C.to_text("key", countries=[cc]).alias("code"))

    run.__name__ = name
    query(f"SELECT k, '{cc}-' || {canonical or text} AS code FROM {src(*of)}")(run)


_round_trip("us_parse_render", CUSTOMER, US, "US")
_round_trip("ca_parse_render", CUSTOMER, CA, "CA", written=f"lower(replace({CA}, ' ', ''))")
_round_trip("br_parse", SUPPLIER, BR, "BR")
_round_trip("cz_render", PART, FIVE, "CZ", CZ)
_round_trip("lu_render", PART, dig("k%10000", 4), "LU", "'L-' || " + dig("k%10000", 4))
_round_trip("fr_cedex", PART, FIVE, "FR", written=f"{FIVE} || case when k%2=0 then ' cedex ' || {dig('k%20', 2)} else '' end")
_round_trip("ie_parse_render", PART, IE, "IE", written=f"replace({IE}, ' ', '')")
_round_trip("gb_parse_render", ORDERS, UK, "GB", written=f"lower(replace({UK}, ' ', ''))")
_round_trip("nl_parse_render", PART, NL, "NL", written=f"lower(replace({NL}, ' ', ''))")
_round_trip("pl_parse_render", PART, PL, "PL", written=f"replace({PL}, '-', ' ')")
_round_trip("tw_parse_render", PART, TW, "TW")


@query(
    f"""SELECT k, cast(658::HUGEINT*18014398509481984 + 281474976710656 + cast({ZIP5} as int)*16384::HUGEINT
        + case when k%3=0 then cast({PLUS4} as int) else 0 end - 9223372036854775808::HUGEINT as bigint) AS key FROM {src(*CUSTOMER)}"""
)
def us_key_bits(spark, d):
    return coded(spark, d, CUSTOMER, US, "US").select("k", "key")


@query(f"SELECT 'US-' || {ZIP5} AS outcode, count(*) AS n FROM {src(*CUSTOMER)} GROUP BY 1")
def us_outcode_count(spark, d):
    """The flagship: texts to keys, keys to outcodes, counts."""
    rows = coded(spark, d, CUSTOMER, US, "US").groupBy(C.outcode("key", countries=["US"]).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(C.to_text("o", countries=["US"]).alias("outcode"), "n")


@query(
    f"""SELECT count(*) FILTER (WHERE starts_with({US}, '9')) AS n9, count(*) FILTER (WHERE starts_with({US}, '90')) AS n90,
        count(*) FILTER (WHERE starts_with({US}, '08420')) AS n08420, count(*) FILTER (WHERE NOT starts_with({US}, '9')) AS other,
        cast(0 as bigint) AS bad FROM {src(*ORDERS)}"""
)
def us_prefix_count(spark, d):
    rows = coded(spark, d, ORDERS, US, "US")
    m = lambda f: F.count_if(C.match("key", f))
    return rows.agg(m("US-9").alias("n9"), m("US-90").alias("n90"), m("US-08420").alias("n08420"), F.count_if(C.not_match("key", "US-9")).alias("other"), m("US-9X").alias("bad"))


@query(
    f"""WITH o AS (SELECT {US} AS t FROM {src(*ORDERS)}), f AS (SELECT DISTINCT 'US-' || {ZIP5} || '-' AS fragment FROM {src(*SUPPLIER)})
        SELECT fragment, count(t) AS n FROM f LEFT JOIN o ON starts_with('US-' || t, fragment) GROUP BY 1"""
)
def us_plus4_fragment(spark, d):
    frags = table(spark, d, SUPPLIER).select(F.expr(f"'US-' || {ZIP5} || '-'").alias("fragment"))
    return joins.prefix_counts(coded(spark, d, ORDERS, US, "US"), frags, "key")


@query(f"SELECT k, 'CA-' || {FSA} AS outcode FROM {src(*CUSTOMER)}")
def ca_outcode(spark, d):
    rows = coded(spark, d, CUSTOMER, CA, "CA")
    return rows.select("k", C.to_text(C.outcode("key", countries=["CA"]), countries=["CA"]).alias("outcode"))


_ANY = "(chr(cast(65+k%26 as int)) || '1' || chr(cast(65+(k*7)%26 as int)) || ' 2' || chr(cast(65+(k*11)%26 as int)) || '3')"


@query(f"SELECT k, regexp_full_match({_ANY}, '[{CA1}]1[{CA2}] 2[{CA2}]3') AS ok FROM {src(*PART)}")
def ca_excluded_letters(spark, d):
    return table(spark, d, PART).select("k", C.is_valid_postal_code(F.expr(_ANY), "CA").alias("ok"))


@query(f"SELECT k, 'IE-' || substr({IE}, 1, 3) AS outcode FROM {src(*PART)}")
def ie_routing_key(spark, d):
    rows = coded(spark, d, PART, IE, "IE")
    return rows.select("k", C.to_text(C.outcode("key", countries=["IE"]), countries=["IE"]).alias("outcode"))


@query(f"SELECT k, 'GB-' || {OUT} AS outcode FROM {src(*ORDERS)}")
def gb_outcode(spark, d):
    rows = coded(spark, d, ORDERS, UK, "GB")
    return rows.select("k", C.to_text(C.outcode("key", countries=["GB"]), countries=["GB"]).alias("outcode"))


_UNIT = "('SW1A 1' || chr(cast(65+k%26 as int)) || chr(cast(65+(k//26)%26 as int)))"


@query(f"SELECT k, regexp_full_match({_UNIT}, 'SW1A 1[{UK_UNIT_LETTERS}]{{2}}') AS ok FROM {src(*PART)}")
def gb_letter_rules(spark, d):
    text = F.expr(_UNIT.replace("(k//26)", "(k div 26)"))
    return table(spark, d, PART).select("k", C.is_valid_postal_code(text, "GB").alias("ok"))


_GB = f"('GB-' || {UK})"


@query(
    f"""SELECT count(*) FILTER (WHERE starts_with({_GB}, 'GB-LS1 ')) AS ls1, count(*) FILTER (WHERE regexp_matches({_GB}, '^GB-LS[0-9]')) AS ls,
        count(*) FILTER (WHERE starts_with({_GB}, 'GB-M1 4')) AS m1_4, count(*) FILTER (WHERE regexp_matches({_GB}, '^GB-M[0-9]')) AS m FROM {src(*ORDERS)}"""
)
def gb_district_hierarchy(spark, d):
    rows = coded(spark, d, ORDERS, UK, "GB")
    return rows.agg(*[F.count_if(C.match("key", f)).alias(n) for f, n in (("GB-LS1", "ls1"), ("GB-LS", "ls"), ("GB-M1 4", "m1_4"), ("GB-M", "m"))])


def uk_rows(spark: SparkSession, d: str, of: tuple[str, str] = ORDERS) -> DataFrame:
    rows = table(spark, d, of).withColumn("t", F.expr(UK))
    return rows.withColumn("v", uk.uk_parse(F.col("t")))


@query(f"SELECT k, {UK} AS code FROM {src(*ORDERS)}")
def uk_parse_render(spark, d):
    return uk_rows(spark, d).select("k", uk.uk_to_text(F.col("v")).alias("code"))


@query(f"SELECT k, {AREA} || '/' || cast(k%9+1 as string) || '/' || {SECTOR} || {WALK} AS code FROM {src(*ORDERS)}")
def uk_to_char(spark, d):
    return uk_rows(spark, d).select("k", uk.uk_to_char(F.col("v"), "A/D/SW").alias("code"))


@query(
    f"""SELECT k, '{{"area":"' || {AREA} || '","district":"' || cast(k%9+1 as string) || '","sector":"' || {SECTOR} || '","walk":"' || {WALK} || '"}}' AS parts
        FROM {src(*ORDERS)}"""
)
def uk_parts(spark, d):
    return uk_rows(spark, d).select("k", uk.uk_parts(F.col("v")).alias("parts"))


@query(f"SELECT {OUT} || ' ' || {SECTOR} AS prefix, count(*) AS n FROM {src(*ORDERS)} GROUP BY 1")
def uk_prefix_of(spark, d):
    rows = uk_rows(spark, d)
    return rows.groupBy(uk.uk_prefix_of(F.col("v"), "sector").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


_UKFRAG = f"case k%5 when 0 then {AREA} when 1 then {OUT} when 2 then {OUT} || ' ' || {SECTOR} when 3 then {UK} else 'QQ' end"


@query(
    f"""SELECT k, k%5 <> 4 AS own, CASE k%5 WHEN 0 THEN starts_with({UK}, 'LS') AND NOT starts_with({UK}, 'LSX') ELSE regexp_matches({UK}, '^LS[0-9]') END AS ls
        FROM {src(*ORDERS)}"""
)
def uk_match(spark, d):
    rows = uk_rows(spark, d).withColumn("f", F.expr(_UKFRAG))
    return rows.select("k", uk.uk_match(F.col("v"), F.col("f")).alias("own"), uk.uk_match(F.col("v"), "LS").alias("ls"))


@query("SELECT cast(0 as bigint) AS disagreements")
def uk_match_range_agree(spark, d):
    rows, v = uk_rows(spark, d), F.col("v")
    bad = []
    for f in ("LS", "LS1", "M1 4", "SW1A", "B3 9", "L", "E1", "ZE1 0AA"):
        r = (v >= uk.uk_range_lower(f)) & (v < uk.uk_range_upper(f))
        bad.append((~r.eqNullSafe(uk.uk_match(v, f))).cast("int"))
    return rows.agg(F.sum(sum(bad[1:], bad[0])).cast("long").alias("disagreements"))


@query(
    f"""SELECT k, CASE WHEN {AREA} = 'LS' THEN 0 WHEN {AREA} < 'LS' THEN -1 ELSE 1 END AS area_cmp, -1 AS bad_cmp FROM {src(*PART)}"""
)
def uk_cmp_partial(spark, d):
    rows, v = uk_rows(spark, d, PART), F.col("v")
    return rows.select("k", uk.uk_cmp_partial(v, F.lit("LS")).alias("area_cmp"), uk.uk_cmp_partial(v, F.lit("not one")).alias("bad_cmp"))


@query(f"SELECT t, row_number() OVER (ORDER BY t) AS place FROM (SELECT DISTINCT {UK} AS t FROM {src(*PART)})")
def uk_sort_order(spark, d):
    rows = numbered(uk_rows(spark, d, PART).select("v").distinct(), ["v"], "place")
    return rows.select(uk.uk_to_text(F.col("v")).alias("t"), "place")


_DPS = "(cast(k%10 as string) || chr(cast(65+(k//10)%26 as int)))"


@query(f"SELECT k, regexp_full_match({_DPS}, '[1-9][{UK_UNIT_LETTERS}]') AS ok FROM {src(*PART)}")
def dps_validate(spark, d):
    return table(spark, d, PART).select("k", uk.dps_validate(F.expr(_DPS.replace("//", " div "))).alias("ok"))


@query(
    f"""SELECT t, row_number() OVER (ORDER BY t) AS place FROM (SELECT DISTINCT upper({_DPS}) AS t FROM {src(*PART)})
        WHERE regexp_full_match(t, '[1-9][{UK_UNIT_LETTERS}]')"""
)
def dps_order(spark, d):
    v = table(spark, d, PART).select(uk.dps_parse(F.lower(F.expr(_DPS.replace("//", " div ")))).alias("v")).filter("v is not null").distinct()
    return numbered(v, ["v"], "place").select(uk.dps_to_text(F.col("v")).alias("t"), "place")


@query(f"SELECT k, 'US-' || {US} AS code FROM {src(*SUPPLIER)}")
def tidy_unicode(spark, d):
    """Digits in other scripts, a minus sign for the hyphen, no-break spaces around."""
    odd = F.translate(F.expr(US), "0123456789-", "٠١٢٣٤５６７８９−")
    rows = table(spark, d, SUPPLIER).withColumn("t", F.concat(F.lit(" us – "), odd, F.lit(" ​\t")))
    return rows.select("k", C.to_text(C.to_postal_code("t"), countries=["US"]).alias("code"))


_MESSY = f"""case k%6 when 0 then {CA} when 1 then lower({CA}) when 2 then '  ' || {CA} || ' ' when 3 then replace({CA}, ' ', '-')
             when 4 then replace({CA}, ' ', '') else 'X' || {CA} end"""


@query(f"SELECT k, CASE WHEN k%6 < 5 THEN 'CA-' || {CA} END AS code FROM {src(*CUSTOMER)}")
def variants_messy(spark, d):
    return coded(spark, d, CUSTOMER, _MESSY, "CA").select("k", C.to_text("key", countries=["CA"]).alias("code"))


@query(
    f"""WITH t AS (SELECT {MIXED_CC} AS cc, {MIXED} AS t FROM {src(*CUSTOMER)}), c AS (SELECT * FROM (VALUES ('US'), ('GB'), ('CA'), ('PL'), ('NL'), ('CZ')) x(cc))
        SELECT cc, count(*) AS n, count(*) AS valid FROM t GROUP BY cc"""
)
def is_valid_report(spark, d):
    rows = table(spark, d, CUSTOMER).withColumn("cc", F.expr(MIXED_CC)).withColumn("t", F.expr(MIXED))
    return rows.groupBy("cc").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.is_valid_postal_code("t", F.col("cc"))).alias("valid"))


@query(f"SELECT {MIXED_CC} || '-' || {MIXED} AS code FROM {src(*CUSTOMER)} ORDER BY 1 LIMIT 50")
def country_order_topk(spark, d):
    return mixed(spark, d).orderBy(F.asc_nulls_last("key")).limit(50).select(C.to_text("key").alias("code"))


@query(f"SELECT {MIXED_CC} AS country, count(*) AS n FROM {src(*CUSTOMER)} GROUP BY 1")
def mixed_country_count(spark, d):
    return mixed(spark, d).groupBy(C.country("key").alias("country")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k, cast(k%100*1000 + (k*7)%1000 as bigint) AS rank FROM {src(*PART)}")
def pl_rank(spark, d):
    return coded(spark, d, PART, PL, "PL").select("k", C.payload("key").alias("rank"))


@query(f"SELECT k, cast(k%9000*398 as bigint) AS rank FROM {src(*PART)}")
def nl_rank(spark, d):
    return coded(spark, d, PART, "cast(k%9000+1000 as string)", "NL").select("k", C.payload("key").alias("rank"))


@query(
    f"""SELECT k, cast((k%1000)*1101 + case k%3 when 0 then 0 when 1 then 1 + (k%100)*11 else 1 + ((k%1000)//10)*11 + 1 + (k%1000)%10 end as bigint) AS rank
        FROM {src(*PART)}"""
)
def tw_rank(spark, d):
    return coded(spark, d, PART, TW, "TW").select("k", C.payload("key").alias("rank"))


@query(f"SELECT k, cast(((k*7919+501)%100000)*10001 + case when k%3=0 then (k*31)%9999+2 else 0 end as bigint) AS rank FROM {src(*PART)}")
def zip4_template_rank(spark, d):
    """A country that is given a template of its own."""
    reg = world_registry().add_country_template("XZ", "NNNNN[-NNNN]")
    rows = table(spark, d, PART).select("k", C.to_postal_code(F.expr(US), "XZ", reg).alias("key"))
    return rows.select("k", C.payload("key").alias("rank"))


@query(f"SELECT k, 'NL-' || substr({NL}, 1, 4) AS outcode FROM {src(*ORDERS)}")
def pattern_outcode(spark, d):
    return coded(spark, d, ORDERS, NL, "NL").select("k", C.to_text(C.outcode("key", countries=["NL"]), countries=["NL"]).alias("outcode"))


@query(
    f"""SELECT count(*) FILTER (WHERE starts_with({NL}, '10')) AS n10, count(*) FILTER (WHERE starts_with({NL}, '1012')) AS n1012,
        count(*) FILTER (WHERE starts_with({NL}, '1012 ')) AS n1012_ FROM {src(*ORDERS)}"""
)
def pattern_prefix_range(spark, d):
    rows = coded(spark, d, ORDERS, NL, "NL")
    return rows.agg(*[F.count_if(C.match("key", f"NL-{f}")).alias(n) for f, n in (("10", "n10"), ("1012", "n1012"), ("1012-", "n1012_"))])


_FRAGS = [("US-0",), ("US-08",), ("US-084",), ("US-9",), ("US-99999",), ("GB-LS1 ",), ("US-12345-",), ("CA-K",)]


@query(
    f"""WITH o AS (SELECT 'US-' || {US} AS t FROM {src(*ORDERS)}), f(fragment) AS (VALUES ('US-0'), ('US-08'), ('US-084'), ('US-9'), ('US-99999'), ('GB-LS1 '), ('US-12345-'), ('CA-K'))
        SELECT fragment, count(t) AS n FROM f LEFT JOIN o ON starts_with(t, fragment) GROUP BY fragment"""
)
def prefix_join(spark, d):
    frags = spark.createDataFrame(_FRAGS, "fragment string")
    return joins.prefix_counts(coded(spark, d, ORDERS, US, "US"), frags, "key")


@query(
    f"""WITH o AS (SELECT k, 'US-' || {US} AS t FROM {src(*ORDERS)}), f AS (SELECT DISTINCT 'US-' || substr({ZIP5}, 1, 3) AS fragment FROM {src(*SUPPLIER)})
        SELECT k, fragment FROM f JOIN o ON starts_with(t, fragment)"""
)
def prefix_join_lenient(spark, d):
    """Fragments that are none match nothing; by cells, as with very many fragments."""
    frags = table(spark, d, SUPPLIER).select(F.expr(f"'US-' || substr({ZIP5}, 1, 3)").alias("fragment")).distinct()
    frags = frags.unionByName(spark.createDataFrame([("US-12A",), ("nothing",), ("",)], "fragment string"))
    rows = coded(spark, d, ORDERS, US, "US").select("k", "key")
    return joins.prefix_join(rows, frags, "key", compared_fragments=0).select("k", "fragment")


@query(
    """SELECT * FROM (VALUES ('US-9', 'US-90', true, true, false, false), ('US-90', 'US-91', false, false, true, true), ('US-90', 'US-92', false, false, false, true),
       ('GB-ZE', 'GB-GX', false, false, true, true), ('CA-K', 'CA-K1A', true, true, false, false)) t(a, b, contains, "overlaps", adjacent, before)"""
)
def range_operators(spark, d):
    pairs = [("US-9", "US-90"), ("US-90", "US-91"), ("US-90", "US-92"), ("GB-ZE", "GB-GX"), ("CA-K", "CA-K1A")]
    reg = world_registry()
    rows = [(a, b, *reg.prefix(a), *reg.prefix(b)) for a, b in pairs]
    df = spark.createDataFrame(rows, "a string, b string, al long, ah long, bl long, bh long")
    a, b = ranges.make(F.col("al"), F.col("ah")), ranges.make(F.col("bl"), F.col("bh"))
    return df.select(
        "a",
        "b",
        ranges.contains_range(a, b).alias("contains"),
        ranges.overlaps(a, b).alias("overlaps"),
        ranges.adjacent(a, b).alias("adjacent"),
        ranges.before(a, b).alias("before"),
    )


@query("SELECT * FROM (VALUES ('US-90000', 'US-92000'), ('US-95000', 'US-95100'), ('GB-LS0', 'GB-LU0')) t(lo, hi)")
def range_agg(spark, d):
    reg = world_registry()
    rows = [(1, *reg.prefix(f)) for f in ("US-90", "US-91", "US-905", "US-950", "GB-LS", "GB-LS1")]
    df = spark.createDataFrame(rows, "g int, lo long, hi long")
    return ranges.range_agg(df, ["g"]).select(C.to_text("lo").alias("lo"), C.to_text("hi").alias("hi"))


@query(f"SELECT 'GB-' || {AREA} AS prefix, count(*) AS n FROM {src(*ORDERS)} GROUP BY 1")
def group_by_level(spark, d):
    return joins.group_by_level(coded(spark, d, ORDERS, UK, "GB"), "key", "area", countries=["GB"])


@query(
    f"""SELECT k, '{{"zip5":"' || {ZIP5} || '","plus4":' || case when k%3=0 then '"' || {PLUS4} || '"' else 'null' end || '}}' AS parts FROM {src(*CUSTOMER)}"""
)
def parts_json(spark, d):
    return coded(spark, d, CUSTOMER, US, "US").select("k", C.parts("key", countries=["US"]).alias("parts"))


@query(f"SELECT k, substr({NL}, 1, 4) AS digits, CASE WHEN k%2=0 THEN substr({NL}, 6, 2) END AS letters FROM {src(*CUSTOMER)}")
def part_lookup(spark, d):
    rows = coded(spark, d, CUSTOMER, NL, "NL")
    return rows.select("k", C.part("key", "digits", countries=["NL"]).alias("digits"), C.part("key", "letters", countries=["NL"]).alias("letters"))


@query(
    f"""SELECT k, 1 AS ord, 'zip5' AS name, {ZIP5} AS piece FROM {src(*CUSTOMER)} UNION ALL
        SELECT k, 2, 'plus4', CASE WHEN k%3=0 THEN {PLUS4} END FROM {src(*CUSTOMER)}"""
)
def parts_explode(spark, d):
    rows = coded(spark, d, CUSTOMER, US, "US")
    pieces = F.array(*[C.part("key", n, countries=["US"]) for n in ("zip5", "plus4")])
    names = F.array(F.lit("zip5"), F.lit("plus4"))
    out = rows.withColumn("p", pieces).select("k", "p", F.posexplode(names).alias("pos", "name"))
    return out.select("k", (F.col("pos") + 1).alias("ord"), "name", F.get("p", F.col("pos")).alias("piece"))


@query(f"SELECT k, 'US-' || {US} AS code FROM {src(*CUSTOMER)} WHERE k%6=0")
def lock_enforce_ok(spark, d):
    rows = mixed(spark, d).filter("cc = 'US'").select("k", "key")
    return tables.lock_column(rows, "key", "US").select("k", C.to_text("key", countries=["US"]).alias("code"))


@query("SELECT format_name, cast(n as bigint) AS n FROM (VALUES ('BR', 1), ('CA', 1), ('CZ', 1), ('FR', 12), ('GB', 5), ('IE', 1), ('LU', 1), ('US', 1), ('pattern', 171)) t(format_name, n)")
def country_formats_view(spark, d):
    return world_registry().country_formats(spark).groupBy("format_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cast(250 as bigint) AS countries, cast(194 as bigint) AS with_format, cast(56 as bigint) AS without")
def world_view_counts(spark, d):
    w = world_registry().world(spark)
    return w.agg(F.count(F.lit(1)).alias("countries"), F.count("format").alias("with_format"), F.count_if(F.col("format").isNull()).alias("without"))


@query("SELECT * FROM (VALUES ('GB', 1, 'area'), ('GB', 2, 'district'), ('GB', 3, 'sector'), ('GB', 4, 'walk'), ('NL', 1, 'digits'), ('NL', 2, 'letters'), ('US', 1, 'zip5'), ('US', 2, 'plus4')) t(iso2, ord, name)")
def parts_view(spark, d):
    return world_registry().parts_frame(spark).filter(F.col("iso2").isin("GB", "NL", "US")).select("iso2", "ord", "name")


@query(f"SELECT {MIXED_CC} AS cc, count(*) AS n, cast(0 as bigint) AS differences FROM {src(*CUSTOMER)} GROUP BY 1")
def binary_roundtrip(spark, d):
    rows = mixed(spark, d).withColumn("again", C.receive(C.send("key")))
    return rows.groupBy("cc").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("again").eqNullSafe(F.col("key"))).alias("differences"))


@query(f"SELECT count(DISTINCT {US}) AS codes, min('US-' || {US}) AS lowest, max('US-' || {US}) AS highest FROM {src(*EVENTS)}")
def dedupe_codes(spark, d):
    rows = coded(spark, d, EVENTS, US, "US").agg(F.countDistinct("key").alias("codes"), F.min("key").alias("a"), F.max("key").alias("b"))
    return rows.select("codes", C.to_text("a", countries=["US"]).alias("lowest"), C.to_text("b", countries=["US"]).alias("highest"))


@query("SELECT cast(0 as bigint) AS lost, cast(0 as bigint) AS new")
def except_roundtrip(spark, d):
    a = coded(spark, d, CUSTOMER, US, "US").select("key")
    b = a.select(C.receive(C.send("key")).alias("key"))
    lost = a.exceptAll(b).agg(F.count(F.lit(1)).alias("lost"))
    return lost.join(b.exceptAll(a).agg(F.count(F.lit(1)).alias("new")))


_REJECT = "case k%4 when 0 then 'X' || cast(k%1000 as string) when 1 then cast(k%100 as string) when 2 then 'ab-12' else '' || cast(k%100000+100000 as string) || '9' end"


@query(
    f"""SELECT shape, n FROM (SELECT regexp_replace(regexp_replace(upper(trim({_REJECT})), '[A-Z]', 'A', 'g'), '[0-9]', 'N', 'g') AS shape, count(*) AS n
        FROM {src(*CUSTOMER)} GROUP BY 1) ORDER BY n DESC, shape LIMIT 5"""
)
def reject_shapes(spark, d):
    rows = table(spark, d, CUSTOMER).withColumn("t", F.expr(_REJECT)).withColumn("cc", F.lit("US")).withColumn("key", C.to_postal_code("t", "US"))
    return quality.reject_shapes(rows, "t", "cc").select("shape", "n")


@query(f"SELECT count(*) AS checked, cast(0 as bigint) AS text_failures, cast(0 as bigint) AS country_failures, cast(0 as bigint) AS outcode_failures, cast(0 as bigint) AS binary_failures FROM {src(*CUSTOMER)}")
def quality_summary(spark, d):
    return quality.consistency(mixed(spark, d), "cc")


@query(f"SELECT {MIXED_CC} AS cc, count(*) AS n, count(*) AS read, cast(100.0 as double) AS percent FROM {src(*CUSTOMER)} GROUP BY 1")
def parse_rates(spark, d):
    return quality.parse_rates(mixed(spark, d), ["cc"])


@query("SELECT cast(0 as bigint) AS order_failures")
def order_check(spark, d):
    return quality.order_failures(mixed(spark, d))


@query("SELECT cast(0 as bigint) AS failures")
def prefix_check(spark, d):
    return quality.prefix_failures(mixed(spark, d), [4, 5, 6, 7, 8, 9]).agg(F.count(F.lit(1)).alias("failures"))


@query(
    f"""SELECT country, outcode, count(*) AS n FROM (SELECT 'US' AS country, 'US-' || {ZIP5} AS outcode FROM {src(*SUPPLIER)}) GROUP BY ROLLUP (country, outcode)"""
)
def rollup_country_outcode(spark, d):
    rows = coded(spark, d, SUPPLIER, US, "US")
    rows = rows.select(C.country("key").alias("country"), C.to_text(C.outcode("key", countries=["US"]), countries=["US"]).alias("outcode"))
    return rows.rollup("country", "outcode").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'US-' || lpad(cast((user_id*7919+501)%100000 as varchar), 5, '0') AS outcode, count(*) AS n
       FROM events GROUP BY 1, 2"""
)
def tumbling_by_outcode(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("ts", F.col("user_id").cast("long").alias("k"))
    rows = rows.withColumn("key", C.to_postal_code(F.expr(US), "US"))
    out = windows.counts_by_outcode(rows, "ts", "key", countries=["US"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "outcode", "n")


@query(r"SELECT * FROM (VALUES ('NNNNN[-NNNN]', '\d{5}(-\d{4})?', 1000100000), ('NN-NNN', '\d{2}-\d{3}', 100000), ('X', '[0-9A-Z]', 36), ('/[1-9]\d{3}( [A-Z]{2})?/', '[1-9]\d{3}( [A-Z]{2})?', 6093000)) t(spec, regex, codes)")
def pattern_sizes(spark, d):
    from .plans.language import language

    specs = ["NNNNN[-NNNN]", "NN-NNN", "X", r"/[1-9]\d{3}( [A-Z]{2})?/"]
    rows = [(s, resolve(s), language(resolve(s)).size) for s in specs]
    return spark.createDataFrame(rows, "spec string, regex string, codes int")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return us_outcode_count(spark, d)


from . import queries_more  # noqa: E402,F401  registers its queries here
