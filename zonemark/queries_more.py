"""More registered queries: input that fails, binary forms, stored tables, changed registries, SQL names."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixed import DIGIT_ZEROS, UK_AREAS, UK_UNIT_LETTERS
from .functions import columns as C
from .functions import ranges, uk
from .operators import joins, quality
from .plans.language import language, same_codes, strip_names
from .plans.registry import CodeError, world_registry
from .queries import AREA, CUSTOMER, FIVE, MIXED, MIXED_CC, NL, ORDERS, OUT, PART, SECTOR, SUPPLIER, UK, US, WALK, ZIP5, coded, query, src, table, uk_rows
from .sources import sql, tables

US_KEY = "658::HUGEINT*18014398509481984 + 281474976710656 - 9223372036854775808::HUGEINT"

# A third of these texts are no codes.
BROKEN = f"case when k%9=0 then '?' || cast(k as string) when k%9=4 then '' when k%9=7 then 'QQQQQQQ' else {MIXED} end"
OK = "k%9 NOT IN (0, 4, 7)"


def broken(spark, d):
    rows = table(spark, d, CUSTOMER).withColumn("cc", F.expr(MIXED_CC)).withColumn("t", F.expr(BROKEN))
    return quality.with_codes(rows, "t", "cc")


@query(f"SELECT {MIXED_CC} AS cc, count(*) AS n, count(*) FILTER (WHERE {OK}) AS read, round(100.0 * count(*) FILTER (WHERE {OK}) / count(*), 2)::DOUBLE AS percent FROM {src(*CUSTOMER)} GROUP BY 1")
def parse_rates_broken(spark, d):
    return quality.parse_rates(broken(spark, d), ["cc"])


@query(f"SELECT k, {OK} AS valid FROM {src(*CUSTOMER)}")
def is_valid_broken(spark, d):
    rows = table(spark, d, CUSTOMER).withColumn("cc", F.expr(MIXED_CC)).withColumn("t", F.expr(BROKEN))
    return rows.select("k", C.is_valid_postal_code("t", F.col("cc")).alias("valid"))


@query(f"SELECT {MIXED_CC} AS cc, count(*) FILTER (WHERE {OK}) AS good, count(*) FILTER (WHERE NOT ({OK})) AS bad FROM {src(*CUSTOMER)} GROUP BY 1")
def split_good_rejects(spark, d):
    rows = table(spark, d, CUSTOMER).withColumn("cc", F.expr(MIXED_CC)).withColumn("t", F.expr(BROKEN))
    good, bad = quality.split_feed(rows, "t", "cc")
    both = good.select("cc", F.lit(1).alias("g")).unionByName(bad.select("cc", F.lit(0).alias("g")))
    return both.groupBy("cc").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad"))


@query(
    f"""SELECT count(*) FILTER (WHERE {OK}) AS checked, cast(0 as bigint) AS text_failures, count(*) FILTER (WHERE {OK} AND k%5=0) AS country_failures,
        cast(0 as bigint) AS outcode_failures, cast(0 as bigint) AS binary_failures FROM {src(*CUSTOMER)}"""
)
def quality_of_wrong_countries(spark, d):
    """A fifth of the rows are told to be of another country than their codes."""
    rows = broken(spark, d).withColumn("cc", F.when(F.col("k") % 5 == 0, "FR").otherwise(F.col("cc")))
    return quality.consistency(rows, "cc")


_WHY = "case k%5 when 0 then 'X' || cast(k as string) when 1 then 'AB1' when 2 then 'US-90210' when 3 then '90210' else '90210' end"
_WHY_CC = "case k%5 when 0 then 'US' when 1 then 'QQ' when 2 then 'GB' when 3 then null else 'US' end"


@query(
    f"""SELECT k, case k%5 when 0 then 'cannot parse "X' || k || '" as a US postal code' when 1 then '"QQ" is not a supported country code'
        when 2 then 'country code "GB" does not match the "US-" prefix of "US-90210"'
        when 3 then '"90210" has no country: no "CC-" prefix, and no country code was given' end AS why FROM {src(*CUSTOMER)}"""
)
def strict_reasons(spark, d):
    rows = table(spark, d, CUSTOMER).withColumn("t", F.expr(_WHY)).withColumn("cc", F.expr(_WHY_CC))
    return rows.select("k", C.why_not("t", F.col("cc")).alias("why"))


@query(f"SELECT k, '{{0}}' || {US} AS code FROM {src(*CUSTOMER)}".replace("{0}", "US-"))
def strict_constructor(spark, d):
    rows = table(spark, d, CUSTOMER).select("k", C.postal_code(F.expr(US), "US").alias("key"))
    return rows.select("k", C.to_text("key", countries=["US"]).alias("code"))


@query(f"SELECT k, case k%5 when 0 then 'GB' when 1 then 'FR' when 2 then null when 3 then 'DE' else 'DE' end AS country FROM {src(*CUSTOMER)}")
def country_attribution(spark, d):
    tag = F.expr("case k%5 when 0 then ' uk' when 1 then 'fr' when 2 then '' when 3 then 'Germany' else null end")
    file = F.expr("case when k%5 in (3, 4) then array('DE') else array('DE', 'AT') end")
    return table(spark, d, CUSTOMER).select("k", quality.attribute_country(tag, file).alias("country"))


@query(f"SELECT k, 'US-' || {US} AS code FROM {src(*CUSTOMER)}")
def respell_every_script(spark, d):
    """Digits of all scripts that are known, block by block."""
    t, out = F.expr(US), F.lit(None).cast("string")
    for n, zero in enumerate(DIGIT_ZEROS):
        out = F.when(F.col("k") % len(DIGIT_ZEROS) == n, F.translate(t, "0123456789", "".join(chr(zero + i) for i in range(10)))).otherwise(out)
    return table(spark, d, CUSTOMER).select("k", C.to_text(C.to_postal_code(out, "US"), countries=["US"]).alias("code"))


_FORMS = f"""case k%6 when 0 then lower({NL}) when 1 then replace({NL}, ' ', '-') when 2 then replace({NL}, ' ', '') when 3 then 'NL' || {NL}
             when 4 then 'nl-' || {NL} else ' ' || {NL} || '  ' end"""


@query(f"SELECT k, 'NL-' || {NL} AS code FROM {src(*CUSTOMER)}")
def variants_of_a_pattern(spark, d):
    return coded(spark, d, CUSTOMER, _FORMS, "NL").select("k", C.to_text("key", countries=["NL"]).alias("code"))


# ---- UK postcodes and suffixes --------------------------------------------------------------------------

_FORM = f"case k%5 when 0 then {UK} when 1 then lower(replace({UK}, ' ', '')) when 2 then {OUT} when 3 then {UK} || 'X' else 'QZ1 1AA' end"


@query(f"SELECT k, k%5 < 2 AS ok FROM {src(*ORDERS)}")
def uk_validate(spark, d):
    return table(spark, d, ORDERS).select("k", uk.uk_validate(F.expr(_FORM)).alias("ok"))


_WALKS = f"((ascii({WALK}) - 64) * 32 + ascii(substr({WALK}, 2, 1)) - 64)"
UK_BITS = f"((k%126+1)*16777216 + (k%9+2)*1048576 + ((k*3)%10+1)*1024 + {_WALKS})"


@query(f"SELECT k, printf('%08X', cast({UK_BITS} as bigint)) AS hex, cast({UK_BITS} as bigint) AS again, cast(null as bigint) AS short FROM {src(*ORDERS)}")
def uk_binary(spark, d):
    rows = uk_rows(spark, d).withColumn("b", uk.uk_send(F.col("v")))
    return rows.select("k", F.hex("b").alias("hex"), uk.uk_receive(F.col("b")).alias("again"), uk.uk_receive(F.substring("b", 1, 3)).alias("short"))


_DPS_N = "(k%180+1)"
_DPS_TEXT = f"(cast((k%180) // 20 + 1 as varchar) || substr('{UK_UNIT_LETTERS}', cast((k%180)%20+1 as int), 1))"


@query(f"SELECT k, {_DPS_TEXT} AS t, printf('%02X', cast({_DPS_N} as bigint)) AS hex, cast({_DPS_N} as smallint) AS again FROM {src(*PART)}")
def dps_binary(spark, d):
    v = F.expr(f"cast({_DPS_N} as smallint)")
    rows = table(spark, d, PART).select("k", uk.dps_parse(uk.dps_to_text(v)).alias("v"))
    return rows.select("k", uk.dps_to_text(F.col("v")).alias("t"), F.hex(uk.dps_send(F.col("v"))).alias("hex"), uk.dps_receive(uk.dps_send(F.col("v"))).alias("again"))


_ALL_AREAS = "".join(f"{a:<2}" for a in UK_AREAS)
_N = len(UK_AREAS)
_F = {"a": "(k%130)", "d": "(k%14)", "e": "((k*3)%50)", "s": "((k*5)%13)", "w": "(k%30)", "x": "((k*7)%30)"}
_V = f"({_F['a']}*16777216 + {_F['d']}*1048576 + {_F['e']}*16384 + {_F['s']}*1024 + {_F['w']}*32 + {_F['x']})"


def _shown(f: str, base: int, ok: str) -> str:
    return f"(case when {f} = 0 then '' when {ok} then chr(cast({f} + {base} as int)) else '?' end)"


@query(
    f"""SELECT k, (case when {_F['a']} between 1 and {_N} then trim(substr('{_ALL_AREAS}', cast(({_F['a']}-1)*2+1 as int), 2)) else '?' end)
        || {_shown(_F['d'], 47, f"{_F['d']} <= 11")} || {_shown(_F['e'], 47, f"({_F['e']} <= 11 or {_F['e']} between 18 and 44)")}
        || (case when {_F['s']} = 0 then '' else ' ' end) || {_shown(_F['s'], 47, f"{_F['s']} <= 11")}
        || {_shown(_F['w'], 64, f"{_F['w']} <= 27")} || {_shown(_F['x'], 64, f"{_F['x']} <= 27")} AS shown,
        ({_F['a']} between 1 and {_N}) and {_F['d']} <= 11 and ({_F['e']} <= 11 or {_F['e']} between 18 and 44) and {_F['s']} <= 11 and {_F['w']} <= 27 and {_F['x']} <= 27 AS fine
        FROM {src(*ORDERS)}"""
)
def uk_render_any_bits(spark, d):
    """Fields that cannot be shown are question marks; which bits are a postcode's or a bound's."""
    rows = table(spark, d, ORDERS).withColumn("v", F.expr(f"cast({_V} as bigint)"))
    return rows.select("k", uk.uk_render(F.col("v")).alias("shown"), uk.uk_bits_ok(F.col("v")).alias("fine"))


@query(f"SELECT {SECTOR} AS sector, count(*) AS n, count(*) FILTER (WHERE {AREA} < 'LS') AS below, count(*) FILTER (WHERE {AREA} > 'LS') AS above FROM {src(*ORDERS)} GROUP BY 1")
def uk_cmp_counts(spark, d):
    rows = uk_rows(spark, d).withColumn("c", uk.uk_cmp_partial(F.col("v"), F.lit("ls")))
    return rows.groupBy(uk.uk_part(F.col("v"), "sector").alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == -1).alias("below"), F.count_if(F.col("c") == 1).alias("above"))


# ---- stored tables --------------------------------------------------------------------------------------

_SCANS = ("9", "902", "08420", "08420-")
_counts = ", ".join(f"count(*) FILTER (WHERE starts_with({US}, '{f}')) AS n{k}" for k, f in enumerate(_SCANS))


def clustered(spark, d):
    path = tables.scratch(spark, "clustered")
    tables.write_clustered(coded(spark, d, ORDERS, US, "US").select("k", "key"), path, "key")
    return spark.read.parquet(path)


@query(f"SELECT {_counts} FROM {src(*ORDERS)}")
def stored_prefix_scan(spark, d):
    """Literal prefixes over stored keys: each is two bounds that the scan is given."""
    rows = clustered(spark, d)
    one = [rows.filter(C.match("key", f"US-{f}")).agg(F.count(F.lit(1)).alias(f"n{k}")) for k, f in enumerate(_SCANS)]
    return one[0].join(one[1]).join(one[2]).join(one[3])


@query(f"SELECT {_counts} FROM {src(*ORDERS)}")
def sql_prefix_scan(spark, d):
    """The same by SQL names."""
    sql.register(spark)
    clustered(spark, d).createOrReplaceTempView("zonemark_stored")
    one = [f"(SELECT count(*) FROM zonemark_stored WHERE postal_code_partial(key, 'US-{f}')) AS n{k}" for k, f in enumerate(_SCANS)]
    return spark.sql(f"SELECT {', '.join(one)}")


@query(f"SELECT count(*) AS n FROM {src(*ORDERS)} WHERE starts_with({US}, '90')")
def prepared_prefix(spark, d):
    """A fragment as the argument of a prepared statement."""
    sql.register(spark)
    coded(spark, d, ORDERS, US, "US").select("key").createOrReplaceTempView("zonemark_prepared")
    return spark.sql("SELECT count(*) AS n FROM zonemark_prepared WHERE postal_code_partial(key, :f)", args={"f": "US-90"})


@query(
    f"""SELECT k, 'GB' AS country, 'GB-' || {UK} AS code, 'GB-' || {OUT} AS out, {AREA} AS area, '{{"area":"' || {AREA} || '","district":"' || cast(k%9+1 as varchar)
        || '","sector":"' || {SECTOR} || '","walk":"' || {WALK} || '"}}' AS parts, {AREA} || '/' || {SECTOR} AS shown, k%126+1 AS area_number FROM {src(*PART)}"""
)
def sql_names(spark, d):
    sql.register(spark)
    table(spark, d, PART).withColumn("t", F.expr(UK)).createOrReplaceTempView("zonemark_texts")
    return spark.sql(
        """SELECT k, country(key) AS country, postal_text(postal_code_recv(postal_code_send(key))) AS code, postal_text(district(key)) AS out, part(key, 'area') AS area,
           uk_parts(v) AS parts, uk_to_char(v, 'A/S') AS shown, shiftright(postcode_recv(postcode_send(v)), 24) AS area_number
           FROM (SELECT k, postal_code(t, 'GB') AS key, text_to_postcode(t) AS v FROM zonemark_texts WHERE postcode_validate(t))"""
    )


@query(f"SELECT k, 'US-' || {US} AS code, 'US' AS locked FROM {src(*CUSTOMER)}")
def locked_text_column(spark, d):
    """Bare codes as a locked column; the lock is read from the stored table again."""
    path = tables.scratch(spark, "locked")
    tables.read_locked(table(spark, d, CUSTOMER).withColumn("t", F.expr(US)), "t", "US").select("k", "key").write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.select("k", C.to_text("key", countries=["US"]).alias("code"), F.lit(tables.locked_columns(rows)["key"]).alias("locked"))


@query(f"SELECT cast(k as varchar) AS id, 'US-' || {US} AS code FROM {src(*CUSTOMER)}")
def tsv_codes(spark, d):
    path = tables.scratch(spark, "tsv")
    table(spark, d, CUSTOMER).select(F.concat_ws("\t", "k", F.lit("x"), F.expr(US)).alias("value")).write.text(path)
    rows = tables.read_tsv_codes(spark, path, 2, "US")
    return rows.select(F.get(F.split("value", "\t"), F.lit(0)).alias("id"), C.to_text("key", countries=["US"]).alias("code"))


@query(f"SELECT {UK} AS code, {_DPS_TEXT} AS dps, count(*) AS n FROM {src(*PART)} GROUP BY 1, 2")
def binary_copy_files(spark, d):
    """Written as binary COPY files, a null among the values, and read again."""
    path, v = tables.scratch(spark, "copy"), F.expr(f"cast({_DPS_N} as smallint)")
    rows = uk_rows(spark, d, PART).select(uk.uk_send(F.col("v")).alias("p"), uk.dps_send(v).alias("d"), F.lit(None).cast("binary").alias("none"))
    tables.write_copy(rows, path, rows_per_file=700)
    back = tables.read_copy(spark, path, ["p", "d", "none"]).filter("none is null")
    return back.groupBy(uk.uk_to_text(uk.uk_receive(F.col("p"))).alias("code"), uk.dps_to_text(uk.dps_receive(F.col("d"))).alias("dps")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH v AS (SELECT 'addr' AS source, case when k%2=0 then 'US' else 'CA' end AS country, {US} AS value FROM {src(*CUSTOMER)}
        UNION ALL SELECT 'addr', case when k%2=0 then 'US' else 'CA' end, {FIVE} FROM {src(*CUSTOMER)} WHERE k%3=0)
        SELECT source, country, value, count(*) AS n FROM v GROUP BY ALL"""
)
def extract_to_files(spark, d):
    """Tagged values cut at semicolons, squeezed and counted, from files to files."""
    path, out = tables.scratch(spark, "tags"), tables.scratch(spark, "values")
    rows = table(spark, d, CUSTOMER).select(F.lit("addr").alias("source"), F.expr("case when k%2=0 then 'US' else 'CA' end").alias("country"), F.expr(f"'  ' || {US} || case when k%3=0 then ';' || {FIVE} || ' ;' when k%3=1 then '; ' || repeat('9', 70) else '' end").alias("value"))
    rows.write.option("header", True).csv(path)
    return tables.extract_files(spark, path, out)


@query(
    f"""SELECT k, case when k%4=0 then 'US-' || lpad(cast(k%100000 as varchar), 5, '0') else 'US-' || {US} end AS code FROM {src(*CUSTOMER)} WHERE k%7 <> 0
        UNION ALL SELECT k + 1000000, 'US-' || {US} FROM {src(*CUSTOMER)} WHERE k%10 = 0"""
)
def upsert_update_delete(spark, d):
    """New values for some keys, new rows, and rows that go, under the lock of the stored column."""
    step = lambda n: tables.scratch(spark, n)
    base = tables.read_locked(table(spark, d, CUSTOMER).withColumn("t", F.expr(US)), "t", "US").select("k", "key")
    base.write.parquet(path := step("base"))
    now = spark.read.parquet(path)
    new = table(spark, d, CUSTOMER).filter("k%10 = 0").select((F.col("k") + 1_000_000).alias("k"), C.postal_code(F.expr(US), "US").alias("key"))
    again = table(spark, d, CUSTOMER).filter("k%8 = 0").select("k", C.postal_code(F.lpad((F.col("k") % 100_000).cast("string"), 5, "0"), "US").alias("key"))
    now = tables.upsert_locked(now, new.unionByName(again), ["k"], step("upsert"))
    other = C.postal_code(F.lpad((F.col("k") % 100_000).cast("string"), 5, "0"), "US")
    now = tables.update_locked(now, (F.col("k") % 8 == 4) & (F.col("k") < 1_000_000), {"key": other}, step("update"))
    now = tables.delete_where(now, (F.col("k") % 7 == 0) & (F.col("k") < 1_000_000), step("delete"))
    assert tables.locked_columns(now) == {"key": "US"}
    return now.select("k", C.to_text("key", countries=["US"]).alias("code"))


# ---- fragments and ranges -------------------------------------------------------------------------------

_ZIP3 = "(k%1000)"


@query(
    f"""SELECT k, cast({US_KEY} + {_ZIP3}*100*16384::HUGEINT as bigint) AS lo,
        case when {_ZIP3} = 999 then cast(658::HUGEINT*18014398509481984 + 63::HUGEINT*281474976710656 - 9223372036854775808::HUGEINT as bigint)
             else cast({US_KEY} + ({_ZIP3}+1)*100*16384::HUGEINT as bigint) end AS hi FROM {src(*PART)}"""
)
def fragment_bounds(spark, d):
    sql.register(spark)
    table(spark, d, PART).withColumn("f", F.expr("'US-' || lpad(cast(k%1000 as string), 3, '0')")).createOrReplaceTempView("zonemark_fragments")
    return spark.sql("SELECT k, lower_bound(f) AS lo, upper_bound(f) AS hi FROM zonemark_fragments")


@query(f"SELECT 'GB-' || {AREA} AS area, count(*) AS n FROM {src(*ORDERS)} GROUP BY 1")
def group_by_range(spark, d):
    """Grouped by the range itself; its name is the area that its lower bound begins with."""
    rows = joins.group_by_range(coded(spark, d, ORDERS, UK, "GB"), "key", "area", countries=["GB"])
    low = C.to_text("lo", countries=["GB"])
    return rows.select(F.regexp_extract(low, "^(GB-[A-Z]+)", 1).alias("area"), "n")


@query(f"SELECT k, case when k%2=0 then 'NL-' || substr({NL}, 1, 4) end AS lo, k%2=0 AS inside, substr({NL}, 1, 4) AS digits FROM {src(*PART)}")
def prefix_of_a_pattern(spark, d):
    """The range up to a named part of a pattern's codes, where the code has the part."""
    rows = coded(spark, d, PART, NL, "NL").withColumn("r", F.when(F.col("k") % 2 == 0, C.prefix_of("key", "digits", countries=["NL"])))
    inside = F.coalesce(ranges.contains(F.col("r"), F.col("key")), F.lit(False))
    return rows.select("k", C.to_text("r.lo", countries=["NL"]).alias("lo"), inside.alias("inside"), C.part("key", "digits", countries=["NL"]).alias("digits"))


_A = ("(k%17)", "(k%17 + (k*3)%7)")
_B = ("((k*5)%19)", "((k*5)%19 + (k*11)%6)")
_EA, _EB = f"({_A[0]} >= {_A[1]})", f"({_B[0]} >= {_B[1]})"
_BOTH = f"(NOT {_EA} AND NOT {_EB})"


@query(
    f"""SELECT k, {_EA} AS empty, case when NOT {_EA} then {_A[0]} end AS lo, case when NOT {_EA} then {_A[1]} end AS hi, NOT {_EA} AS lo_inc, false AS hi_inc,
        {_EB} OR (NOT {_EA} AND {_A[0]} <= {_B[0]} AND {_B[1]} <= {_A[1]}) AS contains, {_EA} OR (NOT {_EB} AND {_B[0]} <= {_A[0]} AND {_A[1]} <= {_B[1]}) AS within,
        (k%23 >= {_A[0]} AND k%23 < {_A[1]}) AS holds, {_BOTH} AND {_A[0]} < {_B[1]} AND {_B[0]} < {_A[1]} AS "overlaps",
        {_BOTH} AND ({_A[1]} = {_B[0]} OR {_B[1]} = {_A[0]}) AS adjacent, {_BOTH} AND {_A[1]} <= {_B[0]} AS before, {_BOTH} AND {_B[1]} <= {_A[0]} AS after,
        {_BOTH} AND {_A[1]} <= {_B[1]} AS not_right, {_BOTH} AND {_A[0]} >= {_B[0]} AS not_left, ({_EA} AND {_EB}) OR ({_A[0]} = {_B[0]} AND {_A[1]} = {_B[1]}) AS same,
        case when greatest({_A[0]}, {_B[0]}) < least({_A[1]}, {_B[1]}) then greatest({_A[0]}, {_B[0]}) end AS meet_lo,
        case when greatest({_A[0]}, {_B[0]}) < least({_A[1]}, {_B[1]}) then least({_A[1]}, {_B[1]}) end AS meet_hi,
        case when {_EA} AND {_EB} then null when {_EA} then {_B[0]} when {_EB} then {_A[0]} else least({_A[0]}, {_B[0]}) end AS merge_lo,
        case when {_EA} AND {_EB} then null when {_EA} then {_B[1]} when {_EB} then {_A[1]} else greatest({_A[1]}, {_B[1]}) end AS merge_hi FROM {src(*ORDERS)}"""
)
def range_operators_wide(spark, d):
    rows = table(spark, d, ORDERS)
    for name, (lo, hi) in (("a", _A), ("b", _B)):
        rows = rows.withColumn(name, ranges.make(F.expr(lo), F.expr(hi)))
    a, b = F.col("a"), F.col("b")
    meet, merged = ranges.intersection(a, b), ranges.merge(a, b)
    return rows.select(
        "k", ranges.isempty(a).alias("empty"), ranges.lower(a).alias("lo"), ranges.upper(a).alias("hi"), ranges.lower_inc(a).alias("lo_inc"), ranges.upper_inc(a).alias("hi_inc"),
        ranges.contains_range(a, b).alias("contains"), ranges.contains_range(b, a).alias("within"), ranges.contains(a, F.col("k") % 23).alias("holds"),
        ranges.overlaps(a, b).alias("overlaps"), ranges.adjacent(a, b).alias("adjacent"), ranges.before(a, b).alias("before"), ranges.after(a, b).alias("after"),
        ranges.not_right_of(a, b).alias("not_right"), ranges.not_left_of(a, b).alias("not_left"), ranges.equals(a, b).alias("same"),
        ranges.lower(meet).alias("meet_lo"), ranges.upper(meet).alias("meet_hi"), ranges.lower(merged).alias("merge_lo"), ranges.upper(merged).alias("merge_hi"),
    )


_TOUCH = f"{_BOTH} AND {_A[0]} <= {_B[1]} AND {_B[0]} <= {_A[1]}"
_SPLIT = f"{_A[0]} < {_B[0]} AND {_B[1]} < {_A[1]} AND NOT {_EB}"
_CUT = (f"case when {_EB} then {_A[0]} when {_B[0]} <= {_A[0]} then least({_A[1]}, greatest({_A[0]}, {_B[1]})) else {_A[0]} end", f"case when {_EB} OR {_B[0]} <= {_A[0]} then {_A[1]} else least({_A[1]}, {_B[0]}) end")


@query(
    f"""SELECT k, least({_A[0]}, {_B[0]}) AS lo, greatest({_A[1]}, {_B[1]}) AS hi, 'union' AS op FROM {src(*ORDERS)} WHERE {_TOUCH}
        UNION ALL SELECT k, {_CUT[0]}, {_CUT[1]}, 'difference' FROM {src(*ORDERS)} WHERE NOT ({_SPLIT}) AND NOT {_EA} AND {_CUT[0]} < {_CUT[1]}"""
)
def range_union_difference(spark, d):
    """Where the result is one range; elsewhere these are errors."""
    rows = table(spark, d, ORDERS)
    for name, (lo, hi) in (("a", _A), ("b", _B)):
        rows = rows.withColumn(name, ranges.make(F.expr(lo), F.expr(hi)))
    a, b = F.col("a"), F.col("b")
    touch = rows.filter(ranges.overlaps(a, b) | ranges.adjacent(a, b)).select("k", ranges.union(a, b).alias("r"), F.lit("union").alias("op"))
    whole = rows.filter(~ranges.isempty(a) & ~(F.expr("a.lo < b.lo and b.hi < a.hi") & ~ranges.isempty(b))).select("k", ranges.difference(a, b).alias("r"), F.lit("difference").alias("op"))
    both = touch.unionByName(whole.filter(~ranges.isempty(F.col("r"))))
    return both.select("k", ranges.lower(F.col("r")).alias("lo"), ranges.upper(F.col("r")).alias("hi"), "op")


_G, _LO = "(k%40)", "((k*37)%500*3)"


@query(
    f"""WITH r AS (SELECT {_G} AS g, {_LO} AS lo, {_LO} + (k*7)%9 AS hi FROM {src(*PART)}), v AS (SELECT * FROM r WHERE lo < hi),
        m AS (SELECT *, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
        i AS (SELECT *, sum(case when reach is null or lo > reach then 1 else 0 end) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT g, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY g, island"""
)
def range_agg_wide(spark, d):
    rows = table(spark, d, PART).selectExpr(f"{_G} AS g", f"{_LO} AS lo", f"{_LO} + (k*7)%9 AS hi")
    return ranges.range_agg(rows, ["g"]).select("g", "lo", "hi")


@query(f"SELECT {_G} AS g, max(k%50) AS lo, greatest(max(k%50), min(60 + k%30)) AS hi FROM {src(*PART)} GROUP BY 1")
def range_intersect_agg(spark, d):
    rows = table(spark, d, PART).selectExpr(f"{_G} AS g", "k%50 AS lo", "60 + k%30 AS hi")
    return ranges.range_intersect_agg(rows, ["g"]).select("g", "lo", "hi")


@query(
    f"""SELECT count(*) FILTER (WHERE k%9 IN (0, 4, 7)) AS distinct_from_itself_plus, count(*) FILTER (WHERE {OK} AND k%6=0 AND {ZIP5} BETWEEN '20000' AND '79999') AS between_n,
        count(*) FILTER (WHERE {OK} AND starts_with({MIXED_CC}, 'C')) AS like_n, count(*) FILTER (WHERE {OK} AND regexp_matches({MIXED}, '[0-9]{{5}}')) AS rx_n FROM {src(*CUSTOMER)}"""
)
def boolean_checks(spark, d):
    rows = broken(spark, d).withColumn("s", C.to_text("key"))
    k = F.col("key")
    reg = world_registry()
    lo, hi = reg.prefix("US-2")[0], reg.prefix("US-7")[1] - 1
    n = F.count_if
    return rows.agg(
        n(k.eqNullSafe(F.lit(None))).alias("distinct_from_itself_plus"), n(k.between(lo, hi)).alias("between_n"), n(F.col("s").like("C_-%")).alias("like_n"), n(F.col("s").rlike("-.*[0-9]{5}")).alias("rx_n")
    )


# ---- registries and patterns ----------------------------------------------------------------------------


@query(
    f"""SELECT k, 'FR-' || {FIVE} AS before, cast(null as varchar) AS removed, 'FR-' || {FIVE} AS still_read, 'XY-' || {FIVE} AS added, 'XQ-' || substr({FIVE}, 1, 2) || '-' || substr({FIVE}, 3, 3) AS patterned,
        'XQ-' || substr({FIVE}, 1, 2) || '-' || substr({FIVE}, 3, 3) AS old_language FROM {src(*PART)}"""
)
def registry_changes(spark, d):
    """Formats given and taken away, a language and its successor: stored codes go on being read."""
    world = world_registry()
    gone = world.remove_country_format("FR")
    more = gone.add_country_format("XY", "US").add_country_template("XQ", "NN-NNN")
    later = more.add_country_template("XQ", "NN-NNN[A]")
    rows = table(spark, d, PART).withColumn("t", F.expr(FIVE))
    rows = rows.select("k", "t", C.to_postal_code("t", "FR").alias("f"), C.to_postal_code("t", "XY", more).alias("x"), C.to_postal_code("t", "XQ", more).alias("q"))
    text = lambda c, reg, cc: C.to_text(c, reg, countries=[cc])
    return rows.select(
        "k", text("f", world, "FR").alias("before"), text(C.to_postal_code("t", "FR", gone), world, "FR").alias("removed"), text("f", world, "FR").alias("still_read"),
        text("x", more, "XY").alias("added"), text("q", more, "XQ").alias("patterned"), C.to_text("q", later).alias("old_language"),
    )


@query("SELECT * FROM (VALUES ('GeoNames data', 100), ('Wikipedia', 69), ('no postal codes', 56), ('see note', 14), ('built in', 11)) t(basis, n)")
def world_basis(spark, d):
    return world_registry().world(spark).groupBy("basis").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT * FROM (VALUES ('\d{2}', '[0-9][0-9]', true, null, '\d{2}'), ('\d{2}', '\d{3}', false, null, '\d{2}'), ('(?<a>\d)(?<b>\d)', '\d\d', true, null, '(?:\d)(?:\d)'),
        ('(?<a>A{1,2})(?<b>A{1,2})\d', 'A{2,4}\d', true, 'AAA0', '(?:A{1,2})(?:A{1,2})\d'), ('[1-9]\d', '\d\d', false, null, '[1-9]\d')) t(a, b, same, ambiguous, bare)"""
)
def pattern_relations(spark, d):
    rows = [(r"\d{2}", "[0-9][0-9]"), (r"\d{2}", r"\d{3}"), (r"(?<a>\d)(?<b>\d)", r"\d\d"), (r"(?<a>A{1,2})(?<b>A{1,2})\d", r"A{2,4}\d"), (r"[1-9]\d", r"\d\d")]
    found = [(a, b, same_codes(a, b), language(a).ambiguous(), strip_names(a)) for a, b in rows]
    return spark.createDataFrame(found, "a string, b string, same boolean, ambiguous string, bare string")


@query(f"SELECT k, 'XQ-' || substr({FIVE}, 1, 2) || '-' || substr({FIVE}, 3, 3) AS code, cast(null as varchar) AS gone FROM {src(*PART)}")
def registry_saved(spark, d):
    """User rows saved, and restored over the built-in part."""
    path = tables.scratch(spark, "registry")
    world_registry().add_country_template("XQ", "NN-NNN").remove_country_format("FR").save(spark, path)
    reg = world_registry().load(spark, path)
    rows = table(spark, d, PART).withColumn("t", F.expr(FIVE))
    key, gone = C.to_postal_code("t", "XQ", reg), C.to_postal_code("t", "FR", reg)
    return rows.select("k", C.to_text(key, reg, countries=["XQ"]).alias("code"), C.to_text(gone, countries=["FR"]).alias("gone"))


@query("SELECT * FROM (VALUES ('/(?<a>[0-9]{2})-(?<b>[0-9]{3})/', true), ('NN-NNN', true), ('NN-NN', false), ('NN-NNN[A]', false)) t(spec, kept)")
def languages_are_permanent(spark, d):
    """A stored language can be named anew, and denotes the same codes for ever."""
    reg, found = world_registry().add_country_template("XQ", "NN-NNN"), []
    for spec in ("/(?<a>[0-9]{2})-(?<b>[0-9]{3})/", "NN-NNN", "NN-NN", "NN-NNN[A]"):
        try:
            reg.relabel("XQ", spec)
            found.append((spec, True))
        except CodeError:
            found.append((spec, False))
    return spark.createDataFrame(found, "spec string, kept boolean")


@query(f"SELECT {MIXED_CC} AS cc, count(*) AS n FROM {src(*CUSTOMER)} WHERE {OK} AND {MIXED_CC} <> 'GB' GROUP BY 1")
def lock_violations(spark, d):
    return tables.lock_failures(broken(spark, d), "key", "GB").groupBy("cc").agg(F.count(F.lit(1)).alias("n"))


# ---- forms of queries -----------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n FROM {src(*ORDERS)} o WHERE substr({US}, 1, 5) IN (SELECT {ZIP5} FROM {src(*SUPPLIER)} s)")
def semi_join_on_outcode(spark, d):
    o = coded(spark, d, ORDERS, US, "US").select(C.outcode("key", countries=["US"]).alias("o"))
    s = coded(spark, d, SUPPLIER, US, "US").select(C.outcode("key", countries=["US"]).alias("o"))
    return o.join(s, "o", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT * FROM (SELECT {MIXED_CC} AS cc, count(*) AS n, bool_and({OK}) AS all_read, bool_or(k%9=0) AS some_marked FROM {src(*CUSTOMER)} GROUP BY 1) WHERE n > 10"""
)
def grouped_conditions(spark, d):
    rows = broken(spark, d)
    out = rows.groupBy("cc").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("key").isNotNull()).alias("all_read"), F.bool_or(F.col("t").startswith("?")).alias("some_marked"))
    return out.filter("n > 10")


@query(
    f"""SELECT o, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT DISTINCT substr({US}, 1, 2) AS o, {US} AS code FROM {src(*CUSTOMER)}) GROUP BY o HAVING count(*) > 1"""
)
def ordered_list_of_codes(spark, d):
    """Codes of a beginning in their order: that of the keys."""
    rows = coded(spark, d, CUSTOMER, US, "US").select("key").distinct()
    text = F.substring(C.to_text("key", countries=["US"]), 4, 20)
    grouped = rows.select("key", text.alias("s")).groupBy(F.substring("s", 1, 2).alias("o")).agg(F.array_sort(F.collect_list(F.struct("key", "s"))).alias("a"))
    return grouped.filter(F.size("a") > 1).select("o", F.array_join(F.transform("a", lambda x: x["s"]), ",").alias("codes"))


@query(
    f"""SELECT fragment, part, count(*) FILTER (WHERE starts_with(t, fragment)) AS n FROM (SELECT 'US-' || {US} AS t, k%2 AS part FROM {src(*SUPPLIER)})
        CROSS JOIN (VALUES ('US-1'), ('US-20'), ('GB-B')) v(fragment) GROUP BY ALL"""
)
def cross_join_with_values(spark, d):
    values = spark.createDataFrame([("US-1",), ("US-20",), ("GB-B",)], "fragment string")  # three rows
    r = joins.resolve_fragments(values)
    rows = coded(spark, d, SUPPLIER, US, "US").withColumn("part", F.col("k") % 2).crossJoin(F.broadcast(r))
    inside = (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    return rows.groupBy("fragment", "part").agg(F.count_if(inside).alias("n"))


@query(f"SELECT outcode, count(*) AS n, min(code) AS first, max(code) AS last FROM (SELECT 'GB-' || {OUT} AS outcode, 'GB-' || {UK} AS code FROM {src(*ORDERS)}) GROUP BY 1 HAVING count(*) > 1")
def outcodes_with_several(spark, d):
    rows = coded(spark, d, ORDERS, UK, "GB").groupBy(C.outcode("key", countries=["GB"]).alias("o")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    text = lambda c: C.to_text(c, countries=["GB"])
    return rows.filter("n > 1").select(text("o").alias("outcode"), "n", text("a").alias("first"), text("b").alias("last"))
