import random

import pytest
from pyspark.sql import functions as F

from zonemark.functions import codes, ranges, uk
from zonemark.functions import columns as C
from zonemark.operators import joins, quality
from zonemark.plans.registry import world_registry
from zonemark.sources import sql, tables
from zonemark.streaming import windows

R = world_registry()
TEXTS = [
    "US-90210", "us-902101234", "US-90210-0000", "US-~", "GB-SW1A 1AA", "GB-L01", "GB-LS00", "GB-L00 1AA", "gb-ls28aa", "IM-IM1 1AA", "GB-SW1A 1CA", "GB-W1I",
    "FR-75001 CEDEX 08", "FR-75A", "CA-k1a0b1", "CA-K1A-0B1", "CA-D1A", "IE-D6W", "IE-A65F4E2", "LU-2226", "LU-L-2226", "BR-06.026-170", "CZ-11000", "NL-1012AB",
    "TW-10012", "AR-B1832GMR", "PL-00950", "QQ-1", "90210", "", "GB-EC1A1BB", "GB-GX11 1AA", "MT-ŻTN 3000",
]


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(t, None) for t in TEXTS] + [(t[3:], t[:2]) for t in TEXTS if t[2:3] == "-"] + [(None, "US"), ("90210", "U1"), ("US-90210", "CA")]
    df = spark.createDataFrame(rows, "code string, cc string")
    return df.withColumn("key", C.to_postal_code("code", F.col("cc")))


def test_columns_agree_with_python(keyed):
    rows = keyed.select("*", C.to_text("key").alias("t"), C.outcode("key").alias("o"), C.is_valid_postal_code("code", F.col("cc")).alias("ok"), C.receive(C.send("key")).alias("b")).collect()
    for r in rows:
        want = None if r.code is None else R.parse(r.code, r.cc, bounds=False)
        assert r.key == want and r.b == r.key, r
        assert r.ok == (None if r.code is None else want is not None)
        if want is not None:
            assert r.t == R.text(want) and r.o == R.outcode(want)


def test_strict_forms_raise(spark):
    for text, cc, why in (
        ("US-ABC", None, 'cannot parse "ABC" as a US postal code'),
        ("NL-0", None, 'cannot parse "0" as a NL postal code'),
        ("90210", None, '"90210" has no country'),
        ("US-90210", "CA", 'country code "CA" does not match the "US-" prefix of "US-90210"'),
        ("QQ-1", None, '"QQ" is not a supported country code'),
        ("US-~", None, 'cannot parse "~" as a US postal code'),
    ):
        with pytest.raises(Exception, match=why):
            spark.range(1).select(C.postal_code(F.lit(text), cc)).collect()
    with pytest.raises(Exception, match='"U1" is not a two-letter country code'):
        spark.range(1).select(C.postal_code(F.lit("1"), F.lit("U1"))).collect()
    for bad, why in ((uk.uk_cast(F.lit("LS")), "type postcode"), (uk.dps_cast(F.lit("0A")), "type dps"), (uk.uk_show(F.lit(-1).cast("long")), "corrupted")):
        with pytest.raises(Exception, match=why):
            spark.range(1).select(bad).collect()
    assert spark.range(1).select(C.to_text(C.to_postal_code(F.lit("us-~"), bounds=True))).first()[0] == "US-~"
    with pytest.raises(Exception, match='"CA" does not match the column'):
        spark.range(1).select(C.enforce(F.lit(R.parse("CA-K1A")), "US")).collect()


def test_literal_prefix_reaches_the_scan(spark, tmp_path):
    keys = spark.range(1000).select(C.to_postal_code(F.lpad(F.col("id").cast("string"), 5, "0"), "US").alias("key"))
    tables.write_clustered(keys, str(tmp_path / "t"), "key")
    back = spark.read.parquet(str(tmp_path / "t"))
    hit = back.filter(C.match("key", "US-0001"))
    plan = hit._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert hit.count() == 10 and back.schema["country"]


def test_parts(spark):
    df = spark.createDataFrame([("GB-SW1A 1AA",), ("US-90210",), ("NL-1012 AB",), ("AR-1234",), ("FR-75001",)], "t string").withColumn("key", C.to_postal_code("t"))
    got = {r.t: r for r in df.select("t", C.parts("key", jsonb_order=True).alias("p"), C.part("key", "area").alias("a"), C.part_end("key", "district").alias("e"), C.prefix_of("key", "area").alias("r")).collect()}
    assert got["GB-SW1A 1AA"].p == '{"area":"SW","walk":"AA","sector":"1","district":"1A"}'
    assert got["GB-SW1A 1AA"].e == 4 and R.text(got["GB-SW1A 1AA"].r.hi) == "GB-SY0"
    assert got["US-90210"].p == '{"zip5":"90210","plus4":null}' and got["FR-75001"].p is None and got["NL-1012 AB"].a is None
    with pytest.raises(ValueError, match="called"):
        C.part("key", "nothing")


def test_uk_columns(spark):
    df = spark.createDataFrame([("BA1 9AA", "BA1"), ("BA1 9AA", "nope"), (None, "B"), ("LS28AA", None)], "t string, f string").withColumn("v", uk.uk_parse(F.col("t")))
    rows = df.select(uk.uk_match(F.col("v"), F.col("f")).alias("m"), uk.uk_not_match(F.col("v"), F.col("f")).alias("n"), uk.uk_to_char(F.col("v"), "A-D").alias("c"), uk.uk_cmp_partial(F.col("v"), F.col("f")).alias("x")).collect()
    assert [tuple(r) for r in rows] == [(True, False, "BA-1", 0), (False, True, "BA-1", -1), (None, None, None, None), (None, None, "LS-2", None)]
    assert codes.uk_text(codes.uk_unpack(uk.uk_range_upper("BA"))) == "BB0 0AA"
    with pytest.raises(ValueError):
        uk.uk_range_lower("nope")
    assert uk.uk_range_lower("SW1A 1AA") == 1764001825


def test_prefix_join_ways_agree(spark):
    df = spark.range(3000).select(C.to_postal_code(F.lpad((F.col("id") * 37 % 100000).cast("string"), 5, "0"), "US").alias("key"))
    frags = spark.createDataFrame([("US-0",), ("US-01",), ("US-012",), ("US-01234",), ("US-9",), ("GB-LS",), ("bad",)], "fragment string")
    few = joins.prefix_join(df, frags, "key")
    many = joins.prefix_join(df, frags, "key", compared_fragments=0, broadcast_fragments=0)
    cells = joins.prefix_join(df, frags, "key", compared_fragments=0)
    assert sorted(map(str, many.collect())) == sorted(map(str, cells.collect()))
    assert sorted(map(tuple, few.select("key", "fragment").collect())) == sorted(map(tuple, many.select("key", "fragment").collect()))
    assert "BroadcastNestedLoopJoin" not in few._jdf.queryExecution().toString()
    left = joins.prefix_join(df, frags, "key", how="left").groupBy("fragment").agg(F.count("key").alias("n"))
    assert {r.fragment: r.n for r in left.collect()}["bad"] == 0


def test_ranges(spark):
    a, b, c = (ranges.make(F.lit(x), F.lit(y)) for x, y in ((1, 5), (5, 9), (3, 7)))
    row = spark.range(1).select(
        ranges.adjacent(a, b), ranges.overlaps(a, c), ranges.union(a, b), ranges.intersection(a, c), ranges.difference(a, c), ranges.before(a, b), ranges.not_right_of(a, b), ranges.isempty(ranges.intersection(a, b)), ranges.contains(a, F.lit(5))
    ).first()
    assert list(row) == [True, True, (1, 9), (3, 5), (1, 3), True, True, True, False]
    df = spark.createDataFrame([(1, 1, 5), (1, 4, 9), (1, 9, 10), (1, 20, 30), (2, 1, 2), (2, 7, 7)], "g int, lo long, hi long")
    assert {r.g: [tuple(x) for x in r.ranges] for r in ranges.multirange(df, ["g"]).collect()} == {1: [(1, 10), (20, 30)], 2: [(1, 2)]}


def test_locks_and_copy_files(spark, tmp_path):
    df = spark.createDataFrame([("90210",), ("us-10001",)], "code string")
    locked = tables.read_locked(df, "code", "US")
    locked.write.parquet(str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert tables.locked_columns(back) == {"key": "US"}
    tables.append_locked(back, str(tmp_path / "l"), back)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4
    image = tables.copy_image([[(1764001825).to_bytes(4, "big"), b"\x01"], [None, b"\xb4"], [b"\0\0\0\0", b"\0"]])
    (tmp_path / "c.bin").write_bytes(image)
    got = tables.read_copy(spark, str(tmp_path / "c.bin"), ["p", "d"]).select(uk.uk_to_text(uk.uk_receive(F.col("p"))), uk.dps_to_text(uk.dps_receive(F.col("d")))).collect()
    assert [tuple(r) for r in got] == [("SW1A 1AA", "1A"), (None, "9Z"), (None, None)]


def test_quality(spark):
    df = spark.createDataFrame([("90210", "US"), ("9021", "US"), ("AB12", "US"), ("SW1A 1AA", "GB")], "t string, cc string")
    rows = quality.with_codes(df, "t", "cc")
    assert {r.cc: (r.n, r.read) for r in quality.parse_rates(rows, ["cc"]).collect()} == {"US": (3, 1), "GB": (1, 1)}
    assert {r["shape"] for r in quality.reject_shapes(rows, "t", "cc").collect()} == {"NNNN", "AANN"}
    good, bad = quality.split_feed(df, "t", "cc")
    assert (good.count(), bad.count()) == (2, 2)
    who = spark.createDataFrame([("uk", ["FR"]), (None, ["FR"]), (None, ["FR", "DE"]), ("xyz", ["DE"])], "tag string, file array<string>")
    assert [r[0] for r in who.select(quality.attribute_country(F.col("tag"), F.col("file"))).collect()] == ["GB", "FR", None, "DE"]


def test_sql_names(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT postal_text(to_postal_code('sw1a1aa', 'GB')), postal_country(to_postal_code('US-90210', NULL)), postal_match(to_postal_code('US-90210', NULL), 'US-902'), "
        "is_valid_postal_code('x', 'US'), postal_code_pattern_size('NN-NNN'), postal_code_pattern_part_names('(?<x>\\\\d)(?<y>\\\\d)')"
    ).first()
    assert list(row) == ["GB-SW1A 1AA", "US", True, False, 100000, ["x", "y"]]
    row = spark.sql(
        "SELECT postal_part(to_postal_code('GB-SW1A 1AA', NULL), 'district'), postal_parts(to_postal_code('US-90210', NULL)), postal_parts(to_postal_code('FR-75001', NULL)), "
        "postal_prefix('GB-LS1').hi = lower_bound('GB-LS10'), to_postal_prefix('nothing') IS NULL, postal_code_parts_check('(?<x>[0-9])(?<y>[0-9])') IS NULL"
    ).first()
    assert list(row) == ["1A", '{"zip5":"90210","plus4":null}', None, True, True, True]
    parts = spark.sql("SELECT * FROM parts_of((SELECT to_postal_code('NL-1012AB', NULL)))").collect()
    assert [tuple(r) for r in parts] == [(1, "digits", "1012"), (2, "letters", "AB")]
    assert spark.table("postal_code_world").count() == 250


def test_registry_saved_and_restored(spark, tmp_path):
    mine = R.add_country_template("XQ", "NN-NNN").remove_country_format("FR")
    mine.save(spark, str(tmp_path))
    back = R.load(spark, str(tmp_path))
    assert back.parse("XQ-12-345") == mine.parse("XQ-12-345") and back.parse("FR-75001") is None


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 00:10:00", "90210"), ("2024-01-01 00:20:00", "90210-1234"), ("2024-01-01 01:10:00", "bad")], "ts string, code string")
    src.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, code string").parquet(str(tmp_path / "in"))
    out = windows.counts_by_outcode(windows.with_codes(stream, "code", "US"), "ts", "key", countries=["US"])
    q = out.writeStream.format("memory").queryName("codes_by_hour").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.outcode, r.n) for r in spark.table("codes_by_hour").collect()} == {("US-90210", 2), (None, 1)}


def test_plain_postcodes_read_as_by_the_whole_grammar(spark):
    """The quick way gives what the grammar gives, or nothing."""
    rng = random.Random(12)
    texts = []
    for _ in range(4000):
        t = rng.choice(["B", "BA", "SW", "E", "ZZ", "QX", "L", "GIR"]) + rng.choice(["0", "1", "9", "00", "05", "10", "1A", "2W", "1M", "0A", ""]) + rng.choice(["", " ", "   ", "-"]) + rng.choice("0159") + rng.choice(["AA", "QX", "CI", "B", "1", "A A"])
        texts.append((t,))
    df = spark.createDataFrame(texts, "t string").select("t", uk.uk_plain(F.col("t")).alias("a"), uk.uk_native(F.col("t"), False).alias("b"), uk.uk_plain(F.col("t"), letters=True).alias("c"), C._payload_of("GB", F.col("t")).alias("d"))
    rows = df.collect()
    assert all(r.a in (None, r.b) and r.c in (None, r.d) for r in rows)
    assert sum(r.a is not None for r in rows) > 500 and sum(r.c is not None for r in rows) > 100
    assert all(r.b == r.a for r in rows if "-" not in r.t and "A A" not in r.t)


def test_sql_prefixes_reach_the_scan(spark, tmp_path):
    """Literal fragments are two bounds on a stored key; SQL names give what the column functions give."""
    sql.register(spark)
    texts = [("US", f"{k:05d}") for k in range(0, 100_000, 37)] + [("GB", "LS1 1AA"), ("GB", "L1 1AA"), ("NL", "1012 AB"), ("NL", "1013"), ("PL", "00-950")]
    rows = quality.with_codes(spark.createDataFrame(texts, "cc string, t string"), "t", "cc")
    tables.write_clustered(rows, str(tmp_path / "t"), "key", by_country=False)
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("stored_codes")
    for f in ("US-902", "US-9", "GB-L", "GB-LS1 1AA", "NL-1012", "NL-1", "PL-00"):
        df = spark.sql(f"SELECT key FROM stored_codes WHERE postal_code_partial(key, '{f}')")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(key," in plan and "LessThan(key," in plan and "Python" not in plan, f
        want = spark.table("stored_codes").filter(C.match("key", f)).select("key")
        assert sorted(df.collect()) == sorted(want.collect()) and want.count() > 0
    frags = ["US-902", "US-9", "US-99999", "US-1234-", "US-12345-1", "GB-L", "GB-LS1", "GB-LS1 1", "NL-0", "NL-1012 A", "NL-1012", "PL-00-9", "PL-99", "CZ-1100", "QQ-1", "US-", "", None, "us-902"]
    got = spark.createDataFrame([(f,) for f in frags], "f string").selectExpr("f", "to_postal_prefix(f) AS r", "postal_code_partial(0, f) AS p", "_postal_lo(f) AS lo", "_postal_hi(f) AS hi").collect()
    for r in got:
        want = R.prefix(r.f) if r.f is not None else None
        assert (tuple(r.r) if r.r else None) == want, r.f
        assert r.p is None if r.f is None else r.p is False
        if want and not (r.f.startswith("GB") and len(r.f) > 3):
            assert (r.lo, r.hi) == want or r.f.startswith("GB"), r.f
        if r.f is not None and want is None:
            assert r.lo > r.hi


def test_parts_of_compiled_formats_by_place(spark):
    """What is read off by place is what the formats' patterns say."""
    texts = ["US-90210", "US-90210-1234", "CA-K1A", "CA-K1A 0B1", "IE-D6W", "IE-A65 F4E2", "BR-06026", "BR-06026-170", "GB-LS2", "GB-SW1A", "GB-SW1A 1AA", "GB-B33 8TH", "GB-E1", "GB-E1W 1AA", "FR-75001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.to_postal_code("t").alias("key")).cache()
    for cc, names in (("US", ["zip5", "plus4"]), ("CA", ["fsa", "ldu"]), ("IE", ["routing_key", "unique_id"]), ("BR", ["region", "area", "suffix"]), ("GB", ["area", "district", "sector", "walk"])):
        rows = df.filter(F.col("t").startswith(cc))
        for n in names:
            for fn in (C.part, C.part_end):
                got = {r.t: r[1] for r in rows.select("t", fn("key", n, countries=[cc])).collect()}
                slow = {r.t: r[1] for r in rows.select("t", fn("key", n)).collect()}
                assert got == slow and len(got) >= 2, (n, got, slow)
                if fn is C.part:
                    assert got == {t: R.part(R.parse(t), n) for t in got}
        both = rows.select(C.parts("key", countries=[cc]).alias("a"), C.parts("key").alias("b"), C.parts("key", countries=[cc], jsonb_order=True).alias("c"), C.parts("key", jsonb_order=True).alias("d"))
        assert both.filter("a <> b or c <> d or a is null").count() == 0
    plan = spark.range(3).toDF("key").select(C.part("key", "area", countries=["GB"]), C.parts("key", countries=["US", "CA"]))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Python" not in plan
