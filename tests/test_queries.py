"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

import os

import duckdb
import pytest

from zonemark import queries as Q


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, con, small, name):
    got = Q.QUERIES[name](spark, small)
    want = con.sql(Q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("cc", ["GB", "NL", "CZ"])
def test_prefix_check_sees_every_country(spark, small, monkeypatch, cc):
    """Ranges of one country that are empty are reported."""
    real = Q.joins.resolve_fragments

    def wrong(fragments, fragment="fragment", registry=None):
        hi = Q.F.when(Q.F.col(fragment).startswith(cc), Q.F.col("lo")).otherwise(Q.F.col("hi"))
        return real(fragments, fragment, registry).withColumn("hi", hi)

    monkeypatch.setattr(Q.joins, "resolve_fragments", wrong)
    assert Q.QUERIES["prefix_check"](spark, small).first()[0] > 0


def test_prefix_failures_of_the_uk_format(spark):
    """GB-B is area B, whatever texts begin so; outcodes and fragments with a space are held to the text."""
    texts = [("GB", "B1 1AA"), ("GB", "BA1 1AA"), ("GB", "BA10 1AA"), ("GB", "BA10"), ("JE", "JE2 3XX")]
    rows = Q.quality.with_codes(spark.createDataFrame(texts, "cc string, t string"), "t", "cc")
    assert rows.filter("key is null").count() == 0
    assert Q.quality.prefix_failures(rows, [4, 5, 6, 7, 8, 9]).collect() == []
