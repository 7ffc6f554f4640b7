"""Patterns as built-in expressions agree with their automata."""

import random

import pytest
from pyspark.sql import functions as F

from zonemark.functions import columns as C
from zonemark.functions.linear import line
from zonemark.plans.language import language
from zonemark.plans.registry import world_registry

R = world_registry()
LINES = {cc: line(R.format(cc).regex) for cc in R.countries() if R.format_name(cc) == "pattern"}


def test_most_patterns_are_lines():
    assert sum(x is not None for x in LINES.values()) == 160
    for cc, x in LINES.items():
        assert x is None or x.after[0] == language(R.format(cc).regex).size
    assert line(r"(A|BC)\d") is None and line(r"[A -]\d") is None and line(r"\d(-)?") is None


@pytest.mark.parametrize("countries", [sorted(c for c, x in LINES.items() if x)[k::6] for k in range(6)])
def test_lines_agree_with_automata(spark, countries):
    rng = random.Random(4)
    want = []
    reads = F.lit(None).cast("long")
    for cc in countries:
        fmt = R.format(cc)
        lang = fmt.lang()
        for _ in range(8):
            r = rng.choice([0, lang.size - 1, rng.randrange(lang.size)])
            t = lang.text(r)
            odd = list(t)
            odd[rng.randrange(len(odd))] = rng.choice("A0Z9 -")
            want += [(cc, x) for x in (t, t.lower(), t.replace(" ", "").replace("-", ""), " " + t, "".join(odd), f"{cc}-{t}", t[:-1])]
        reads = F.when(F.col("cc") == cc, C.to_postal_code("t", cc)).otherwise(reads)
    df = spark.createDataFrame(want, "cc string, t string").select("cc", "t", reads.alias("key"))
    plan = df.select(C.to_text("key", countries=countries))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in df.select("*", C.to_text("key", countries=countries).alias("s"), C.outcode("key", countries=countries).alias("o")).collect():
        k = R.parse(r.t, r.cc)
        assert r.key == k, r
        if k is not None:
            assert r.s == R.text(k) and r.o == R.outcode(k), (r, R.text(k), R.outcode(k))
