from __future__ import annotations

import math

from pyspark.sql import functions as F

from spreadloom.functions import guards as G

INF, NAN = float("inf"), float("nan")


def values(spark, rows: list, schema: str, **columns) -> dict:
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = df.select(*[c.alias(k) for k, c in columns.items()]).collect()
    return {k: [r[k] for r in got] for k in columns}


def same(a, b) -> bool:
    return len(a) == len(b) and all(x == y or x is not None and y is not None and math.isnan(x) and math.isnan(y) for x, y in zip(a, b, strict=True))


def test_bounds(spark):
    v = F.col("v")
    got = values(spark, [(x,) for x in (NAN, INF, -INF, 1000.0, 999.0, -999.0, 0.0, None)], "v double", n=G.bounded(v), f=G.bounded(v, 7.0), c=G.clamp(v, -5.0, 5.0), s=G.safe_sqrt(v), l=G.safe_log(v), e=G.safe_exp(v))
    assert got["n"] == [0, 0, 0, 0, 999, -999, 0, 0]
    assert got["f"] == [7, 7, 7, 7, 999, -999, 0, 7]
    assert got["c"] == [-5, -5, -5, 5, 5, -5, 0, -5]
    assert got["s"] == [0, 0, 0, math.sqrt(1000), math.sqrt(999), 0, 0, 0]
    assert same([round(x, 9) for x in got["l"]], [NAN, NAN, NAN, round(math.log(1000), 9), round(math.log(999), 9), NAN, NAN, NAN])
    assert got["e"][6] == 1 and got["e"][0] == math.exp(-700) and all(math.isfinite(x) for x in got["e"])


def test_ratio(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (1.0, 1e-12), (1000.0, 2.0), (4.0, 1000.0), (900.0, 0.5), (NAN, 2.0), (None, 2.0), (-6.0, 3.0)]
    got = values(spark, rows, "a double, b double", q=G.ratio(F.col("a"), F.col("b")), f=G.ratio(F.col("a"), F.col("b"), 9.0))
    assert got["q"] == [0.5, 0, 0, 0, 0, 0, 0, 0, -2]
    assert got["f"] == [0.5, 9, 9, 4.5, 9, 9, 4.5, 4.5, -2]


def test_profit_and_capital(spark):
    rows = [(100.0, 50.0), (-100.0, 50.0), (10.0, 50.0), (NAN, 50.0), (10.0, 0.0), (10.0, -5.0)]
    got = values(spark, rows, "p double, s double", x=G.clamp_pnl(F.col("p"), F.col("s")))
    assert got["x"] == [25, -25, 10, -25, 0, 0]
    rows = [(0.5, 100.0), (-3.0, 100.0), (1001.0, 100.0), (900.0, 100.0), (NAN, 100.0), (INF, 0.2)]
    assert values(spark, rows, "n double, o double", x=G.next_capital(F.col("n"), F.col("o")))["x"] == [1, 1, 100, 900, 100, 1]


def test_log_return_and_annualised(spark):
    rows = [(110.0, 100.0), (0.0, 100.0), (100.0, -1.0), (NAN, 100.0), (1e-9, 100.0)]
    got = values(spark, rows, "p double, b double", r=G.log_return(F.col("p"), F.col("b")))["r"]
    assert same([round(x, 12) for x in got], [round(math.log(1.1), 12), NAN, NAN, NAN, NAN])
    rows = [(0.1, 365.0), (0.1, 0.5), (-1.0, 100.0), (-2.0, 100.0), (1e6, 1.0)]
    got = values(spark, rows, "t double, d double", y=G.annualised(F.col("t"), F.col("d")))["y"]
    assert round(got[0], 9) == 0.1 and got[1:4] == [0, -1, -1] and math.isfinite(got[4])
