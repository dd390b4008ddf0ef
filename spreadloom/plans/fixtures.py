"""Bars, pairs and trades derived from the fact tables, over whole tables, for the registered queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.operators import metrics, pairs
from spreadloom.sources import bars, scratch

DAYS = 250.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.smoothed_bars(table(spark, sf_dir, "lineitem"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of smoothed bars, aligned and indexed, stored once for all that a query makes of them."""
    b = scratch.stored(smooth(spark, sf_dir), "bars")
    return scratch.stored(pairs.indexed(pairs.aligned(b, pairs.all_pairs(b))), "pair-rows")


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static spread of each pair, with a stand-in for the filter's innovation variance."""
    found = pairs.static_spread(rows(spark, sf_dir))
    return found.withColumn("volume", F.col("volume_a")).withColumn("innov_var", F.pow(F.col("lp_a") - F.col("lp_b"), F.lit(2.0)) + 1e-6)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of which some break a rule."""
    b = pairs.numbered(bars.daily_bars(table(spark, sf_dir, "lineitem")), "symbol", pairs.month(), ("ts",), "k").withColumn("k", F.col("k") + 1)
    every = lambda n: F.col("k") % n == 0
    c = F.col("close")
    return b.select(
        "symbol", "ts", F.when(every(89), -500.0).otherwise(c).alias("open"), F.when(every(83), c * 0.9 - 10).otherwise(c * 1.01).alias("high"), (c * 0.99).alias("low"),
        F.when(every(97), 0.0).when(every(79), c + 500).otherwise(c).alias("close"), F.when(every(71), -1.0).otherwise(F.col("volume")).alias("volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a trade of a thousand dollars, in order (``k``), in windows of five hundred."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pnl = F.round((F.col("l_discount") - 0.05) * 1000 - 2, 6)
    t = pairs.numbered(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_shipdate"), order, "k")
    t = t.select(F.col("l_returnflag").alias("pair"), (F.col("k") + 1).alias("k"), pnl.alias("net_pnl"), (F.col("l_linenumber") % 3).alias("state"), F.col("l_quantity").cast("long").alias("held"))
    return t.select("pair", "k", (F.floor((F.col("k") - 1) / 500) + 1).cast("int").alias("window_id"), "net_pnl", (F.col("net_pnl") / 10_000).alias("trade_return"), F.col("k").alias("bar_entry"), (F.col("k") + F.col("held")).alias("bar_exit"), "state")


def window_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row for each window of the derived trades."""
    t, keys = trades(spark, sf_dir), ["pair", "window_id"]
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    down = metrics.drawdowns(t.withColumn("equity", F.lit(10_000.0) + F.sum("net_pnl").over(w)), keys, order="k").groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), (F.sum("net_pnl") / 10_000).alias("total_return"))
    out = metrics.trade_metrics(t, keys, F.lit(DAYS)).join(down, keys)
    yearly = F.col("total_return") * (365.0 / DAYS)
    return out.withColumn("calmar", metrics.calmar(yearly, F.col("max_drawdown"))).withColumn("ok", F.col("total_trades") >= 100)


def reverting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose first leg follows the second and returns to it: a short mean less a long one is what parts them."""
    found = rows(spark, sf_dir)
    w = Window.partitionBy("pair").orderBy("idx")
    gap = F.avg("volume_a").over(w.rowsBetween(-9, 0)) / F.avg("volume_a").over(w.rowsBetween(-99, 0)) - 1
    # Logs near 0 are where the filter's hedge moves slowly enough to leave the spread alone; prices are in thousandths of
    # what the logs count, as a stop of next to nothing has no bounded volatility size.
    flat = 0.1 * (F.col("lp_b") - float(np.log(2500.0)))
    lp = flat + 0.1 * gap
    price = 1000 * F.exp(lp)
    return found.withColumn("lp_b", flat).withColumn("lp_a", lp).withColumn("close_a", price).withColumn("high_a", price * 1.0005).withColumn("low_a", price * 0.9995)
