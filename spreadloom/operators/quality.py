"""Validation of bars: duplicates, prices, OHLC order, volume, spikes and gaps, with reasons that can be audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import guards as G
from spreadloom.operators import pairs, series

SPIKE, GAP_SECONDS = 0.20, 120
OHLC = ("open", "high", "low", "close")


def deduplicated(bars: DataFrame, order: list | None = None) -> DataFrame:
    """The first bar of each symbol and time, by ``order`` (the columns that tell which came first)."""
    first = Window.partitionBy("symbol", "ts").orderBy(*(order or [F.col(c) for c in (*OHLC, "volume")]))
    return bars.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def validated(bars: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Deduplicated bars with valid_bar, invalid_reason and log_return.

    Prices at or under 0 each give a reason; of the order checks the first that fails does, and only for bars whose
    prices are fine; a negative volume adds one. Log returns go from valid bar to valid bar; one beyond the spike limit
    makes its bar invalid and stays in the chain. NaN prices fail no check, as a comparison with NaN tells nothing.

    ``bucket`` (a month of ``ts`` by default) cuts a symbol's time in order: each bucket tells its last valid close and its
    last time, and the next ones start from them.
    """
    c = {n: F.col(n) for n in (*OHLC, "volume")}
    known = lambda *names: ~F.greatest(*[F.isnan(c[n]) for n in names], F.lit(False))
    less = lambda a, b: known(a, b) & (c[a] < c[b])
    prices = [F.when(known(n) & (c[n] <= 0), F.lit(f"{n}<=0")) for n in OHLC]
    n_price = sum((F.when(known(n) & (c[n] <= 0), 1).otherwise(0) for n in OHLC), F.lit(0))
    order = F.when(less("high", "open"), "high<open").when(less("high", "close"), "high<close").when(less("open", "low"), "low>open").when(less("close", "low"), "low>close").when(less("high", "low"), "high<low")
    checked = (
        bars.withColumn("n_price", n_price)
        .withColumn("order_error", F.when(F.col("n_price") == 0, order))
        .withColumn("bad_volume", F.coalesce(known("volume") & (c["volume"] < 0), F.lit(False)))
        .withColumn("fine", (F.col("n_price") == 0) & F.col("order_error").isNull() & ~F.col("bad_volume"))
    )
    checked = checked.withColumn("__bucket", pairs.month() if bucket is None else bucket)
    checked = series.carried(checked, ["symbol"], "__bucket", ("ts",), {"__before": F.when(F.col("fine"), F.col("close")), "__time": F.col("ts")})
    change = F.when(F.col("fine") & F.col("__before").isNotNull(), G.log_return(F.col("close"), F.col("__before")))
    spike = F.coalesce(~F.isnan("log_return") & (F.abs("log_return") > SPIKE), F.lit(False))
    return (
        checked.withColumn("log_return", change)
        .withColumn("spike", spike)
        .withColumn("gap", F.coalesce(F.unix_seconds("ts") - F.unix_seconds("__time") > GAP_SECONDS, F.lit(False)))
        .withColumn("valid_bar", F.col("fine") & ~F.col("spike"))
        .withColumn("invalid_reason", F.concat_ws("|", *prices, "order_error", F.when(F.col("bad_volume"), "volume<0"), F.when(F.col("spike"), "spike")))
        .withColumn("n_ohlc", F.col("n_price") + F.col("order_error").isNotNull().cast("int"))
        .drop("n_price", "order_error", "bad_volume", "fine", "__bucket", "__before", "__time")
    )


def summary(raw: DataFrame, checked: DataFrame, least: int = 10_000) -> DataFrame:
    """One row a symbol: counts of what was found, ok, error_message and warnings. One bad symbol fails no other."""
    n_raw = raw.groupBy("symbol").agg(F.count("*").alias("n_raw"))
    count = lambda c: F.count_if(c).alias
    found = checked.groupBy("symbol").agg(
        F.count("*").alias("n_kept"), count(F.col("valid_bar"))("n_valid"), count(~F.col("valid_bar"))("n_invalid"), count(F.col("gap"))("n_gaps"),
        F.sum("n_ohlc").cast("long").alias("n_ohlc_errors"), count(F.col("spike"))("n_spikes"),
    )
    out = n_raw.join(found, "symbol").withColumn("n_duplicates", F.col("n_raw") - F.col("n_kept")).withColumn("ok", F.col("n_valid") >= least)
    warn = F.filter(F.array(
        F.when(F.col("n_duplicates") > 0, F.format_string("%d duplicate timestamps removed", "n_duplicates")),
        F.when(F.col("n_spikes") > 0, F.format_string("%d bars flagged as spikes", "n_spikes")),
        F.when(F.col("n_gaps") > 0, F.format_string("%d gaps over %d s", "n_gaps", F.lit(GAP_SECONDS))),
    ), lambda x: x.isNotNull())
    error = F.when(F.col("ok"), "").otherwise(F.format_string("only %d valid bars, %d needed", "n_valid", F.lit(least)))
    return out.select("symbol", "n_raw", "n_valid", "n_invalid", "n_gaps", "n_duplicates", "n_ohlc_errors", "n_spikes", "ok", error.alias("error_message"), warn.alias("warnings"))
