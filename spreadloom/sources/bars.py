"""Where bars come from: files with an explicit schema, and bars built from fact and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.operators import pairs, series

#: A bar: one row a symbol and time.
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
REQUIRED = ("open", "high", "low", "close", "volume")

# What a request may ask for and what it must bring.
SYMBOLS = ("BTC/USD", "ETH/USD", "SOL/USD")
PAIRS = (("BTC/USD", "ETH/USD"), ("BTC/USD", "SOL/USD"), ("ETH/USD", "SOL/USD"))
MIN_DAYS, MAX_DAYS = 30, 730
MIN_BARS = 10_000


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def missing_columns(columns: Sequence[str]) -> list[str]:
    """The required columns that are not there."""
    return sorted(set(REQUIRED) - set(columns))


def normalised(df: DataFrame, time: str = "ts") -> DataFrame:
    """Bars with lower-case names and a UTC timestamp column ``ts``; raises if a required column is missing.

    The sessions's time zone is expected to be UTC. Other columns ride along.
    """
    df = lower_names(df)
    if missing := missing_columns(df.columns):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumn("ts", F.col(time.lower()).cast("timestamp"))


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some symbols in [start, end) from Parquet; symbols and times are filters that reach the scan."""
    df = normalised(spark.read.parquet(path))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col("ts") < F.lit(end).cast("timestamp"))


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Cached bars as written by :func:`sinks.write_csv`; the caller validates them again."""
    df = spark.read.option("header", True).schema(T.StructType([T.StructField("timestamp", T.TimestampType()), *BARS.fields[2:]])).csv(path, enforceSchema=False)
    return df.withColumnRenamed("timestamp", "ts").withColumn("symbol", F.lit(symbol))


def read_cache(spark: SparkSession, path: str, symbol: str, least: int = MIN_BARS) -> tuple[DataFrame, DataFrame]:
    """(validated bars, verdict) of a CSV cache: bars are validated again, and too few of them, missing columns or a file
    that cannot be read make ok false with the reason in error_message, and no bars."""
    from spreadloom.operators import quality

    def refused(why: str) -> tuple[DataFrame, DataFrame]:
        none = quality.validated(spark.createDataFrame([], BARS))
        return none, spark.createDataFrame([(symbol, 0, 0, False, why)], "symbol string, n_raw long, n_valid long, ok boolean, error_message string")

    try:
        header = [c.lower() for c in spark.read.option("header", True).csv(path).columns]
        if missing := missing_columns(header):
            return refused(f"missing columns: {', '.join(missing)}")
        types = {"timestamp": T.TimestampType(), **dict.fromkeys(REQUIRED, T.DoubleType())}
        raw = spark.read.option("header", True).schema(T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])).csv(path)
        raw = raw.select(F.lit(symbol).alias("symbol"), F.col("timestamp").alias("ts"), *REQUIRED)
        checked = quality.validated(quality.deduplicated(raw))
        verdict = quality.summary(raw, checked, least).select("symbol", "n_raw", "n_valid", "ok", "error_message")
        return (checked, verdict) if not raw.isEmpty() else refused(f"only 0 valid bars, {least} needed")
    except Exception as e:  # whatever is wrong with a cache is its verdict
        return refused(f"cache cannot be read: {type(e).__name__}")


def request_error(symbol: Column, start: Column, end: Column, zoned: Column) -> Column:
    """Why a request for bars is refused (the first reason), or an empty string."""
    days = F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000))
    return (
        F.when(~F.coalesce(symbol.isin(*SYMBOLS), F.lit(False)), F.lit("unsupported symbol"))
        .when(~F.coalesce(zoned, F.lit(False)), F.lit("times must have a zone"))
        .when(~F.coalesce(end > start, F.lit(False)), F.lit("end must be after start"))
        .when(days < MIN_DAYS, F.lit("range too short"))
        .when(days > MAX_DAYS, F.lit("range too long"))
        .otherwise(F.lit(""))
    )


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """B0: one bar a return flag and ship date, with the mean price of a unit and the units as volume."""
    # Summed in whole cents, so the price does not depend on the order of rows.
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double")
    price = F.floor(cents / (F.sum("l_quantity") * 100) * 1e6 + 0.5) / 1e6
    return lineitem.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts")).agg(price.alias("close"), F.sum("l_quantity").alias("volume"))


def smoothed_bars(lineitem: DataFrame, span: int = 60) -> DataFrame:
    """B1: closes are means of the last ``span`` daily ones, opens the close before; in buckets with the ``span`` days before."""
    near = series.haloed(pairs.indexed(daily_bars(lineitem), "symbol"), span)
    w = Window.partitionBy("symbol", "__bucket").orderBy("idx")
    smooth = near.withColumn("close", F.round(F.avg("close").over(w.rowsBetween(1 - span, 0)), 8))
    opened = series.without_halo(smooth.withColumn("open", F.when(F.col("idx") >= span, F.lag("close").over(w)).otherwise(F.col("close")))).where(F.col("idx") >= span - 1)
    return opened.select("symbol", "ts", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", "volume")


def event_bars(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """B2: tumbling bars of events, by type; first and last go by (ts, event_id)."""
    at = F.struct(F.col("ts").cast("timestamp"), "event_id")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    bars = rows.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
