"""Where results go: partitioned bars, CSV caches, the trade log and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet, a folder for each symbol, so that a scan for one symbol reads that only."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.partitionBy("symbol").mode("overwrite").parquet(path)


def cache_name(symbol: str) -> str:
    return symbol.replace("/", "_") + "_1min.csv"


def write_csv(bars: DataFrame, symbol: str, folder: str) -> str:
    """The bars of one symbol as a CSV folder in ``folder``; returns its path."""
    path = f"{folder.rstrip('/')}/{cache_name(symbol)}"
    own = bars.where(F.col("symbol") == symbol).withColumnRenamed("ts", "timestamp")
    first = ["timestamp", "open", "high", "low", "close", "volume"]
    own.select(*first, *[c for c in own.columns if c not in (*first, "symbol")]).sort("timestamp").write.option("header", True).mode("overwrite").csv(path)
    return path


def trade_log(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """The trades of each pair's best valid window by Sharpe (the first of equals), as they are written to CSV."""
    best = windows.where("ok").groupBy("pair").agg(F.max_by("window_id", F.struct("sharpe", (-F.col("window_id")).alias("m"))).alias("window_id"))
    return trades.join(best, ["pair", "window_id"]).select(
        "pair", "bar_entry", "bar_exit", F.when(F.col("direction") == 1, "long").otherwise("short").alias("direction"),
        F.round("entry_spread", 8).alias("entry_spread"), F.round("exit_spread", 8).alias("exit_spread"), F.round("position_usd", 2).alias("position_usd"),
        F.round("raw_pnl", 2).alias("raw_pnl"), F.round("net_pnl", 2).alias("net_pnl"), F.round(F.col("trade_return") * 100, 4).alias("trade_return"),
        "exit_reason", "regime_state", F.round("half_life", 2).alias("half_life_bars"), F.round("capital_after", 2).alias("capital_after"),
    )


def write_trade_log(trades: DataFrame, windows: DataFrame, path: str) -> None:
    trade_log(trades, windows).repartition("pair").sortWithinPartitions("bar_entry").write.partitionBy("pair").option("header", True).mode("overwrite").csv(path)


def line(text: str, *columns: Column | str) -> Column:
    """One line of a report."""
    return F.format_string(text, *columns)


def quality_report(summary: DataFrame) -> DataFrame:
    """A line for each symbol's bar quality."""
    return summary.select("symbol", line("%s: %d raw, %d valid, %d invalid, %d gaps, %d duplicates, %d OHLC errors, %d spikes", "symbol", "n_raw", "n_valid", "n_invalid", "n_gaps", "n_duplicates", "n_ohlc_errors", "n_spikes").alias("line"))


def backtest_report(results: DataFrame) -> DataFrame:
    """A line for each window's result, as in the walk-forward summary; failed ones say why."""
    text = line("Window %d: return=%+.2f%%  Sharpe=%.3f  trades=%d  %s", "window_id", F.col("total_return") * 100, "sharpe", "total_trades", F.when(F.col("total_return") > 0, "PROFIT").otherwise("LOSS"))
    return results.select("pair", "window_id", F.when(F.col("ok"), text).otherwise(line("Window %d: FAILED (%s)", "window_id", "error")).alias("line"))


def walk_forward_report(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("pair", line("%s: %s, %d of %d windows valid, median Sharpe %.3f, %.1f%% profitable", "pair", "verdict", "n_valid", "n_windows", "median_sharpe", "pct_profitable").alias("line"))


def stationarity_report(reports: DataFrame) -> DataFrame:
    """A line for each report of the three tests and the edge they confirm."""
    tests = line("unit root %.4f (p %.4f), exponent %.4f (r2 %.4f), least portmanteau p %.4f", "adf.statistic", "adf.pvalue", "hurst.exponent", "hurst.r_squared", "ljung_box.min_pvalue")
    keys = [c for c in reports.columns if c in ("pair", "symbol", "window_id")]
    return reports.select(*keys, F.concat_ws(" ", line("%s, %d rows:", F.col(keys[0]), "series_length"), F.when(F.col("edge_confirmed"), line("edge (%s),", "edge_type")).otherwise(line("no edge (%s),", "reason")), tests).alias("line"))


def hedge_report(summary: DataFrame) -> DataFrame:
    """A line for each pair's hedge filter."""
    return summary.select("pair", line("%s: %d rows, %d warmed up, spread %.6f to %.6f (mean %.6f, deviation %.6f), last beta %.4f and alpha %.6f", "pair", "n_bars", "n_warmed_up", "spread_min", "spread_max", "spread_mean", "spread_std", "beta_last", "alpha_last").alias("line"))


def mean_reversion_report(fits: DataFrame) -> DataFrame:
    """A line for each fit; failed ones say why."""
    text = line("theta %.6f, mu %.6f, sigma %.6f, half-life %.2f rows, equilibrium deviation %.6f", "theta", "mu", "sigma", "half_life", "sigma_eq")
    keys = [c for c in fits.columns if c in ("pair", "symbol", "window_id")]
    return fits.select(*keys, F.when(F.col("error") == "", F.concat(text, F.when(F.col("is_valid"), "").otherwise(" (too slow)"))).otherwise(line("no fit: %s", "error")).alias("line"))


def size_report(sizes: DataFrame) -> DataFrame:
    """A line for each sized position; others say why there is none."""
    text = line("position %.2f, growth fraction %.4f, win probability %.4f, reward to risk %.4f", "position_usd", "kelly_fraction", "win_prob", "reward_risk")
    return sizes.select(F.when(F.col("is_valid"), text).otherwise(line("no position: %s", "reason")).alias("line"))


def write_report(lines: DataFrame, path: str) -> None:
    """Lines as text files."""
    lines.select("line").write.mode("overwrite").text(path)
