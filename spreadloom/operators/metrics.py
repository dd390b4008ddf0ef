"""Trade, equity and walk-forward metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import guards as G
from spreadloom.operators import series

# Thresholds of the verdict.
SHARPE_DEPLOY, SHARPE_STRONG, PROFITABLE_SHARE, MIN_WINDOWS, FRAGILE = 0.5, 1.0, 0.60, 3, -1.0


def sharpe(r: Column, per_year: Column) -> Column:
    """Aggregate: mean over deviation of trade returns, annualised by trades a year."""
    sd = F.stddev_samp(r)
    value = G.ratio(F.avg(r), sd) * G.safe_sqrt(F.greatest(per_year, F.lit(1.0)))
    return F.when((F.count(r) < 2) | ~(sd >= G.MIN_DENOMINATOR), 0.0).otherwise(G.bounded(value))


def sortino(r: Column, per_year: Column) -> Column:
    """Aggregate: mean over the root mean square of negative returns, annualised by trades a year."""
    down = G.safe_sqrt(F.avg(F.when(r < 0, r * r)))
    value = G.ratio(F.avg(r), down) * G.safe_sqrt(F.greatest(per_year, F.lit(1.0)))
    return F.when((F.count(r) < 2) | (F.count_if(r < 0) < 2) | ~(down >= G.MIN_DENOMINATOR), 0.0).otherwise(G.bounded(value))


def calmar(yearly: Column, drawdown: Column) -> Column:
    return F.when(drawdown < G.MIN_DENOMINATOR, 0.0).otherwise(G.bounded(G.ratio(yearly, drawdown)))


def profit_factor(pnl: Column) -> Column:
    """Aggregate: gross win over gross loss within 0 to 9.99, which is also its value without a loss."""
    win, loss = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.coalesce(F.sum(F.when(pnl < 0, -pnl)), F.lit(0.0))
    return F.when(loss > G.MIN_DENOMINATOR, G.clamp(G.ratio(win, loss), 0.0, 9.99)).when(win > 0, 9.99).otherwise(0.0)


def trade_metrics(trades: DataFrame, keys: list[str], days: Column) -> DataFrame:
    """One row a key: counts, win rate, profit factor, mean profit and holding time, trades a year, Sharpe and Sortino.

    ``trades`` has net_pnl, trade_return, bar_entry and bar_exit; ``days`` is constant in a key. Returns of 1 or more
    either way stay out of the ratios.
    """
    pnl, r = F.col("net_pnl"), F.when(G.finite(F.col("trade_return")) & (F.abs("trade_return") < 1), F.col("trade_return"))
    n = F.count("*")
    per_year = n * (365.0 / F.greatest(F.first(days), F.lit(1.0)))
    return trades.groupBy(*keys).agg(
        n.alias("total_trades"), F.count_if(pnl > 0).alias("wins"), G.bounded(F.count_if(pnl > 0) / n).alias("win_rate"), profit_factor(pnl).alias("profit_factor"),
        (F.sum(pnl) / n).alias("avg_trade_usd"), G.bounded(F.avg(F.col("bar_exit") - F.col("bar_entry"))).alias("avg_holding_bars"),
        G.bounded(per_year).alias("trades_per_year"), sharpe(r, per_year).alias("sharpe"), sortino(r, per_year).alias("sortino"),
    )


def drawdowns(equity: DataFrame, keys: list[str], value: str = "equity", order: str = "idx", size: int = series.SIZE) -> DataFrame:
    """``peak`` and ``drawdown`` of each row of an equity curve, in buckets of ``size`` places of the ``order`` column."""
    found = series.running_max(equity.withColumn("__bucket", series.bucket_of(F.col(order), size)), keys, "__bucket", (order,), value, "peak")
    return found.drop("__bucket").withColumn("drawdown", (F.col("peak") - F.col(value)) / F.greatest("peak", F.lit(1.0)))


def regime_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Percentages of rows in states 0, 1 and 2."""
    share = lambda k: (F.count_if(F.col("state") == k) / F.count("*") * 100).alias
    return rows.groupBy(*keys).agg(share(0)("pct_high_mr"), share(1)("pct_low_mr"), share(2)("pct_breakdown"))


def verdict(results: DataFrame) -> DataFrame:
    """One row a pair from its windows' results: medians and shares of the valid ones, warnings and a verdict."""
    ok = F.col("ok")
    of = lambda c: F.when(ok, G.bounded(F.col(c)))
    med = lambda c, name: F.median(of(c)).alias(name)
    s = G.bounded(F.col("sharpe"))
    agg = results.groupBy("pair").agg(
        F.count("*").alias("n_windows"), F.count_if(ok).alias("n_valid"), med("total_return", "median_return"), med("sharpe", "median_sharpe"), med("sortino", "median_sortino"),
        med("calmar", "median_calmar"), med("max_drawdown", "median_maxdd"), med("win_rate", "median_winrate"),
        F.when(F.count_if(ok) > 0, F.count_if(ok & (F.col("total_return") > 0)) / F.greatest(F.count_if(ok), F.lit(1)) * 100).alias("pct_profitable"),
        F.when(F.count_if(ok) > 0, F.count_if(ok & (s >= SHARPE_DEPLOY)) / F.greatest(F.count_if(ok), F.lit(1)) * 100).alias("pct_sharpe_gt_half"),
        F.when(F.count_if(ok) > 0, F.count_if(ok & (s >= SHARPE_STRONG)) / F.greatest(F.count_if(ok), F.lit(1)) * 100).alias("pct_sharpe_gt_one"),
        F.count_if(ok & (s < FRAGILE)).alias("n_fragile"),
    )
    enough = F.col("n_valid") >= MIN_WINDOWS
    numbers = [c for c in agg.columns if c.startswith(("median_", "pct_"))]
    agg = agg.withColumns({c: F.when(enough, F.col(c)).otherwise(0.0) for c in numbers})
    word = (
        F.when(~enough, "INSUFFICIENT_DATA").when(F.col("pct_profitable") < PROFITABLE_SHARE * 100, "NOT_ROBUST")
        .when(F.col("median_sharpe") >= SHARPE_STRONG, "STRONG_EDGE").when(F.col("median_sharpe") >= SHARPE_DEPLOY, "DEPLOYABLE").otherwise("WEAK_EDGE")
    )
    return agg.withColumn("verdict", word).withColumn("deployable", F.col("verdict").isin("STRONG_EDGE", "DEPLOYABLE"))


def best_window(results: DataFrame) -> DataFrame:
    """Each pair's valid window with the highest Sharpe, the first of equals."""
    w = Window.partitionBy("pair").orderBy(F.desc("sharpe"), "window_id")
    return results.where("ok").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def best_pair(verdicts: DataFrame) -> DataFrame:
    """The deployable pair with the highest median Sharpe."""
    return verdicts.where("deployable").orderBy(F.desc("median_sharpe"), "pair").limit(1)
