from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spreadloom.operators import metrics, models, pairs, quality, rolling, sizing
from spreadloom.sources import bars, sinks

START = dt.datetime(2024, 1, 1)


def clean(n: int, symbol: str = "A", step: int = 60) -> list:
    return [(symbol, START + dt.timedelta(seconds=step * k), 100.0, 101.0, 99.0, 100.0 + k % 3 * 0.1, 5.0) for k in range(n)]


def frame(spark, rows: list):
    return spark.createDataFrame(rows, bars.BARS)


def changed(rows: list, k: int, **new) -> None:
    names = bars.BARS.names
    rows[k] = tuple(new.get(c, v) for c, v in zip(names, rows[k], strict=True))


def test_reasons(spark):
    rows = clean(20)
    changed(rows, 1, close=0.0)
    changed(rows, 2, open=-500.0, volume=-1.0)
    changed(rows, 3, high=98.0)
    changed(rows, 4, close=600.0)
    changed(rows, 6, open=130.0, high=131.0, low=99.0, close=130.0)
    changed(rows, 8, volume=-1.0)
    changed(rows, 9, low=100.5)
    changed(rows, 10, close=float("nan"))
    got = {r.ts: r for r in quality.validated(frame(spark, rows)).collect()}
    reason = [got[r[1]].invalid_reason for r in rows]
    assert reason[:11] == ["", "close<=0", "open<=0|volume<0", "high<open", "high<close", "", "spike", "spike", "volume<0", "low>open", ""]
    assert [got[r[1]].valid_bar for r in rows][:9] == [True, False, False, False, False, True, False, False, False]
    assert got[rows[0][1]].log_return is None and got[rows[5][1]].log_return is not None


def test_duplicates_gaps_and_summary(spark):
    rows = clean(900) + clean(50)
    late = [(s, t + dt.timedelta(hours=3) if k >= 500 else t, *rest) for k, (s, t, *rest) in enumerate(rows[:900])] + [(s, t, *rest) for s, t, *rest in rows[900:]]
    raw = frame(spark, late + clean(10, "B"))
    got = {r.symbol: r for r in quality.summary(raw, quality.validated(quality.deduplicated(raw)), 800).collect()}
    assert (got["A"].n_raw, got["A"].n_duplicates, got["A"].n_gaps, got["A"].n_valid, got["A"].ok) == (950, 50, 1, 900, True)
    assert not got["B"].ok and "10 valid" in got["B"].error_message and got["A"].warnings[0] == "50 duplicate timestamps removed"


def test_requests(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [("DOGE/USD", day(0), day(60), True), ("BTC/USD", day(0), day(60), False), ("BTC/USD", day(5), day(0), True), ("BTC/USD", day(0), day(9), True), ("ETH/USD", day(0), day(1100), True), ("SOL/USD", day(0), day(60), True)]
    got = spark.createDataFrame(rows, "s string, a timestamp, b timestamp, z boolean").coalesce(1).select(bars.request_error(F.col("s"), F.col("a"), F.col("b"), F.col("z")).alias("e")).collect()
    assert [r.e for r in got] == ["unsupported symbol", "times must have a zone", "end must be after start", "range too short", "range too long", ""]


def test_files_round_trip(spark, tmp_path):
    df = frame(spark, clean(30) + clean(30, "B/C"))
    sinks.write_bars(df, f"{tmp_path}/bars")
    back = bars.read_bars(spark, f"{tmp_path}/bars", ["A"], "2024-01-01 00:05:00", "2024-01-01 00:10:00")
    assert sorted(r.ts.minute for r in back.collect()) == [5, 6, 7, 8, 9]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    path = sinks.write_csv(df, "B/C", str(tmp_path))
    assert path.endswith("B_C_1min.csv")
    again = bars.read_csv(spark, path, "B/C")
    assert sorted(map(tuple, again.select(*bars.BARS.names).collect())) == sorted(map(tuple, df.where("symbol = 'B/C'").collect()))
    with pytest.raises(ValueError, match="missing columns: volume"):
        bars.normalised(df.drop("volume"))


def test_alignment_and_windows(spark):
    a, b = clean(40), clean(40, "B")
    changed(b, 7, close=0.0)
    both = pairs.aligned(quality.validated(frame(spark, a + b[5:])), pairs.all_pairs(frame(spark, a + b)))
    got = pairs.indexed(both).orderBy("idx").collect()
    assert len(got) == 35 and got[0].pair == "A-B" and [r.valid for r in got].count(False) == 1 and not got[2].valid
    w = pairs.windowed(pairs.indexed(both), 20, 5).groupBy("window_id").agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.min("i").alias("i")).orderBy("window_id").collect()
    assert [(r.window_id, r.n, r.a, r.i) for r in w] == [(1, 20, 0, 0), (2, 20, 5, 0), (3, 20, 10, 0), (4, 20, 15, 0)]
    short = pairs.windowed(pairs.indexed(both), 99, 5, whole_if_short=True)
    assert short.count() == 35 and short.select("window_id").distinct().collect()[0][0] == 1 and pairs.windowed(pairs.indexed(both), 99, 5).count() == 0


def test_as_of(spark):
    rows = spark.range(10).selectExpr("'p' AS pair", "id AS idx")
    given = spark.createDataFrame([("p", 2, 1.0), ("p", 6, 2.0), ("q", 0, 9.0)], "pair string, idx long, theta double")
    assert [r.theta for r in pairs.as_of(rows, given).orderBy("idx").collect()] == [None, None, 1, 1, 1, 1, 2, 2, 2, 2]


def test_true_range(spark):
    rows = [("A", START + dt.timedelta(minutes=k), 0.0, h, low, c, 1.0) for k, (h, low, c) in enumerate([(10.0, 8.0, 9.0), (12.0, 11.0, 11.5), (11.0, 7.0, 8.0)])]
    assert [r.tr for r in rolling.true_range(frame(spark, rows)).orderBy("ts").collect()] == [2, 3, 4.5]


def test_cached_bars_are_validated_again(spark, tmp_path):
    rows = clean(900)
    changed(rows, 3, close=0.0)
    path = sinks.write_csv(frame(spark, rows + rows[:5]), "A", str(tmp_path))
    checked, verdict = bars.read_cache(spark, path, "A", 800)
    v = verdict.first()
    assert (v.symbol, v.n_raw, v.n_valid, v.ok, v.error_message) == ("A", 905, 899, True, "") and checked.count() == 900
    v = bars.read_cache(spark, path, "A")[1].first()
    assert not v.ok and v.n_valid == 899 and "899 valid" in v.error_message
    frame(spark, rows).drop("volume").withColumnRenamed("ts", "timestamp").write.option("header", True).csv(f"{tmp_path}/short.csv")
    none, verdict = bars.read_cache(spark, f"{tmp_path}/short.csv", "A")
    assert verdict.first().error_message == "missing columns: volume" and none.count() == 0
    assert not bars.read_cache(spark, f"{tmp_path}/nowhere.csv", "A")[1].first().ok


def test_numbers_do_not_depend_on_buckets(spark):
    rows = [("A" if k % 3 else "B", START + dt.timedelta(days=k * 7 % 400), float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "pair string, ts timestamp, x double").repartition(5)
    got = {(r.pair, r.ts): r.idx for r in pairs.indexed(df).collect()}
    want = {}
    for p in "AB":
        want |= {(p, t): k for k, t in enumerate(sorted(t for q, t, _ in rows if q == p))}
    assert got == want


def test_reports_and_trade_log(spark, tmp_path):
    verdict = spark.createDataFrame([("A", 10, 9, 1, 0, 0, 1, 0)], "symbol string, n_raw long, n_valid long, n_invalid long, n_gaps long, n_duplicates long, n_ohlc_errors long, n_spikes long")
    assert sinks.quality_report(verdict).first().line == "A: 10 raw, 9 valid, 1 invalid, 0 gaps, 0 duplicates, 1 OHLC errors, 0 spikes"
    made = spark.createDataFrame([("p", 1, 0.5, 1.25, 3, True, ""), ("p", 2, -0.5, 0.0, 0, True, ""), ("p", 3, 0.0, 0.0, 0, False, "too few")], "pair string, window_id int, total_return double, sharpe double, total_trades int, ok boolean, error string")
    assert [r.line for r in sinks.backtest_report(made).orderBy("window_id").collect()] == ["Window 1: return=+50.00%  Sharpe=1.250  trades=3  PROFIT", "Window 2: return=-50.00%  Sharpe=0.000  trades=0  LOSS", "Window 3: FAILED (too few)"]
    steps = spark.createDataFrame([("p", k, float((k * 7919) % 101) / 100) for k in range(600)], "pair string, idx long, x double")
    assert "p, 600 rows:" in sinks.stationarity_report(models.stationarity(steps, ["pair"])).first().line
    hedge = spark.createDataFrame([("p", 5, 4, -1.0, 1.0, 0.0, 0.5, 1.5, 0.25)], "pair string, n_bars long, n_warmed_up long, spread_min double, spread_max double, spread_mean double, spread_std double, beta_last double, alpha_last double")
    assert sinks.hedge_report(hedge).first().line.endswith("last beta 1.5000 and alpha 0.250000")
    fits = spark.createDataFrame([("p", 1, 0.1, 0.0, 0.2, 6.9, 0.4, True, ""), ("p", 2, 0.0, 0.0, 0.0, 0.0, 0.0, False, "degenerate series")], "pair string, window_id int, theta double, mu double, sigma double, half_life double, sigma_eq double, is_valid boolean, error string")
    assert [r.line for r in sinks.mean_reversion_report(fits).orderBy("window_id").collect()] == ["theta 0.100000, mu 0.000000, sigma 0.200000, half-life 6.90 rows, equilibrium deviation 0.400000", "no fit: degenerate series"]
    case = spark.createDataFrame([(10_000.0, 50.0, 900.0, 0.5, 0.05, True, 1.0, False), (10_000.0, 50.0, 900.0, 0.5, 0.05, True, 1.0, True)], "capital double, atr double, price double, theta double, sigma double, ou_valid boolean, scale double, no_trade boolean")
    lines = [r.line for r in sinks.size_report(sizing.sized(case)).collect()]
    assert lines[0].startswith("position ") and lines[1] == "no position: no trade in this regime"
    sinks.write_report(sinks.size_report(sizing.sized(case)), f"{tmp_path}/report")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/report").collect()) == sorted(lines)
    trade = [("p", w, e, e + 3, d, 0.1, 0.2, 100.0, 10.0, 9.98, 0.000998, "target", 1, 5.0, 10_009.98) for w, e, d in ((1, 5, 1), (1, 2, -1), (2, 7, 1))]
    log = spark.createDataFrame(trade, "pair string, window_id int, bar_entry int, bar_exit int, direction int, entry_spread double, exit_spread double, position_usd double, raw_pnl double, net_pnl double, trade_return double, exit_reason string, regime_state int, half_life double, capital_after double")
    sinks.write_trade_log(log, made, f"{tmp_path}/log")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/log")
    assert sorted((r.pair, r.bar_entry, r.direction, r.trade_return) for r in back.collect()) == [("p", 2, "short", 0.0998), ("p", 5, "long", 0.0998)]
    ranked = spark.createDataFrame([("a", 0.7, True), ("b", 0.9, True), ("c", 2.0, False), ("d", 0.9, True)], "pair string, median_sharpe double, deployable boolean")
    assert [r.pair for r in metrics.best_pair(ranked).collect()] == ["b"]
    assert sinks.walk_forward_report(spark.createDataFrame([("p", "WEAK_EDGE", 3, 4, 0.25, 66.67)], "pair string, verdict string, n_valid long, n_windows long, median_sharpe double, pct_profitable double")).first().line == "p: WEAK_EDGE, 3 of 4 windows valid, median Sharpe 0.250, 66.7% profitable"
