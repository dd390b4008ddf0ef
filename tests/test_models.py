from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.functions import kernels as K
from spreadloom.operators import metrics, models, rolling, sizing
from spreadloom.plans import backtest


def reverting(n: int, theta: float = 0.1, sigma: float = 0.01, mu: float = 0.0, seed: int = 1) -> np.ndarray:
    rng, a, x = np.random.default_rng(seed), math.exp(-theta), [mu]
    sd = sigma * math.sqrt((1 - a * a) / (2 * theta))
    for e in rng.normal(0, sd, n - 1):
        x.append(mu + (x[-1] - mu) * a + e)
    return np.array(x)


def frame(spark, series: dict, name: str = "x"):
    return spark.createDataFrame([(k, i, float(v)) for k, xs in series.items() for i, v in enumerate(xs)], f"pair string, idx long, {name} double")


def test_hedge_finds_the_ratio_and_steps_over_gaps():
    rng = np.random.default_rng(0)
    b = np.cumsum(rng.normal(0, 0.01, 3000)) + 5
    a = 1.35 * b + 0.05 + rng.normal(0, 0.002, 3000)
    a[500], b[600] = np.nan, np.inf
    f = K.Hedge()
    states = [f.step(x, y) for x, y in zip(a, b, strict=True)]
    assert abs(states[-1][0] * b[-1] + states[-1][1] - a[-1]) < 0.02
    assert states[500][2:4] == (0.0, 0.0) and states[500][0] == states[499][0]
    assert [s[7] for s in states].index(True) == 100 and all(s[4] > 0 and s[5] > 0 and s[6] > 0 for s in states)
    with pytest.raises(ValueError):
        K.Hedge(q=0.0)


def test_hedge_goes_on_from_its_state():
    rng = np.random.default_rng(2)
    rows = list(zip(rng.normal(5, 1, 200), rng.normal(4, 1, 200), strict=True))
    whole, first = K.Hedge(), K.Hedge()
    want = [whole.step(*r) for r in rows]
    got = [first.step(*r) for r in rows[:90]]
    second = K.Hedge(state=first.state)
    assert got + [second.step(*r) for r in rows[90:]] == want


def test_mean_reversion_fit(spark):
    series = {"fast": reverting(4000, 0.5, 0.05, 0.2), "slow": reverting(4000, 0.05, 0.02, -0.1), "short": reverting(30), "walk": np.cumsum(np.random.default_rng(5).normal(0, 0.01, 4000)), "flat": np.ones(100)}
    got = {r.pair: r for r in rolling.fit_ou(frame(spark, series, "spread"), ["pair"], limit=float("inf")).collect()}
    assert abs(got["fast"].theta - 0.5) < 0.06 and abs(got["fast"].mu - 0.2) < 0.01 and abs(got["fast"].sigma - 0.05) < 0.005
    assert abs(got["slow"].half_life - math.log(2) / 0.05) < 4 and got["slow"].is_valid
    assert got["short"].error == "too few transitions" and got["flat"].error and not got["walk"].is_valid
    for k, xs in series.items():
        fit = K.fit_ou(xs, float("inf"))
        assert fit["is_valid"] == got[k].is_valid
        if fit["is_valid"]:
            assert all(math.isclose(fit[c], got[k][c], rel_tol=1e-6, abs_tol=1e-9) for c in ("theta", "mu", "sigma", "half_life", "sigma_eq"))


def test_stationarity(spark):
    rng = np.random.default_rng(12)
    series = {"revert": reverting(3000, 0.5, 0.05), "walk": np.cumsum(rng.normal(0.01, 0.01, 3000)), "noise": rng.normal(0, 0.01, 3000), "short": rng.normal(0, 1, 100)}
    got = {r.pair: r for r in models.stationarity(frame(spark, series), ["pair"]).collect()}
    assert got["revert"].adf.is_stationary and got["revert"].edge_confirmed and got["revert"].edge_type == "mean_reverting"
    assert not got["walk"].adf.is_stationary and not got["walk"].edge_confirmed
    assert got["noise"].adf.is_stationary and not got["noise"].ljung_box.has_autocorr and got["noise"].edge_type == "none"
    assert got["short"].reason == "series too short"


def test_reports_agree_with_the_relational_tests(spark):
    rng = np.random.default_rng(3)
    series = {"revert": reverting(1200, 0.3), "walk": np.cumsum(rng.normal(0, 1, 900)), "short": rng.normal(0, 1, 60), "gap": np.where(rng.random(700) < 0.05, np.nan, rng.normal(0, 1, 700))}
    rows = frame(spark, series)
    got = {r.pair: r for r in models.stationarity(rows, ["pair"]).collect()}
    steps = frame(spark, {k: np.diff(x[np.isfinite(x)]) for k, x in series.items()})
    for name, want in (("adf", models.unit_root(rows, ["pair"])), ("ljung_box", rolling.ljung_box(rows, ["pair"])), ("hurst", rolling.hurst(steps, ["pair"]))):
        for r in want.collect():
            for k, v in r.asDict().items():
                if k != "pair":
                    assert getattr(got[r.pair], name)[k] == (pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float | list) and v and None not in (v if isinstance(v, list) else [v]) else v), (r.pair, name, k)


def test_chi_squared_tail(spark):
    q = spark.createDataFrame([(9.236,), (15.987,), (28.412,), (0.0,)], "q double").coalesce(1)
    got = q.select(rolling.chi2_tail(F.col("q"), 5).alias("a"), rolling.chi2_tail(F.col("q"), 10).alias("b"), rolling.chi2_tail(F.col("q"), 20).alias("c")).collect()
    assert abs(got[0].a - 0.1) < 1e-4 and abs(got[1].b - 0.1) < 1e-4 and abs(got[2].c - 0.1) < 1e-4 and got[3].a == got[3].b == got[3].c == 1


def clusters(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    means = np.array([(0.3, 0.001, 1, 1), (1, 0.003, 1, 0.8), (2.5, 0.01, 2.5, 3)])
    return np.clip(np.concatenate([rng.normal(m, 0.1 * m + 1e-4, (300, 4)) for m in means]), 0, 10)


def test_regime_model(spark):
    obs = clusters()
    m = K.train_regimes(obs, 42)
    assert m["n_iters"] <= 100 and np.all(np.diff(m["log_likes"]) > -1e-3) and np.allclose(m["trans"].sum(1), 1) and math.isclose(m["pi"].sum(), 1)
    f = K.Regimes(m["pi"], m["trans"], m["mu"], m["sigma"])
    states = [f.step(o) for o in obs]
    runs = [Counter(s for _, s, _, _ in states[k + 20 : k + 300]).most_common(1)[0] for k in (0, 300, 600)]
    assert sum(n for _, n in runs) > 0.75 * 840 and len({s for s, _ in runs}) >= 2
    assert all(no == (s == 2) and scale == K.SCALES[s] for _, s, scale, no in states)
    before = f.log_alpha.copy()
    assert f.step(np.full(4, np.nan))[1:] == (0, 0.0, True) and np.array_equal(before, f.log_alpha)
    assert K.train_regimes(obs[:400], 1) is None
    rows = spark.createDataFrame([("p", k, *map(float, o)) for k, o in enumerate(obs)], "pair string, idx long, f0 double, f1 double, f2 double, f3 double")
    trained = models.train_regimes(rows)
    got = models.regimes(rows, trained).orderBy("idx").collect()
    assert [r.state for r in got] == [s for _, s, _, _ in states] and trained.first().n_train == 900


def test_features_by_window_and_by_kernel(spark):
    rng = np.random.default_rng(8)
    s, v, volume = rng.normal(0, 0.01, 200), rng.uniform(1e-5, 1e-3, 200), rng.uniform(10, 100, 200)
    rows = spark.createDataFrame([("p", k, *map(float, x)) for k, x in enumerate(zip(s, v, volume, strict=True))], "pair string, idx long, spread double, innov_var double, volume double")
    got = np.array([tuple(r) for r in rolling.features(rows).orderBy("idx").select("f0", "f1", "f2", "f3").collect()])
    assert np.allclose(got, K.mean_filled(K.regime_features(s, v, volume)), rtol=1e-9, atol=1e-9)


def test_sizes_of_columns_and_kernel_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(10_000.0, float(a), float(p), float(t), float(s), True, float(k), False) for a, p, t, s, k in zip(rng.uniform(0.5, 80, 40), rng.uniform(50, 900, 40), rng.uniform(0.01, 0.6, 40), rng.uniform(0.01, 0.2, 40), rng.choice([0, 0.5, 1], 40), strict=True)]
    rows += [(10_000.0, 50.0, 45_000.0, 0.5, 0.05, True, 1.0, True), (0.0, 50.0, 45_000.0, 0.5, 0.05, True, 1.0, False), (10_000.0, 0.0, 100.0, 0.5, 0.05, True, 1.0, False)]
    df = spark.createDataFrame(rows, "capital double, atr double, price double, theta double, sigma double, ou_valid boolean, scale double, no_trade boolean").coalesce(1)
    got = sizing.sized(df).collect()
    for r, x in zip(got, rows, strict=True):
        want = 0.0 if x[7] else K.position_size(*x[:5], x[6])
        assert math.isclose(r.position_usd, want, rel_tol=1e-9, abs_tol=1e-6) and r.is_valid == (want > 0)
        assert r.position_usd <= 0.3 * x[0]


def test_entry_threshold_is_the_best_on_its_grid():
    t = K.entry_threshold(0.1, 0.01, 0.01 / math.sqrt(0.2))
    assert K.COST < t < 4 * 0.01 / math.sqrt(0.2)
    assert K.entry_threshold(0.1, 0.01, 0.02, valid=False) == 0.03 and K.entry_threshold(0.1, 0.0, 0.0) == 0.01


def market(spark, n: int = 1500, seed: int = 11):
    rng = np.random.default_rng(seed)
    lb = np.cumsum(rng.normal(0, 0.0001, n))
    v = np.concatenate([rng.uniform(1, 100, 99), rng.uniform(1, 100, n)])
    mean = lambda k: np.convolve(v, np.ones(k) / k)[99 : n + 99]
    la = lb + 0.03 * (mean(10) / mean(100) - 1)  # a short mean less a long one returns slowly enough for the filter to leave it
    rows = [("A-B", k, k % 60 + 3600 * (k // 60), float(1000 * math.exp(x)), float(x), float(y), float(rng.uniform(1, 100)), k % 97 != 5) for k, (x, y) in enumerate(zip(la, lb, strict=True))]
    df = spark.createDataFrame(rows, "pair string, idx long, sec long, close_a double, lp_a double, lp_b double, volume_a double, valid boolean")
    return df.withColumn("ts", F.timestamp_seconds(F.col("sec") + F.lit(1_704_067_200))).withColumn("high_a", F.col("close_a") * 1.001).withColumn("low_a", F.col("close_a") * 0.999)


SETTINGS = backtest.Settings(stop_mult=0.5)


def test_backtest(spark):
    made, runs = backtest.backtest(market(spark), SETTINGS)
    r, trades = made.first(), backtest.trades(runs).orderBy("bar_entry").collect()
    assert r.ok and r.total_trades == len(trades) > 5 and r.initial_capital == 10_000
    assert all(t.bar_exit > t.bar_entry >= 300 and t.exit_reason in ("target", "emergency", "stop", "time") and t.bar_exit - t.bar_entry <= 60 + 20 for t in trades)
    assert all(a.bar_exit <= b.bar_entry for a, b in zip(trades, trades[1:], strict=False))
    assert math.isclose(trades[-1].capital_after, r.final_capital) and math.isclose(10_000 + sum(t.net_pnl for t in trades), r.final_capital, rel_tol=1e-9)
    equity = [x.equity for x in backtest.equity(runs).orderBy("idx").collect()]
    assert len(equity) == 1500 and equity[0] == 10_000 and equity[-1] == r.final_capital
    assert math.isclose(r.pct_high_mr + r.pct_low_mr + r.pct_breakdown, 100)
    short, _ = backtest.backtest(market(spark, 200), SETTINGS)
    assert not short.first().ok and "200 bars" in short.first().error
    with pytest.raises(ValueError):
        backtest.Settings(risk=0.5)


@pytest.mark.parametrize("batch", [75, 10_000])
def test_whole_series_in_batches(spark, batch):
    """Handing state from batch to batch gives what one window with all bars gives."""
    rows = market(spark).unionByName(market(spark, 399, 5).withColumn("pair", F.lit("C-D"))).unionByName(market(spark, 1100, 7).withColumn("pair", F.lit("E-F")).withColumn("valid", F.col("idx") % 5 != 0))
    want, want_runs = backtest.run(rows.withColumn("window_id", F.lit(1)).withColumn("i", F.col("idx")), SETTINGS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, runs = backtest.backtest(rows, SETTINGS)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for a, b, order in ((got, want, ["pair"]), (backtest.trades(runs), backtest.trades(want_runs), ["pair", "bar_entry"]), (backtest.equity(runs), backtest.equity(want_runs), ["pair", "idx"])):
        assert a.columns == b.columns
        a, b = (x.orderBy(*order).collect() for x in (a, b))
        assert len(a) == len(b) > 2
        for x, y in zip(a, b, strict=True):
            assert all(u == v or math.isclose(u, v, rel_tol=1e-12) for u, v in zip(x, y, strict=True)), (x, y)
    assert [r.ok for r in got.orderBy("pair").collect()] == [True, False, True] and runs.where("state is null and i >= 300").count() > 0


def test_state_of_a_whole_series_is_bounded():
    s = SETTINGS
    f = backtest._Filter(s)
    n = 400
    for k in range(12):
        i = np.arange(k * n, (k + 1) * n)
        x = np.sin(i / 9.0) / 100
        f(pd.DataFrame({"pair": "p", "i": i, "lp_a": x, "lp_b": x / 2, "close_a": 100.0, "high_a": 101.0, "low_a": 99.0, "volume_a": 1.0, "valid": True}))
    assert len(f.spread) == len(f.innov) == len(f.volume) == 500 and not f.waiting and f.k == 12 * n


def test_walk_forward(spark):
    verdicts, made, runs = backtest.walk_forward(market(spark), 600, 300, 300, SETTINGS)
    rows = made.orderBy("window_id").collect()
    assert [r.window_id for r in rows] == [1, 2, 3] and all(r.n_bars == 900 for r in rows)
    v = verdicts.first()
    assert v.n_windows == 3 and math.isclose(v.median_return, float(np.median([r.total_return for r in rows])))
    again = {tuple(r) for r in backtest.walk_forward(market(spark), 600, 300, 300, SETTINGS)[1].collect()}
    assert again == {tuple(r) for r in rows}
    with pytest.raises(ValueError):
        backtest.walk_forward(market(spark), 400, 300)


def test_given_regimes(spark):
    """A model for one window, one that holds from a later bar on, one that is not valid, and none."""
    def model(state: int) -> tuple:
        return ([float(k == state) for k in range(3)], [float(k == state) for _ in range(3) for k in range(3)], [1.0] * 12, [5.0] * 12)

    rows = market(spark)
    schema = "pair string, window_id int, at int, pi array<double>, trans array<double>, mu array<double>, sigma array<double>, is_valid boolean"
    table = spark.createDataFrame([("A-B", 1, 300, *model(2), True), ("A-B", 2, 600, *model(0), True), ("A-B", 3, 300, *model(2), False), ("X-Y", 1, 300, *model(0), True)], schema)
    _, made, runs = backtest.walk_forward(rows, 600, 300, 300, SETTINGS, table)
    got = {r.window_id: r for r in made.collect()}
    assert got[1].total_trades == 0 and got[1].pct_breakdown == 100 and got[3].pct_low_mr == 100
    assert math.isclose(got[2].pct_high_mr, 50) and math.isclose(got[2].pct_low_mr, 50)
    _, none, _ = backtest.walk_forward(rows, 600, 300, 300, SETTINGS, table.where("false"))
    plain = {r.window_id: r for r in none.collect()}
    assert plain[3] == got[3] and all(r.pct_low_mr == 100 for r in plain.values())
    early = backtest.trades(runs).where("window_id = 2 and bar_exit < 600").collect()
    assert early and all(t.regime_state == 1 for t in early)
    _, each, _ = backtest.walk_forward(rows, 600, 300, 300, SETTINGS, table.where("window_id = 1").drop("window_id", "at"))
    assert {(r.window_id, r.total_trades) for r in each.collect()} == {(1, 0), (2, 0), (3, 0)}


def test_verdicts(spark):
    def word(sharpes: list, returns: list, ok: list | None = None) -> str:
        rows = [("p", k, float(s), float(r), 1.0, 1.0, 0.1, 0.5, o) for k, (s, r, o) in enumerate(zip(sharpes, returns, ok or [True] * len(sharpes), strict=True))]
        return metrics.verdict(spark.createDataFrame(rows, "pair string, window_id int, sharpe double, total_return double, sortino double, calmar double, max_drawdown double, win_rate double, ok boolean")).first().verdict

    assert word([2, 2, 2], [1, 1, 1]) == "STRONG_EDGE" and word([0.6, 0.6, 2], [1, 1, 1]) == "DEPLOYABLE" and word([0.1, 0.2, 2], [1, 1, 1]) == "WEAK_EDGE"
    assert word([2, 2, 2], [1, -1, -1]) == "NOT_ROBUST" and word([2, 2, 2], [1, 1, 1], [True, True, False]) == "INSUFFICIENT_DATA"


def test_trade_ratios(spark):
    r = [0.01, -0.005, 0.02, 0.015, -0.01, 0.008, 0.012, -0.003, 0.018, 0.005]
    trades = spark.createDataFrame([("p", x * 10_000, x, k, k + 3) for k, x in enumerate(r)], "pair string, net_pnl double, trade_return double, bar_entry int, bar_exit int")
    m = metrics.trade_metrics(trades, ["pair"], F.lit(365.0)).first()
    a = np.array(r)
    assert math.isclose(m.sharpe, a.mean() / a.std(ddof=1) * math.sqrt(10)) and math.isclose(m.sortino, a.mean() / math.sqrt((a[a < 0] ** 2).mean()) * math.sqrt(10))
    assert m.wins == 7 and m.avg_holding_bars == 3 and math.isclose(m.profit_factor, a[a > 0].sum() / -a[a < 0].sum())


def plain_regimes(x: np.ndarray, seed: int) -> tuple:
    """Expectation-maximisation in logs, written out: (mu, sigma, trans, log-likelihoods)."""
    total = lambda v, axis: v.max(axis) + np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis))
    rng, t = np.random.default_rng(seed), len(x)
    picks = [int(rng.integers(0, t))]
    while len(picks) < 3:
        d = np.min([((x - x[j]) ** 2).sum(1) for j in picks], axis=0)
        picks.append(int(rng.choice(t, p=d / d.sum())))
    mu, sigma = x[picks].copy(), np.tile(x.std(0) + 1e-6, (3, 1))
    pi, trans, likes = np.full(3, 1 / 3), np.full((3, 3), 1 / 3), []
    for turn in range(100):
        density = -0.5 * (np.log(2 * np.pi * sigma**2).sum(1) + (((x[:, None] - mu) / sigma) ** 2).sum(2))
        density[np.abs(density) > 999] = -1e300
        ahead, behind = np.empty((t, 3)), np.zeros((t, 3))
        ahead[0] = np.log(pi) + density[0]
        for k in range(1, t):
            ahead[k] = total(ahead[k - 1][:, None] + np.log(trans), 0) + density[k]
        for k in range(t - 2, -1, -1):
            behind[k] = total(np.log(trans) + density[k + 1] + behind[k + 1], 1)
        likes.append(float(total(ahead[-1], 0)))
        if turn and abs(likes[-1] - likes[-2]) < 1e-4:
            break
        gamma = ahead + behind
        gamma = np.maximum(np.exp(gamma - total(gamma, 1)[:, None]), 1e-8)
        gamma /= gamma.sum(1, keepdims=True)
        xi = ahead[:-1, :, None] + np.log(trans) + (density + behind)[1:, None, :]
        xi = np.exp(xi - total(xi.reshape(t - 1, 9), 1)[:, None, None]).sum(0)
        pi = gamma[0] / gamma[0].sum()
        trans = np.maximum(xi / xi.sum(1, keepdims=True), 1e-8)
        trans /= trans.sum(1, keepdims=True)
        mu = gamma.T @ x / gamma.sum(0)[:, None]
        sigma = np.sqrt(np.maximum(np.einsum("tk,tkd->kd", gamma, (x[:, None] - mu) ** 2) / gamma.sum(0)[:, None], 1e-6))
    return mu, sigma, trans, likes


def test_training_equals_a_plain_one_in_logs():
    for seed in (1, 42):
        x = clusters(seed)[::1] + np.random.default_rng(seed).normal(0, 0.05, (900, 4))
        m, (mu, sigma, trans, likes) = K.train_regimes(x, seed), plain_regimes(x, seed)
        assert len(m["log_likes"]) == len(likes) and np.allclose(m["log_likes"], likes, rtol=1e-8)
        assert np.allclose(m["mu"], mu, rtol=1e-7, atol=1e-8) and np.allclose(m["sigma"], sigma, rtol=1e-7, atol=1e-8) and np.allclose(m["trans"], trans, rtol=1e-6, atol=1e-8)


def test_unit_root_equals_plain_regressions():
    rng = np.random.default_rng(6)
    for x in (reverting(900, 0.2), np.cumsum(rng.normal(0, 1, 700)), np.cumsum(np.convolve(rng.normal(0, 1, 803), [0.5, 0.3, 0.2, 0.4], "valid")) * 0.1 + reverting(800, 0.3)):
        d, most = np.diff(x), math.ceil(12 * (len(x) / 100) ** 0.25)

        def regression(lags: int, skip: int, x=x, d=d):
            rows = range(skip, len(d))
            z = np.array([[x[i], 1.0, *(d[i - k] for k in range(1, lags + 1))] for i in rows])
            y = d[skip:]
            coef = np.linalg.lstsq(z, y, rcond=None)[0]
            rest = y - z @ coef
            error = np.sqrt(rest @ rest / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
            return coef[0] / error, len(y) * math.log(rest @ rest / len(y)) + 2 * z.shape[1], len(y)

        lags = min(range(most + 1), key=lambda k: regression(k, most)[1])
        stat, _, n = regression(lags, lags)
        got = K.unit_root_test(x)
        assert (got["n_lags"], got["n_obs"]) == (lags, n) and math.isclose(got["statistic"], stat, rel_tol=1e-8)
