"""Series in buckets against the same series in one piece."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.functions import kernels as K
from spreadloom.operators import metrics, models, pairs, quality, rolling, scans, series
from spreadloom.sources import bars

START = dt.datetime(2024, 1, 1)


def frame(spark, values: dict, *names: str):
    rows = [(k, i, *(float(x) for x in v)) for k, vs in values.items() for i, v in enumerate(zip(*vs, strict=True))]
    return spark.createDataFrame(rows, "pair string, idx long, " + ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.mark.parametrize(("period", "size"), [(1, None), (2, None), (14, None), (14, 7), (14, 1), (1000, 50)])
def test_exponential_mean(spark, period, size):
    rng = np.random.default_rng(period)
    values = {"a": [rng.uniform(0, 5, 700)], "b": [rng.normal(0, 1, 1)], "c": [np.where(np.arange(400) < 200, 1e6, 1e-3)]}
    got = series.ema(frame(spark, values, "x"), "pair", F.col("x"), period, "y", size)
    assert got.columns == ["pair", "idx", "x", "y"]
    k = 2 / (period + 1)
    for name, (xs,) in values.items():
        y, want = xs[0], []
        for i, x in enumerate(xs):
            y = x if i == 0 else k * x + (1 - k) * y
            want.append(y)
        mine = [r.y for r in got.where(F.col("pair") == name).orderBy("idx").collect()]
        assert np.allclose(mine, want, rtol=1e-9, atol=1e-12)


def ohlc(rng, n: int, symbol: str, step: int = 7200) -> list:
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(symbol, START + dt.timedelta(seconds=step * k), c, c * 1.01, c * 0.98, c, 5.0) for k, c in enumerate(close.tolist())]


def test_average_true_range_needs_no_python(spark):
    rng = np.random.default_rng(1)
    rows = ohlc(rng, 900, "A") + ohlc(rng, 1, "B") + ohlc(rng, 40, "C", 86_400 * 9)
    df = spark.createDataFrame(rows, bars.BARS).repartition(4)
    plan = models.atr(df)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    for size in (None, 10, 1):
        got = {(r.symbol, r.ts): r.atr for r in models.atr(df, size=size).collect()}
        for s in "ABC":
            own = [r for r in rows if r[0] == s]
            want = K.average_true_range(*(np.array([r[k] for r in own]) for k in (3, 4, 5)))
            assert np.allclose([got[s, r[1]] for r in own], want, rtol=1e-10)


def test_validation_by_bucket(spark):
    rng = np.random.default_rng(2)
    rows = ohlc(rng, 400, "A", 60) + ohlc(rng, 300, "B", 90)
    rows = [(s, t + dt.timedelta(hours=k // 100), o, h, low, c * (1.5 if k % 41 == 0 else 1.0) if k % 13 else -1.0, v) for k, (s, t, o, h, low, c, v) in enumerate(rows)]
    rows = [(*r[:3], max(r[3], r[5]), *r[4:]) for r in rows] + [("A", None, 1.0, 1.0, 1.0, 1.0, 1.0), (None, START, 1.0, 1.0, 1.0, 1.0, 1.0), (None, START + dt.timedelta(hours=9), 9.0, 9.0, 9.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, bars.BARS)
    by = lambda b: sorted(map(tuple, quality.validated(df, b).collect()), key=repr)
    whole = by(F.lit(0))
    assert len(whole) == len(rows) and sum(r[-2] for r in whole if isinstance(r[-2], bool)) >= 0
    assert by(F.date_trunc("hour", "ts")) == whole and by(F.date_trunc("minute", "ts")) == whole and by(None) == whole
    checked = quality.validated(df)
    assert checked.where("spike").count() > 5 and checked.where("gap").count() > 5 and checked.where("log_return is not null").count() > 500


def test_features_drawdown_and_parameters_by_bucket(spark):
    rng = np.random.default_rng(3)
    s, v, volume = rng.normal(0, 1, 333), rng.uniform(1e-5, 1e-3, 333), rng.uniform(10, 100, 333)
    s[[40, 41, 150]] = np.nan
    rows = frame(spark, {"p": [s, v, volume], "q": [s[:5], v[:5], volume[:5]]}, "spread", "innov_var", "volume")
    for size in (20, 33, 4096):
        got = rolling.features(rows, size=size)
        assert got.count() == 338
        mine = np.array([tuple(r) for r in got.where("pair = 'p'").orderBy("idx").select("f0", "f1", "f2", "f3").collect()])
        assert np.allclose(mine, K.mean_filled(K.regime_features(s, v, volume)), rtol=1e-9, atol=1e-9)
    equity = frame(spark, {"p": [np.cumsum(rng.normal(0, 1, 200)) + 50], "q": [np.full(9, 3.0)]}, "equity")
    for size in (1, 7, 4096):
        for name, n in (("p", 200), ("q", 9)):
            e = equity.where(F.col("pair") == name).orderBy("idx").toPandas()["equity"].to_numpy()
            mine = metrics.drawdowns(equity, ["pair"], size=size).where(F.col("pair") == name).orderBy("idx").toPandas()
            assert len(mine) == n and np.array_equal(mine["peak"], np.maximum.accumulate(e)) and np.allclose(mine["drawdown"], (np.maximum.accumulate(e) - e) / np.maximum(np.maximum.accumulate(e), 1))
    given = spark.createDataFrame([("p", 3, 1.0), ("p", 60, None), ("p", 150, 2.0), ("z", 0, 9.0)], "pair string, idx long, theta double")
    for size in (1, 10, 4096):
        mine = {(r.pair, r.idx): r.theta for r in pairs.as_of(equity, given, size=size).collect()}
        assert len(mine) == 209 and all(t == (None if p == "q" or i < 3 else 1.0 if i < 150 else 2.0) for (p, i), t in mine.items())


@pytest.mark.parametrize(("length", "step", "short"), [(100, 20, False), (100, 30, True), (64, 64, False), (500, 100, True)])
def test_rolling_fits_by_block(spark, length, step, short):
    rng = np.random.default_rng(4)
    x = np.zeros(430)
    for k in range(1, 430):
        x[k] = 0.8 * x[k - 1] + rng.normal(0, 0.1)
    gaps = x.copy()
    gaps[rng.integers(0, 430, 60)] = np.nan
    gaps[200:310] = np.inf
    rows = frame(spark, {"whole": [x]}, "spread").unionByName(frame(spark, {"gaps": [gaps], "few": [x[:70]]}, "spread"))
    want = {(r.pair, r.window_id): r for r in rolling.fit_ou(pairs.windowed(rows, length, step, whole_if_short=short), ["pair", "window_id"]).collect()}
    for size in (16, 4096):
        got = {(r.pair, r.window_id): r for r in rolling.fit_ou_windows(rows, length, step, whole_if_short=short, size=size).collect()}
        assert set(want) <= set(got)
        for k, r in got.items():
            w = want.get(k)
            assert r.error == (w.error if w else "too few transitions") and r.n_obs == (w.n_obs if w else 0)
            assert w is None or all(math.isclose(r[c], w[c], rel_tol=1e-7, abs_tol=1e-9) for c in ("theta", "mu", "sigma", "half_life", "a_hat", "sigma_eq"))


def walk(rng, n: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.cumsum(rng.normal(0, 0.01, n)) + 5
    return 1.35 * b + 0.05 + rng.normal(0, 0.002, n), b


def test_hedge_in_ten_buckets(spark):
    rng = np.random.default_rng(5)
    values = {"long": walk(rng, 1000), "gaps": walk(rng, 1000), "short": walk(rng, 90), "wild": (rng.normal(0, 1, 300), rng.normal(0, 1, 300) * 1e5)}
    values["gaps"][0][rng.integers(0, 1000, 200)] = np.nan
    values["gaps"][1][300:405] = np.inf
    rows = frame(spark, values, "lp_a", "lp_b")
    states = {size: scans.hedge_states(rows, 1e-5, 1e-3, size=size).toPandas() for size in (100, 37)}
    for got in states.values():
        assert set(got["pair"]) == {"long", "gaps", "wild"}
        for name in ("long", "gaps", "wild"):
            f = K.Hedge(1e-5, 1e-3)
            want = np.array([f.step(x, y) for x, y in zip(*values[name], strict=True)], float)
            mine = got[got["pair"] == name].sort_values("idx")
            assert mine["idx"].tolist() == list(range(len(want)))
            assert np.abs(mine[list(K.HEDGE_COLUMNS)].to_numpy(float) - want).max() < 1e-8


def test_elements_compose_in_any_grouping():
    rng = np.random.default_rng(6)
    parts = scans.hedge_elements(*walk(rng, 64), 1e-5, 1e-3)
    whole = scans.folded(parts, scans.hedge_combine)
    for cut in (1, 20, 63):
        a, b = (scans.folded(tuple(p[s] for p in parts), scans.hedge_combine) for s in (slice(cut), slice(cut, None)))
        assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(whole, scans.hedge_combine(a, b), strict=True))


MODEL = {
    "pi": np.array([0.5, 0.3, 0.2]), "trans": np.array([[0.9, 0.08, 0.02], [0.1, 0.85, 0.05], [0.05, 0.05, 0.9]]),
    "mu": np.array([[0.3, 0.001, 1, 1], [1, 0.003, 1, 0.8], [2.5, 0.01, 2.5, 3]]), "sigma": np.array([[0.1, 0.001, 0.2, 0.2], [0.3, 0.002, 0.2, 0.2], [0.4, 0.004, 0.5, 0.5]]),
}


def test_regimes_in_ten_buckets(spark):
    rng = np.random.default_rng(7)
    obs = np.abs(rng.normal(MODEL["mu"][rng.integers(0, 3, 1000)], 0.1))
    obs[rng.integers(0, 1000, 60)] = np.nan
    obs[[99, 100, 450]] = 1e9  # no state can have made these
    rows = frame(spark, {"p": list(obs.T), "q": list(obs[:30].T), "none": list(obs[:9].T)}, *scans.FEATURES)
    flat = lambda p: (p, *(v.ravel().tolist() for v in MODEL.values()), p != "none")
    model = spark.createDataFrame([flat("p"), flat("q"), flat("none")], "pair string, pi array<double>, trans array<double>, mu array<double>, sigma array<double>, is_valid boolean")
    for size in (100, 33, 4096):
        got = models.regimes(rows, model, size).toPandas()
        assert set(got["pair"]) == {"p", "q"}
        for name, n in (("p", 1000), ("q", 30)):
            f, own = K.Regimes(**MODEL), got[got["pair"] == name].sort_values("idx")
            want = [f.step(o) for o in obs[:n]]
            assert own["state"].tolist() == [s for _, s, *_ in want] and own["is_no_trade"].tolist() == [x for *_, x in want]
            assert np.abs(np.array(own["gamma"].tolist()) - np.array([g for g, *_ in want])).max() < 1e-8


def test_training_in_ten_chunks(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_ROUNDS", 6)
    from spreadloom.operators import training

    rng = np.random.default_rng(8)
    states = np.repeat(rng.integers(0, 3, 100), 10)
    obs = np.clip(rng.normal(MODEL["mu"][states], 0.15 * MODEL["mu"][states] + 1e-4), 0, 10)
    obs[[5, 400]] = np.nan
    flat = np.ones((600, 4))
    rows = frame(spark, {"p": list(obs.T), "flat": list(flat.T), "few": list(obs[:200].T)}, *training.FEATURES)
    got = {r.pair: r for r in training.train_regimes(rows, 42, 100, 6).collect()}
    assert set(got) == {"p", "flat", "few"} and not got["few"].is_valid and got["few"].pi == []
    for name, x in (("p", obs), ("flat", flat)):
        want, r = K.train_regimes(x, 42), got[name]
        assert r.is_valid and r.n_iters == want["n_iters"] and r.converged == want["converged"] and r.n_train == want["n_train"]
        assert math.isclose(r.log_like, want["log_likes"][-1], rel_tol=1e-9)
        for c in ("pi", "trans", "mu", "sigma"):
            assert np.abs(np.array(r[c]) - want[c].ravel()).max() < 1e-8, (name, c)


def test_unit_root_by_block_and_whole_gate(spark):
    rng = np.random.default_rng(9)
    ar = np.zeros(1500)
    for k in range(1, 1500):
        ar[k] = 0.7 * ar[k - 1] + rng.normal(0, 1) + (0.4 * (ar[k - 1] - ar[k - 2]) if k > 1 else 0.0)
    gaps = ar.copy()
    gaps[rng.integers(0, 1500, 100)] = np.nan
    values = {"ar": ar + 1000, "gaps": gaps, "walk": np.cumsum(rng.normal(0, 1, 900)), "short": ar[:300], "flat": np.ones(600)}
    rows = frame(spark, {"ar": [values["ar"]]}, "x")
    for k in ("gaps", "walk", "short", "flat"):
        rows = rows.unionByName(frame(spark, {k: [values[k]]}, "x"))
    for size in (64, 16_384):
        got = {r.pair: r for r in models.unit_root(rows, ["pair"], size=size).collect()}
        assert set(got) == set(values) and got["flat"].error and not got["flat"].is_stationary and got["short"].error == "too short"
        for k in ("ar", "gaps", "walk"):
            want = K.unit_root_test(values[k])
            assert (got[k].n_lags, got[k].n_obs, got[k].error) == (want["n_lags"], want["n_obs"], "") and math.isclose(got[k].statistic, want["statistic"], rel_tol=1e-7)
            assert math.isclose(got[k].pvalue, want["pvalue"], rel_tol=1e-6, abs_tol=1e-9)
    some = rows.where("pair <> 'flat'")
    want = {r.pair: r for r in models.stationarity(some, ["pair"]).collect()}
    for r in models.gate(some, ["pair"]).collect():
        w = want.pop(r.pair)
        assert (r.series_length, r.edge_confirmed, r.edge_type, r.reason) == (w.series_length, w.edge_confirmed, w.edge_type, w.reason)
        assert math.isclose(r.adf.pvalue, w.adf.pvalue, rel_tol=1e-6, abs_tol=1e-9) and r.hurst.n_windows == w.hurst.n_windows and math.isclose(r.hurst.exponent, w.hurst.exponent, rel_tol=1e-9)
        assert math.isclose(r.ljung_box.min_pvalue, w.ljung_box.min_pvalue, rel_tol=1e-7, abs_tol=1e-12)
    assert not want
