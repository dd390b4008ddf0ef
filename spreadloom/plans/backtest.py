"""Backtest and walk-forward of many pairs and windows at once.

The stages of a window do not depend on its trades, except the last: the hedge filter runs first (one task a window), its
spreads give the fits to be made at each refit, those are fitted row by row wherever there is room, and a short loop over
what came out makes the trades. Rows are a window each, so nothing is gathered beyond one window's few thousand bars.

A whole series has no bound, so its bars stay rows: they pass in order through the filter and, with the fits made in
between, through the trades, and each hands its state on from one batch of bars to the next.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions import guards as G
from spreadloom.functions import kernels as K
from spreadloom.operators import metrics, models, pairs
from spreadloom.sources.scratch import stored


@dataclass(frozen=True)
class Settings:
    """Capital and risk, and when the models are fitted again."""

    capital: float = 10_000.0
    risk: float = 0.01
    stop_mult: float = 1.5
    target_mult: float = 2.5
    warm_up: int = 300
    ou_every: int = 100
    ou_rows: int = 500
    hmm_every: int = 500
    hmm_rows: int = 500
    max_held: int = 60
    stop_z: float = 3.5
    least_rows: int = 400
    limit: float = G.MAX_RATIO

    def __post_init__(self):
        if self.capital < 1 or not 0 < self.risk <= 0.10:
            raise ValueError("capital must be at least 1 and risk in (0, 0.10]")


BARS = "pair string, window_id int, n int, days int, start string, end string, at array<int>, spread array<double>, innov array<double>, price array<double>, atr array<double>, volume array<double>, valid array<boolean>"
OU = "struct<theta:double,mu:double,sigma:double,half_life:double,sigma_eq:double,is_valid:boolean,enter:double>"
TRADE = "struct<bar_entry:int,bar_exit:int,direction:int,entry_spread:double,exit_spread:double,entry_price_a:double,position_usd:double,raw_pnl:double,net_pnl:double,trade_return:double,exit_reason:string,regime_state:int,half_life:double,capital_after:double>"
BAR = "pair string, i long, price double, atr double, volume double, used boolean, spread double, innov double, ou array<array<double>>, hmm_spread array<double>, hmm_innov array<double>, hmm_volume array<double>"
STEP = f"pair string, window_id int, i long, equity double, max_drawdown double, state int, trade {TRADE}"
#: Bars of the span that a regime's features look back over.
SPAN = 20
RUN = f"pair string, window_id int, final_capital double, max_drawdown double, n0 int, n1 int, n2 int, trades array<{TRADE}>, equity array<double>"


def filtered(rows: DataFrame, s: Settings) -> DataFrame:
    """One row a window with its bars and the hedge's spreads; ``at`` has the places of the bars the filter saw."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = len(pdf)
        a, b, valid = pdf["lp_a"].to_numpy(float), pdf["lp_b"].to_numpy(float), pdf["valid"].to_numpy(bool)
        out = {"pair": key[0], "window_id": key[1], "n": n, "days": max(int((pdf["ts"].iloc[-1] - pdf["ts"].iloc[0]).days), 1), "start": str(pdf["ts"].iloc[0].date()), "end": str(pdf["ts"].iloc[-1].date())}
        if n >= s.least_rows:
            f = K.Hedge(*K.hedge_noise(a[: s.warm_up], b[: s.warm_up]))
            at = [i for i in range(n) if i < s.warm_up or valid[i]]
            states = [f.step(a[i], b[i]) for i in at]
            out |= {"at": at, "spread": [x[2] for x in states], "innov": [x[4] for x in states]}
        else:
            out |= {"at": [], "spread": [], "innov": []}
        atr = K.average_true_range(*(pdf[c].to_numpy(float) for c in ("high_a", "low_a", "close_a")))
        return pd.DataFrame([out | {"price": pdf["close_a"].tolist(), "atr": atr.tolist(), "volume": pdf["volume_a"].tolist(), "valid": valid.tolist()}])

    return rows.select("pair", "window_id", "i", "ts", "lp_a", "lp_b", "close_a", "high_a", "low_a", "volume_a", "valid").groupBy("pair", "window_id").applyInPandas(run, BARS)


def _seen(k: int) -> int:
    """How many values the models have at the ``k``-th bar: of more than 2000, all but the last 1000 go."""
    return k + 1 - 1000 * max(0, -(-(k + 1 - 2000) // 1001)) if k + 1 > 2000 else k + 1


def _refits(at: np.ndarray, s: Settings, every: int, least: int) -> list[int]:
    """The places, among the bars the filter saw, where a fit is due: ``every`` bars after the last, from the warm-up on."""
    due, out = s.warm_up + every, []
    for k in range(s.warm_up, len(at)):
        if at[k] >= due and _seen(k) >= least:
            out.append(k)
            due = at[k] + every
    return out


def regime_fits(windows: DataFrame, s: Settings) -> DataFrame:
    """(pair, window_id, at, model): each regime model a window needs is one row, fitted apart from the others."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                at, spread, innov, volume = (np.asarray(x, float) for x in (r.at, r.spread, r.innov, r.volume))
                for k in _refits(at, s, s.hmm_every, s.hmm_rows):
                    i, own = int(at[k]), slice(k + 1 - s.hmm_rows, k + 1)
                    # The volumes are those of the bars up to the one before.
                    rows.append((r.pair, r.window_id, i, spread[own].tolist(), innov[own].tolist(), volume[max(0, i - s.hmm_rows) : i].tolist()))
            if rows:
                yield pd.DataFrame(rows, columns=["pair", "window_id", "at", "spread", "innov", "volume"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                obs = K.mean_filled(K.regime_features(*(np.asarray(x, float) for x in (r.spread, r.innov, r.volume))))
                rows.append({"pair": r.pair, "window_id": r.window_id, "at": r.at, **models._model_row(K.train_regimes(obs, int(r.at)))})
            yield pd.DataFrame(rows, columns=["pair", "window_id", "at", "pi", "trans", "mu", "sigma", "n_iters", "n_train", "converged", "log_like", "is_valid"])

    asked = windows.select("pair", "window_id", "at", "spread", "innov", "volume").mapInPandas(ask, "pair string, window_id int, at int, spread array<double>, innov array<double>, volume array<double>")
    return asked.repartition("pair", "window_id", "at").mapInPandas(fit, f"pair string, window_id int, at int, {models.MODEL}")


def _entered(fit: dict) -> dict:
    """A fit with ``enter``, the distance in deviations from which a trade is entered."""
    return fit | {"enter": K.entry_threshold(fit["theta"], fit["sigma"], fit["sigma_eq"], fit["is_valid"]) / max(fit["sigma_eq"], G.MIN_DENOMINATOR)}


def _regime(model: K.Regimes | None, spread, innov, volume) -> tuple[int, float, bool]:
    """(state, size scale, no trade) at the last of the given bars; without a model, state 1 at half size."""
    if model is None:
        return 1, 0.5, False
    obs = K.regime_features(*(np.asarray(x, float) for x in (spread, innov, volume)))[-1]
    return model.step(obs)[1:] if np.isfinite(obs).all() else (1, 0.5, False)


def _fits(at: np.ndarray, spread: np.ndarray, s: Settings) -> list[tuple[int, dict]]:
    """(place from which it holds, fit) of the mean reversion: the first on the warm-up, then every ``ou_every`` bars; the
    newest spread stays out, and an invalid fit leaves the last one in force."""
    first = K.fit_ou(spread[: s.warm_up - 1], s.limit)
    out = [(s.warm_up, first)]
    for k in _refits(at, s, s.ou_every, 1):
        fit = K.fit_ou(spread[max(0, k + 1 - s.ou_rows) : k], s.limit)
        if fit["is_valid"]:
            out.append((k, fit))
    return out


def _regime_path(r, at: np.ndarray, spread: np.ndarray, innov: np.ndarray, s: Settings) -> list[tuple[int, float, bool]]:
    """(state, size scale, no trade) at each bar after the warm-up; without a model, state 1 at half size."""
    volume = np.asarray(r.volume, float)
    made = sorted(((int(m["at"]), m) for m in (r.models if r.models is not None else []) if m["is_valid"]), key=lambda x: x[0])
    out, model, nxt = [], None, 0
    for k in range(s.warm_up, len(at)):
        i = int(at[k])
        while nxt < len(made) and made[nxt][0] <= i:
            m = made[nxt][1]
            model, nxt = K.Regimes(m["pi"], m["trans"], m["mu"], m["sigma"]), nxt + 1
        own = slice(k - SPAN, k + 1)
        out.append(_regime(model, spread[own], innov[own], volume[i - SPAN - 1 : i]))
    return out


class Trader:
    """Capital, the open position and the fit in force, from bar to bar."""

    def __init__(self, s: Settings):
        self.s, self.capital, self.peak, self.worst = s, s.capital, s.capital, 0.0
        self.held, self.fit = None, None

    def refit(self, fit: dict) -> None:
        """The first fit holds in any case, later ones where they are valid."""
        if self.fit is None or fit["is_valid"]:
            self.fit = fit

    def skip(self) -> None:
        """A bar that the filter did not see."""
        if self.held:
            self.held["bars"] += 1

    def step(self, i: int, x: float, price: float, atr: float, state: int, scale: float, no_trade: bool) -> tuple | None:
        """The trade that ends at this bar, if one does; ``x`` is the spread."""
        s, fit, held, done = self.s, self.fit, self.held, None
        if not fit["is_valid"] or fit["sigma_eq"] < G.MIN_DENOMINATOR:
            return None
        z = float(K.ratio(x - fit["mu"], fit["sigma_eq"], limit=s.limit))
        if held:
            held["bars"] += 1
            d = held["direction"]
            why = "target" if d * z >= 0 else "emergency" if abs(z) > s.stop_z else "stop" if d * (x - held["stop"]) < 0 else "time" if held["bars"] >= s.max_held else ""
            if why:
                raw, net = K.trade_profit(d, x - held["spread"], held["price"], held["size"])
                before, self.capital = self.capital, K.next_capital(self.capital + net, self.capital)
                done = (held["entry"], i, d, held["spread"], x, held["price"], held["size"], raw, net, net / max(before, 1.0), why, held["state"], held["half_life"], self.capital)
                self.held = None
        if self.held is None and not no_trade and 2 <= fit["half_life"] <= 120 and K.half_life_scale(True, fit["half_life"]) > 0 and abs(z) > fit["enter"]:
            d = 1 if z < 0 else -1
            size = K.position_size(self.capital, atr, price, fit["theta"], fit["sigma"], scale, s.stop_mult, s.target_mult, s.risk)
            if size > 0:
                self.held = {"entry": i, "direction": d, "spread": x, "stop": x - d * s.stop_mult * fit["sigma_eq"], "price": price, "size": size, "bars": 0, "state": state, "half_life": fit["half_life"]}
        self.peak = max(self.peak, self.capital)
        self.worst = max(self.worst, (self.peak - self.capital) / max(self.peak, 1.0))
        return done


_TRADE_NAMES = [x.split(":")[0] for x in TRADE[7:-1].split(",")]


def _trade(r, s: Settings) -> dict:
    """The trades, equity and regime counts of one window."""
    at, spread, innov = (np.asarray(x, float) for x in (r.at, r.spread, r.innov))
    place = {int(i): k for k, i in enumerate(at)}
    fits, path = _fits(at, spread, s), _regime_path(r, at, spread, innov, s)
    trader, count, now = Trader(s), [0, 0, 0], 0
    equity, trades = [s.capital] * s.warm_up, []
    for i in range(s.warm_up, r.n):
        k = place.get(i)
        if k is None:
            trader.skip()
        else:
            while now < len(fits) and fits[now][0] <= k:
                trader.refit(_entered(fits[now][1]))
                now += 1
            regime = path[k - s.warm_up]
            count[regime[0]] += 1
            if done := trader.step(i, float(spread[k]), float(r.price[i]), r.atr[i], *regime):
                trades.append(done)
        equity.append(trader.capital)
    return {"pair": r.pair, "window_id": r.window_id, "final_capital": trader.capital, "max_drawdown": trader.worst, "n0": count[0], "n1": count[1], "n2": count[2], "trades": [dict(zip(_TRADE_NAMES, t, strict=True)) for t in trades], "equity": equity}


def simulated(windows: DataFrame, fits: DataFrame, s: Settings) -> DataFrame:
    """One row a window: capital, drawdown, regime counts, trades and equity."""
    grouped = fits.groupBy("pair", "window_id").agg(F.collect_list(F.struct("at", "pi", "trans", "mu", "sigma", "is_valid")).alias("models"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_trade(r, s) for r in pdf.itertuples()], columns=["pair", "window_id", "final_capital", "max_drawdown", "n0", "n1", "n2", "trades", "equity"])

    return windows.where(F.size("at") > 0).join(grouped, ["pair", "window_id"], "left").mapInPandas(run, RUN)


def trades(runs: DataFrame) -> DataFrame:
    """One row a trade, of runs by window or by bar."""
    each = F.explode("trades") if "trades" in runs.columns else F.col("trade")
    return runs.select("pair", "window_id", each.alias("t")).where("t is not null").select("pair", "window_id", "t.*")


def equity(runs: DataFrame) -> DataFrame:
    """pair, window_id, idx and equity, one row a bar, of runs by window or by bar."""
    each = F.posexplode("equity").alias("idx", "equity") if "trades" in runs.columns else (F.col("i").cast("int").alias("idx"), F.col("equity"))
    return runs.select("pair", "window_id", *(each if isinstance(each, tuple) else (each,)))


def results(base: DataFrame, totals: DataFrame, made: DataFrame, s: Settings) -> DataFrame:
    """One row a window with all metrics; windows that are too short have ok false and an error.

    ``base`` has n_bars, observation_days, start_date and end_date of all windows, ``totals`` capital, drawdown and regime
    counts of those that were traded, and ``made`` the trades.
    """
    made = made.join(base.select("pair", "window_id", "observation_days"), ["pair", "window_id"])
    per = metrics.trade_metrics(made, ["pair", "window_id"], F.col("observation_days")).drop("wins")
    out = base.join(totals, ["pair", "window_id"], "left").join(per, ["pair", "window_id"], "left")
    total = (F.col("final_capital") - s.capital) / s.capital
    yearly = G.annualised(total, F.col("observation_days"))
    seen = F.greatest(F.col("n0") + F.col("n1") + F.col("n2"), F.lit(1))
    ok = F.col("final_capital").isNotNull()
    numbers = ("win_rate", "profit_factor", "avg_trade_usd", "avg_holding_bars", "trades_per_year", "sharpe", "sortino")
    return out.select(
        "pair", "window_id", "start_date", "end_date", "n_bars", "observation_days", F.lit(s.capital).alias("initial_capital"), F.coalesce("final_capital", F.lit(0.0)).alias("final_capital"),
        F.when(ok, G.bounded(total)).otherwise(0.0).alias("total_return"), F.when(ok, G.bounded(yearly)).otherwise(0.0).alias("annualised_return"),
        F.when(ok, metrics.calmar(yearly, F.col("max_drawdown"))).otherwise(0.0).alias("calmar"), F.when(ok, G.bounded(F.col("max_drawdown"))).otherwise(0.0).alias("max_drawdown"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers],
        *[F.coalesce(F.col(f"n{k}") / seen * 100, F.lit(0.0)).alias(name) for k, name in enumerate(("pct_high_mr", "pct_low_mr", "pct_breakdown"))],
        ok.alias("ok"), F.when(ok, "").otherwise(F.format_string("only %d bars, %d needed", "n_bars", F.lit(s.least_rows))).alias("error"),
    )


# ---- whole series -----------------------------------------------------------------------------------------------------
def _in_order(df: DataFrame, start: Callable, schema: str) -> DataFrame:
    """``df`` through one state a pair: ``start()`` makes it, and it is called with each batch of a pair's bars, in order.

    A pair's bars are one sorted run of one task, which reads them batch by batch and never holds them all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, state = None, None
        for pdf in batches:
            for key, own in pdf.groupby("pair", sort=False, dropna=False):
                if state is None or key != pair:
                    pair, state = key, start()
                out = state(own)
                if len(out):
                    yield out

    return df.where("pair is not null").repartition("pair").sortWithinPartitions("pair", "i").mapInPandas(run, schema)


class _Filter:
    """The hedge of a series and what its fits will need: the last few hundred spreads and volumes, whatever its length.

    The first ``least_rows`` bars wait, as a series with fewer is not traded.
    """

    def __init__(self, s: Settings):
        self.s, self.hedge, self.waiting, self.k = s, None, [], 0
        self.close, self.atr = np.nan, None
        self.spread, self.innov = (deque(maxlen=max(s.warm_up, s.ou_rows, s.hmm_rows)) for _ in range(2))
        self.volume = deque(maxlen=s.hmm_rows)
        self.ou_due, self.hmm_due = s.warm_up + s.ou_every, s.warm_up + s.hmm_every

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        high, low, close = (pdf[c].to_numpy(float) for c in ("high_a", "low_a", "close_a"))
        atr = K.average_true_range(high, low, close, before=self.close, last=self.atr)
        self.close, self.atr = close[-1], float(atr[-1])
        self.waiting += zip(*(x.tolist() for x in (pdf["i"], pdf["lp_a"], pdf["lp_b"], close, atr, pdf["volume_a"], pdf["valid"])), strict=True)
        s, out = self.s, []
        if self.hedge is None and len(self.waiting) >= s.least_rows:
            first = np.array([r[1:3] for r in self.waiting[: s.warm_up]], float)
            self.hedge = K.Hedge(*K.hedge_noise(first[:, 0], first[:, 1]))
        if self.hedge:
            out, self.waiting = [self.bar(*r) for r in self.waiting], []
        made = pd.DataFrame(out, columns=["i", "price", "atr", "volume", "used", "spread", "innov", "ou", "hmm_spread", "hmm_innov", "hmm_volume"])
        made.insert(0, "pair", pdf["pair"].iloc[0])
        return made

    def bar(self, i: int, a: float, b: float, price: float, atr: float, volume: float, valid: bool) -> tuple:
        s, k, ou, asked = self.s, self.k, [], (None, None, None)
        used, x, e = i < s.warm_up or bool(valid), None, None
        if used:
            _, _, x, _, e, *_ = self.hedge.step(a, b)
            if k == s.warm_up:
                ou.append(list(self.spread)[: s.warm_up - 1])
            if k >= s.warm_up and i >= self.ou_due:
                ou.append(list(self.spread)[1 - s.ou_rows :])  # the newest spread stays out
                self.ou_due = i + s.ou_every
            self.spread.append(x)
            self.innov.append(e)
            if k >= s.warm_up and i >= self.hmm_due and _seen(k) >= s.hmm_rows:
                asked = list(self.spread)[-s.hmm_rows :], list(self.innov)[-s.hmm_rows :], list(self.volume)
                self.hmm_due = i + s.hmm_every
            self.k += 1
        self.volume.append(volume)
        return i, price, atr, volume, used, x, e, ou or None, *asked


class _Steps:
    """The trades of a series, bar by bar, with the fits that come along; it keeps the last few spreads and volumes."""

    def __init__(self, s: Settings):
        self.s, self.trader, self.model, self.k = s, Trader(s), None, 0
        self.spread, self.innov, self.volume = (deque(maxlen=SPAN + 1) for _ in range(3))

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [self.bar(r) for r in pdf.itertuples()]
        made = pd.DataFrame(out, columns=["i", "equity", "max_drawdown", "state", "trade"]).astype({"state": "Int32"})
        made.insert(0, "pair", pdf["pair"].iloc[0])
        made.insert(1, "window_id", 1)
        return made

    def bar(self, r) -> tuple:
        state, done = None, None
        for fit in r.fits if r.fits is not None else []:
            self.trader.refit(fit)
        if r.model is not None and r.model["is_valid"]:
            self.model = K.Regimes(*(r.model[c] for c in ("pi", "trans", "mu", "sigma")))
        if r.used:
            self.spread.append(r.spread)
            self.innov.append(r.innov)
            if self.k >= self.s.warm_up:
                regime = _regime(self.model, self.spread, self.innov, self.volume)
                state = regime[0]
                done = self.trader.step(r.i, r.spread, r.price, r.atr, *regime)
            self.k += 1
        else:
            self.trader.skip()
        self.volume.append(r.volume)
        return r.i, self.trader.capital, self.trader.worst, state, dict(zip(_TRADE_NAMES, done, strict=True)) if done else None


def _series_fits(bars: DataFrame, s: Settings) -> DataFrame:
    """pair, i, fits and model: what the bars asked for, each a row that is fitted wherever there is room."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                fits = [_entered(K.fit_ou(np.asarray(x, float), s.limit)) for x in (r.ou if r.ou is not None else [])]
                model = None
                if r.hmm_spread is not None:
                    obs = K.mean_filled(K.regime_features(*(np.asarray(x, float) for x in (r.hmm_spread, r.hmm_innov, r.hmm_volume))))
                    model = models._model_row(K.train_regimes(obs, int(r.i)))
                rows.append((r.pair, r.i, fits, model))
            yield pd.DataFrame(rows, columns=["pair", "i", "fits", "model"])

    asked = bars.where("ou is not null or hmm_spread is not null").select("pair", "i", "ou", "hmm_spread", "hmm_innov", "hmm_volume")
    return asked.repartition("pair", "i").mapInPandas(fit, f"pair string, i long, fits array<{OU}>, model struct<{models.MODEL}>")


def backtest(rows: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(results, runs) of aligned and indexed rows, each pair's whole series as one window; runs are by bar.

    Bars, fits and runs are tables in the shared folder. The filter and the trades of a pair go through its bars in order,
    so they are one task a pair, but of flat memory at any length; all fits run side by side. A pair with fewer than
    ``least_rows`` bars has a result that says so and no runs; rows without a pair are left out.
    """
    c = F.col
    given = rows.select("pair", c("idx").cast("long").alias("i"), "lp_a", "lp_b", "close_a", "high_a", "low_a", "volume_a", "valid")
    bars = stored(_in_order(given, lambda: _Filter(s), BAR), "backtest-bars")
    fits = stored(_series_fits(bars, s), "backtest-fits")
    stepped = bars.drop("ou", "hmm_spread", "hmm_innov", "hmm_volume").join(fits, ["pair", "i"], "left")
    runs = stored(_in_order(stepped, lambda: _Steps(s), STEP), "backtest-runs")
    span = rows.where("pair is not null").groupBy("pair").agg(F.count("*").cast("int").alias("n_bars"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    base = span.select("pair", F.lit(1).alias("window_id"), "n_bars", F.greatest(F.timestamp_diff("DAY", "t0", "t1"), F.lit(1)).cast("int").alias("observation_days"), day("t0").alias("start_date"), day("t1").alias("end_date"))
    totals = runs.groupBy("pair", "window_id").agg(F.max_by("equity", "i").alias("final_capital"), F.max("max_drawdown").alias("max_drawdown"), *[F.count_if(c("state") == k).cast("int").alias(f"n{k}") for k in range(3)])
    return results(base, totals, trades(runs), s), runs


# ---- windows ----------------------------------------------------------------------------------------------------------
def given_regimes(windows: DataFrame, regimes: DataFrame, s: Settings) -> DataFrame:
    """(pair, window_id, at, model) of models that were fitted elsewhere, a table of some rows a pair.

    ``regimes`` has pair, pi, trans, mu, sigma and is_valid; with a ``window_id`` a model is of that window alone, else of
    each window of its pair, and with ``at`` it holds from that bar of the window on, else from the warm-up's end.
    """
    keys = ["pair", "window_id"] if "window_id" in regimes.columns else ["pair"]
    at = F.col("at") if "at" in regimes.columns else F.lit(s.warm_up)
    known = regimes.select(*keys, at.cast("int").alias("at"), "pi", "trans", "mu", "sigma", "is_valid")
    return windows.select("pair", "window_id").join(known, keys).select("pair", "window_id", "at", "pi", "trans", "mu", "sigma", "is_valid")


def run(rows: DataFrame, s: Settings = Settings(), regimes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(results, runs) of rows that have their ``window_id`` and ``i``, the place within it.

    With ``regimes``, models that are given (see ``given_regimes``), none are fitted; a window without one stays in state 1.
    The hedge's spreads and the runs are written to the shared folder, so that a lost executor costs no fit twice.
    """
    windows = stored(filtered(rows, s), "backtest-windows")
    fits = regime_fits(windows, s) if regimes is None else given_regimes(windows, regimes, s)
    runs = stored(simulated(windows, fits, s), "backtest-runs")
    base = windows.select("pair", "window_id", F.col("n").alias("n_bars"), F.col("days").alias("observation_days"), F.col("start").alias("start_date"), F.col("end").alias("end_date"))
    return results(base, runs.drop("trades", "equity"), trades(runs), s), runs


def walk_forward(rows: DataFrame, train: int = 2000, test: int = 500, step: int = 500, s: Settings = Settings(), regimes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(verdicts, results, runs): every window of ``train`` + ``test`` rows, one each ``step``, is traded by itself, under
    regime models that are fitted on the way or given (see ``run``).

    A pair with fewer rows than a window has no row in any of the three.
    """
    if train < 500 or test < 100:
        raise ValueError("at least 500 rows to train and 100 to test")
    made, runs = run(pairs.windowed(rows, train + test, step), s, regimes)
    return metrics.verdict(made), made, runs


