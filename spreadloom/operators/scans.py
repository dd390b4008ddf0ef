"""Filters that run in parallel over time: what a stretch of rows does to the filter's state is a map, and maps compose.

A series is cut into buckets. Each bucket's map is composed in its own task, row by row in pairs, pairs in pairs and so on;
the maps of the buckets before one give the state it starts from, and the filter itself then runs through each bucket from
there. Nothing but one map a bucket of a series meets in one task.

* The hedge filter's maps are the five-part elements of linear-Gaussian filtering, which compose associatively.
* The regime filter's maps are 3 x 3 matrices, transition times density, scaled as they are multiplied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions import kernels as K
from spreadloom.operators.series import SIZE, bucket_of

STATE_FIELDS = "beta double, alpha double, spread double, innovation double, innov_var double, p00 double, p11 double, is_warmed_up boolean"


def folded(parts: tuple[np.ndarray, ...], combine: Callable) -> tuple[np.ndarray, ...]:
    """All elements composed in order: neighbours in pairs, until one is left. ``parts`` has one array for each part of an
    element, with one row an element."""
    while len(parts[0]) > 1:
        n = len(parts[0]) // 2 * 2
        pairs = combine(tuple(p[0:n:2] for p in parts), tuple(p[1:n:2] for p in parts))
        parts = tuple(np.concatenate([x, p[n:]]) for x, p in zip(pairs, parts, strict=True))
    return parts


# ---- the hedge filter -----------------------------------------------------------------------------------------------
def hedge_elements(a: np.ndarray, b: np.ndarray, q: float, r: float) -> tuple[np.ndarray, ...]:
    """(A, b, C, eta, J) of each bar: given the state x before it, the state after it is A x + b with covariance C, and
    eta and J tell how likely its observation makes x. A bar that is not finite is the identity."""
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = np.where(ok, a, 0.0), np.where(ok, b, 0.0)
    h = np.stack([b, np.ones(len(b))], 1)
    s = q * (b * b + 1.0) + r
    gain = q * h / s[:, None]
    eye = np.eye(2)
    rest = eye - gain[:, :, None] * h[:, None, :]
    parts = rest, gain * a[:, None], q * rest, h * (a / s)[:, None], h[:, :, None] * h[:, None, :] / s[:, None, None]
    none = eye, np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
    return tuple(np.where(ok.reshape(-1, *[1] * (p.ndim - 1)), p, z) for p, z in zip(parts, none, strict=True))


def hedge_combine(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The element of two stretches, one after the other."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    dot = lambda m, v: np.einsum("nij,nj->ni", m, v)
    turn = lambda m: np.swapaxes(m, 1, 2)
    w = np.linalg.inv(np.eye(2) + c1 @ j2)
    ahead, back = a2 @ w, turn(a1) @ turn(w)
    return ahead @ a1, dot(ahead, b1 + dot(c1, e2)) + b2, ahead @ c1 @ turn(a2) + c2, dot(back, e2 - dot(j2, b1)) + e1, back @ j2 @ a1 + j1


_ELEMENT = ((2, 2), (2,), (2, 2), (2,), (2, 2))
_AT = np.cumsum([0] + [int(np.prod(s)) for s in _ELEMENT])


def _element_row(parts: tuple[np.ndarray, ...]) -> list[float]:
    return np.concatenate([p[0].ravel() for p in parts]).tolist()


def _element_parts(row: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(row[_AT[k] : _AT[k + 1]], float).reshape(1, *s) for k, s in enumerate(_ELEMENT))


def hedge_states(rows: DataFrame, q: float = 1e-5, r: float = 1e-3, p0: float = 1.0, size: int = SIZE) -> DataFrame:
    """The dynamic hedge's state at each row (pair, idx, lp_a, lp_b; idx from 0); pairs with under 110 finite rows give none.

    The filter's floors are no part of its maps. They never act while (1 + lp_b^2) / r + 1 / q is under their inverse, as
    every posterior variance is over the inverse of that; a pair with a row beyond goes through the filter in one piece.
    """
    K.Hedge(q, r, p0)  # refuses what it cannot run with
    most = r * (1 / K.MIN_P - 1 / q) - 1 if r >= K.MIN_INNOVATION else -1.0
    rows = rows.select("pair", "idx", "lp_a", "lp_b")
    b = F.col("lp_b")
    wild = rows.where((F.abs(b) < float("inf")) & (b * b > most)).select(F.col("pair").alias("__wild")).distinct()
    cut = rows.join(wild, F.col("pair").eqNullSafe(F.col("__wild")), "left").select("pair", "idx", "lp_a", "lp_b", F.when(F.col("__wild").isNull(), bucket_of(F.col("idx"), size)).otherwise(F.lit(0)).cast("long").alias("bucket"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, y = pdf["lp_a"].to_numpy(float), pdf["lp_b"].to_numpy(float)
        parts = folded(hedge_elements(x, y, q, r), hedge_combine)
        return pd.DataFrame([(*key, _element_row(parts), len(x), int((np.isfinite(x) & np.isfinite(y)).sum()))], columns=["pair", "bucket", "element", "n", "n_ok"])

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        zero = np.zeros((1, 2, 2))
        at = zero, np.array([[1.0, 0.0]]), p0 * np.eye(2)[None], np.zeros((1, 2)), zero
        out, n = [], 0
        for bucket, element, rows_, _ in zip(pdf["bucket"], pdf["element"], pdf["n"], pdf["n_ok"], strict=True):
            out.append((key[0], bucket, [*at[1][0].tolist(), float(at[2][0, 0, 0]), float(at[2][0, 0, 1] + at[2][0, 1, 0]) / 2, float(at[2][0, 1, 1])], n))
            at, n = hedge_combine(at, _element_parts(element)), n + rows_
        return pd.DataFrame(out if pdf["n_ok"].sum() >= K.MIN_ROWS else [], columns=["pair", "bucket", "state", "n"])

    def run(key: tuple, pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        if begin.empty or pdf.empty:
            return pd.DataFrame([], columns=["pair", "idx", *K.HEDGE_COLUMNS])
        pdf = pdf.sort_values("idx")
        f = K.Hedge(q, r, p0, state=(*map(float, begin["state"][0]), int(begin["n"][0])))
        states = [f.step(x, y) for x, y in zip(pdf["lp_a"].tolist(), pdf["lp_b"].tolist(), strict=True)]
        return pd.DataFrame(states, columns=K.HEDGE_COLUMNS).assign(pair=[key[0]] * len(pdf), idx=pdf["idx"].to_numpy())[["pair", "idx", *K.HEDGE_COLUMNS]]

    maps = cut.groupBy("pair", "bucket").applyInPandas(fold, "pair string, bucket long, element array<double>, n long, n_ok long")
    starts = maps.groupBy("pair").applyInPandas(start, "pair string, bucket long, state array<double>, n long")
    return cut.groupBy("pair", "bucket").cogroup(starts.groupBy("pair", "bucket")).applyInPandas(run, f"pair string, idx long, {STATE_FIELDS}")


# ---- the regime filter ----------------------------------------------------------------------------------------------
def regime_matrices(obs: np.ndarray, trans: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """What each row does to the probabilities of the states before it: transition, then density relative to the best
    state's. A row that is not finite does nothing; one that no state can have made leaves all states alike."""
    ok = np.isfinite(obs).all(1)
    logs = K.log_density(np.where(ok[:, None], obs, 0.0), mu, sigma)
    best = logs.max(1)
    dens = np.exp(np.maximum(logs - best[:, None], -700.0))
    out = trans[None] * dens[:, None, :]
    out[best <= K.LOG_ZERO / 2] = 1 / K.STATES
    out[~ok] = np.eye(K.STATES)
    return out


def scaled_product(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    made = first[0] @ then[0]
    return (made / made.max((1, 2), keepdims=True),)


REGIME_FIELDS = "gamma array<double>, state int, kelly_scale double, is_no_trade boolean, confidence double"
FEATURES = ["f0", "f1", "f2", "f3"]


def regime_states(rows: DataFrame, models: DataFrame, size: int = SIZE) -> DataFrame:
    """pair, idx, gamma, state, kelly_scale, is_no_trade, confidence: filtered regimes of each row (pair, idx, f0 to f3)
    under its pair's model; pairs without a valid one give none."""
    cut = rows.select("pair", "idx", *FEATURES, bucket_of(F.col("idx"), size).alias("bucket"))
    model = models.where("is_valid").select(F.col("pair").alias("of"), "pi", "trans", "mu", "sigma")
    places = cut.select(F.col("pair").alias("of_pair"), F.col("bucket").alias("of_bucket")).distinct()
    keyed = places.join(model, F.col("of_pair") == F.col("of")).drop("of")

    def parts(first: pd.Series) -> tuple:
        return np.maximum(np.asarray(first["trans"], float).reshape(K.STATES, K.STATES), K.MIN_STATE), np.asarray(first["mu"], float).reshape(K.STATES, -1), np.asarray(first["sigma"], float).reshape(K.STATES, -1)

    def fold(key: tuple, pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        names = ["pair", "bucket", "matrix", "pi"]
        if model.empty or pdf.empty:
            return pd.DataFrame([], columns=names)
        (made,) = folded((regime_matrices(pdf.sort_values("idx")[FEATURES].to_numpy(float), *parts(model.iloc[0])),), scaled_product)
        return pd.DataFrame([(*key, made[0].ravel().tolist(), list(model["pi"][0]))], columns=names)

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("bucket"), []
        at = np.maximum(np.asarray(pdf["pi"].iloc[0], float), K.MIN_STATE)
        for bucket, matrix in zip(pdf["bucket"], pdf["matrix"], strict=True):
            out.append((key[0], bucket, np.log(np.maximum(at, 1e-300)).tolist()))
            at = at @ np.asarray(matrix, float).reshape(K.STATES, K.STATES)
            at = at / at.sum()
        return pd.DataFrame(out, columns=["pair", "bucket", "log_alpha"])

    def run(key: tuple, pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        if begin.empty or pdf.empty:
            return pd.DataFrame([], columns=["pair", "idx", "gamma", "state", "kelly_scale", "is_no_trade", "confidence"])
        pdf, m = pdf.sort_values("idx"), begin.iloc[0]
        f = K.Regimes(m["pi"], m["trans"], m["mu"], m["sigma"], m["log_alpha"])
        out = [f.step(o) for o in pdf[FEATURES].to_numpy(float)]
        return pd.DataFrame({"pair": [key[0]] * len(pdf), "idx": pdf["idx"].to_numpy(), "gamma": [g.tolist() for g, *_ in out], "state": [s for _, s, *_ in out], "kelly_scale": [k for _, _, k, _ in out], "is_no_trade": [n for *_, n in out], "confidence": [float(g.max()) for g, *_ in out]})

    by = cut.groupBy("pair", "bucket")
    maps = by.cogroup(keyed.groupBy("of_pair", "of_bucket")).applyInPandas(fold, "pair string, bucket long, matrix array<double>, pi array<double>")
    starts = maps.groupBy("pair").applyInPandas(start, "pair string, bucket long, log_alpha array<double>")
    begun = keyed.join(starts, (F.col("of_pair") == F.col("pair")) & (F.col("of_bucket") == F.col("bucket"))).drop("pair", "bucket")
    return by.cogroup(begun.groupBy("of_pair", "of_bucket")).applyInPandas(run, f"pair string, idx long, {REGIME_FIELDS}")
