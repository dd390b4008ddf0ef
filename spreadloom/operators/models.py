"""The sequential models over many groups: each group is one task's work, and groups are independent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.functions import kernels as K
from spreadloom.operators import rolling, series
from spreadloom.operators.scans import STATE_FIELDS as STATE_FIELDS
from spreadloom.operators.scans import hedge_states as kalman_states  # noqa: F401
from spreadloom.operators.scans import regime_states as regimes  # noqa: F401


def kalman_summary(states: DataFrame) -> DataFrame:
    """One row a pair: rows, warmed-up rows, range, mean and deviation of the spread, and the last beta and alpha."""
    s = F.when(~F.isnan("spread"), F.col("spread"))
    return states.groupBy("pair").agg(
        F.count("*").alias("n_bars"), F.count_if("is_warmed_up").alias("n_warmed_up"), F.min(s).alias("spread_min"), F.max(s).alias("spread_max"), F.avg(s).alias("spread_mean"),
        F.stddev_pop(s).alias("spread_std"), F.max_by("beta", "idx").alias("beta_last"), F.max_by("alpha", "idx").alias("alpha_last"),
    )


def atr(bars: DataFrame, period: int = 14, size: int | None = None) -> DataFrame:
    """symbol, ts, atr: the exponential mean of the true range, in buckets of ``size`` bars (see ``series.ema``)."""
    size = size or series.ema_size(period)
    ranged = rolling.true_range(bars.select("symbol", "ts", "high", "low", "close"), size=size)
    return series.ema(ranged, "symbol", F.col("tr"), period, "atr", size).select("symbol", "ts", "atr")


ROOT = "statistic double, pvalue double, n_lags int, n_obs int, error string"


def unit_root(rows: DataFrame, keys: list[str], value: str = "x", size: int = 16_384) -> DataFrame:
    """The augmented unit-root test by key: statistic, pvalue, n_lags, n_obs, is_stationary, error.

    The regression needs no more of a series than the products of its level, differences and lagged differences, added up
    over blocks of ``size`` values that each come with the few values before them; all lag choices and the final fit are
    read off that one small matrix and the series' first values. Values that are not finite are left out.
    """
    clean, c = series.compact(rows, keys, value), F.col
    counts = clean.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    counts = counts.withColumn("lags", F.least(F.floor(c("n") / 2) - 2, F.ceil(12 * F.pow(c("n") / 100, F.lit(0.25)))).cast("int"))
    some = clean.join(counts.where(c("n") >= rolling.MIN_SERIES), keys).withColumn("size", F.greatest(F.lit(size), 2 * (c("lags") + 2)))
    own = F.floor(c("idx") / c("size"))
    near = some.withColumn("block", F.explode(F.when(F.pmod("idx", "size") >= c("size") - c("lags") - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    kind = [rows.select(*keys).schema[k] for k in keys]
    schema = lambda ddl: T.StructType([*kind, *T.StructType.fromDDL(ddl).fields])

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        first = pdf.iloc[0]
        gram, head = K.unit_root_products(pdf["v"].to_numpy() - first["mean"], int(first["idx"]), int(key[-1] * first["size"]), int(first["lags"]))
        return pd.DataFrame([(*key[:-1], gram.ravel().tolist(), head.tolist())], columns=[*keys, "gram", "head"])

    def solved(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = K.unit_root_of_products(np.sum(pdf["gram"].tolist(), axis=0), np.array(max(pdf["head"].tolist(), key=len)))
        return pd.DataFrame([(*key, *t.values())], columns=[*keys, *t])

    tested = near.groupBy(*keys, "block").applyInPandas(products, schema("gram array<double>, head array<double>")).groupBy(*keys).applyInPandas(solved, schema(ROOT))
    every = rows.select(*keys).distinct().join(tested, keys, "left")
    none = {"statistic": 0.0, "pvalue": 1.0, "n_lags": 0, "n_obs": 0, "error": "too short"}
    out = every.select(*keys, *[F.coalesce(n, F.lit(v)).alias(n) for n, v in none.items()])
    return out.withColumn("is_stationary", (c("pvalue") < rolling.P_LIMIT) & (c("error") == ""))


def gate(rows: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The report of :func:`stationarity` for whole series of any length: each of the three tests runs in blocks."""
    clean = series.compact(rows, keys, value)
    steps = series.lagged(clean, keys, "v", {"before": 1}).where("before is not null").select(*keys, (F.col("idx") - 1).alias("idx"), (F.col("v") - F.col("before")).alias("x"))
    packed = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    out = clean.groupBy(*keys).agg(F.count("*").alias("series_length")).join(packed(unit_root(clean, keys, "v"), "adf"), keys)
    out = out.join(packed(rolling.ljung_box(clean, keys, "v"), "ljung_box"), keys).join(packed(rolling.hurst(steps, keys), "hurst"), keys, "left")
    return _confirmed(out, keys)


def _confirmed(out: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    edge = rolling.edge_class(c("adf.pvalue"), c("ljung_box.min_pvalue"), c("hurst.exponent"), F.coalesce(c("hurst.error") == "", F.lit(False)))
    short = F.struct(F.lit(False).alias("edge_confirmed"), F.lit("none").alias("edge_type"), F.lit("series too short").alias("reason"))
    return out.withColumn("edge", F.when(c("series_length") < rolling.MIN_SERIES, short).otherwise(edge)).select(*keys, "series_length", "adf", "hurst", "ljung_box", "edge.*")


def stationarity(rows: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """One report a key: unit root and autocorrelation of the values, rescaled range of their differences, and the edge
    they confirm, if any. The three tests of a key are one call over its values: windows are shuffled once."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["v"].to_numpy(float)
        x = x[np.isfinite(x)]
        adf, lb, hu = K.unit_root_test(x), K.portmanteau(x, rolling.LB_LAGS), K.rescaled_range(np.diff(x))
        out = {f"a_{k}": v for k, v in adf.items()} | {f"l_{k}": v for k, v in lb.items()} | {f"h_{k}": v for k, v in hu.items()}
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | out | {"series_length": len(x)}])

    own = "a_statistic double, a_pvalue double, a_n_lags int, a_n_obs int, a_error string, l_stats array<double>, l_pvalues array<double>, l_min_pvalue double, l_error string, h_exponent double, h_r_squared double, h_n_windows long, h_error string, series_length long"
    given = rows.where(F.abs(value) < float("inf")).select(*keys, "idx", F.col(value).alias("v"))
    out = given.groupBy(*keys).applyInPandas(run, T.StructType([*given.select(*keys).schema.fields, *T.StructType.fromDDL(own).fields]))
    c, limit = F.col, rolling.P_LIMIT
    told = lambda p, *names: [c(f"{p}_{n}").alias(n) for n in names]
    adf = F.struct(*told("a", "statistic", "pvalue", "n_lags", "n_obs", "error"), ((c("a_pvalue") < limit) & (c("a_error") == "")).alias("is_stationary"))
    lb = F.struct(F.array(*[F.lit(m) for m in rolling.LB_LAGS]).alias("lags"), *told("l", "stats", "pvalues", "min_pvalue"), (c("l_min_pvalue") < limit).alias("has_autocorr"), *told("l", "error"))
    out = out.select(*keys, "series_length", adf.alias("adf"), F.struct(*told("h", "exponent", "r_squared", "n_windows", "error")).alias("hurst"), lb.alias("ljung_box"))
    return _confirmed(out, keys)


def entry_thresholds(fits: DataFrame) -> DataFrame:
    """``fits`` with ``threshold``, the best entry distance of each, computed in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(threshold=[K.entry_threshold(t, s, e, bool(v)) for t, s, e, v in zip(pdf["theta"], pdf["sigma"], pdf["sigma_eq"], pdf["is_valid"], strict=True)])

    return fits.mapInPandas(run, T.StructType([*fits.schema.fields, T.StructField("threshold", T.DoubleType())]))


MODEL = "pi array<double>, trans array<double>, mu array<double>, sigma array<double>, n_iters int, n_train int, converged boolean, log_like double, is_valid boolean"


def _model_row(m: dict | None) -> dict:
    if m is None:
        return {"pi": [], "trans": [], "mu": [], "sigma": [], "n_iters": 0, "n_train": 0, "converged": False, "log_like": None, "is_valid": False}
    return {**{k: m[k].ravel().tolist() for k in ("pi", "trans", "mu", "sigma")}, "n_iters": m["n_iters"], "n_train": m["n_train"], "converged": m["converged"], "log_like": m["log_likes"][-1], "is_valid": True}


def train_regimes(rows: DataFrame, seed: int = 42) -> DataFrame:
    """One regime model a pair from its features (pair, idx, f0 to f3); seeded, so it comes out the same again."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = K.train_regimes(pdf.sort_values("idx")[["f0", "f1", "f2", "f3"]].to_numpy(float), seed)
        return pd.DataFrame([{"pair": key[0], **_model_row(m)}])

    return rows.select("pair", "idx", "f0", "f1", "f2", "f3").groupBy("pair").applyInPandas(run, f"pair string, {MODEL}")
