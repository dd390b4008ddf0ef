"""Position size as Column expressions: win probability, growth-optimal fraction, and volatility sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadloom.functions import guards as G

# Caps and costs.
MAX_KELLY, MAX_SHARE, MIN_SHARE, COST, STOP_MULT, TARGET_MULT, RISK = 0.25, 0.30, 0.005, 0.002, 1.5, 2.5, 0.01
SIMPSON = 200


def _simpson(depth: Column) -> Column:
    """The integral of exp(u * u), exponent at most 500, over [-depth, 0], by Simpson's rule."""
    f = lambda i: F.exp(G.clamp(F.pow(-depth + depth * i / float(SIMPSON), F.lit(2.0)), 0.0, 500.0)) * F.when((i == 0) | (i == SIMPSON), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(SIMPSON)), f), F.lit(0.0), lambda a, x: a + x)
    return F.when(depth < 1e-12, 0.0).otherwise(total * depth / float(SIMPSON) / 3.0)


def with_win_probability(df: DataFrame, theta: Column, sigma: Column, a: Column, name: str = "win_prob") -> DataFrame:
    """``df`` with the share of the scale function's rise from twice the entry distance that lies within it; 0.5 without
    a fit. The steps are columns of their own, so no integral is worked out more than once."""
    df = df.withColumn("__depth", F.when((theta > G.MIN_DENOMINATOR) & (sigma > G.MIN_DENOMINATOR) & (a > 0), a / (sigma / F.sqrt(F.greatest(2.0 * theta, F.lit(G.MIN_DENOMINATOR))))))
    df = df.withColumn("__near", _simpson(F.col("__depth"))).withColumn("__far", _simpson(2.0 * F.col("__depth")))
    df = df.withColumn("__p", G.ratio(F.col("__near"), F.col("__far"), 0.5))
    none = F.col("__depth").isNull() | (F.abs("__far") < G.MIN_DENOMINATOR)
    return df.withColumn(name, F.when(none, 0.5).otherwise(G.clamp(F.col("__p"), 0.0, 1.0))).drop("__depth", "__near", "__far", "__p")


def kelly(p: Column, reward_risk: Column) -> Column:
    """Growth-optimal fraction of capital, within 0 and a quarter."""
    f = G.clamp(G.bounded(G.ratio(reward_risk * p - (1.0 - p), reward_risk)), 0.0, MAX_KELLY)
    return F.when(reward_risk < G.MIN_DENOMINATOR, 0.0).otherwise(f)


def sized(df: DataFrame, risk: float = RISK) -> DataFrame:
    """``df`` with the position of each row and all that it comes from; is_valid is false, with the first reason, where
    there is none.

    Reads capital, atr, price, theta, sigma, ou_valid, scale (of the regime) and no_trade. The columns come one after
    another, each from those before, so that guards around guards do not multiply one expression.
    """
    c = F.col
    df = df.withColumn("stop_dist", STOP_MULT * c("atr")).withColumn("reward_risk", G.ratio(TARGET_MULT * c("atr"), c("stop_dist")))
    df = df.withColumn("__a", G.ratio(c("stop_dist"), c("price")))
    df = with_win_probability(df, c("theta"), c("sigma"), c("__a")).withColumn("kelly_fraction", kelly(c("win_prob"), c("reward_risk")))
    df = df.withColumn("kelly_hmm", G.clamp(c("kelly_fraction") * G.bounded(c("scale")), 0.0, MAX_KELLY)).withColumn("__cap", c("capital") * MAX_SHARE)
    df = df.withColumn("pos_kelly_usd", G.clamp(c("kelly_hmm") * c("capital"), 0.0, c("__cap")))
    df = df.withColumn("pos_atr_usd", G.clamp(G.ratio(c("capital") * risk, c("stop_dist")) * c("price"), 0.0, c("__cap")))
    df = df.withColumn("position_usd", F.least("pos_kelly_usd", "pos_atr_usd"))
    why = (
        F.when(c("no_trade"), "no trade in this regime").when(~c("ou_valid"), "no valid fit").when(~G.finite(c("capital")) | (c("capital") < 1), "capital").when(~G.finite(c("atr")) | (c("atr") <= 0), "range")
        .when(~G.finite(c("price")) | (c("price") <= 0), "price").when(c("stop_dist") < G.MIN_DENOMINATOR, "stop").when(c("reward_risk") < 0.1, "reward").when(c("position_usd") < c("capital") * MIN_SHARE, "too small").otherwise("")
    )
    df = df.withColumn("reason", why).withColumn("is_valid", c("reason") == "").drop("__a", "__cap")
    return df.withColumns({k: F.when(c("is_valid"), c(k)).otherwise(0.0) for k in ("position_usd", "pos_kelly_usd", "pos_atr_usd", "win_prob", "kelly_fraction", "kelly_hmm", "reward_risk", "stop_dist")})
