"""Pairs of symbols: alignment in time, static hedge, spread, noise estimates, rolling windows and as-of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import guards as G
from spreadloom.operators import series
from spreadloom.operators.series import numbered as numbered

#: Defaults of the filter's noise and the rows it is estimated on.
DEFAULT_Q, DEFAULT_R, WARM_UP = 1e-5, 1e-3, 100


def all_pairs(bars: DataFrame) -> DataFrame:
    """(symbol_a, symbol_b) of all symbols, each pair once: a nested loop over the symbols' names, not over bars.

    Aligning n symbols in all pairs reads every bar n - 1 times; where fewer pairs are wanted, give ``aligned`` a list of
    those (``bars.PAIRS``, say) instead.
    """
    s = bars.select("symbol").distinct()
    return s.select(F.col("symbol").alias("symbol_a")).join(s.select(F.col("symbol").alias("symbol_b")), F.col("symbol_a") < F.col("symbol_b"))


def aligned(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a pair and common time: the bars of both symbols, joined on equal times.

    Columns: pair, symbol_a, symbol_b, ts, close_a, close_b, high_a, low_a, volume_a, valid, lp_a and lp_b (logs of
    closes of at least 1e-8). ``pairs`` has a few rows; bars are shuffled by symbol and time only.
    """
    valid = F.coalesce("valid_bar", F.lit(True)) if "valid_bar" in bars.columns else F.lit(True)
    side = lambda x, cols: bars.withColumn("v", valid).select(F.col("symbol").alias(f"symbol_{x}"), "ts", F.col("v").alias(f"v_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    a = pairs.join(side("a", ("close", "high", "low", "volume")), "symbol_a")
    both = a.join(side("b", ("close",)), ["symbol_b", "ts"])
    lp = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-8)))
    return both.select(
        F.concat_ws("-", "symbol_a", "symbol_b").alias("pair"), "symbol_a", "symbol_b", "ts", "close_a", "close_b", "high_a", "low_a", "volume_a",
        (F.col("v_a") & F.col("v_b")).alias("valid"), lp("close_a").alias("lp_a"), lp("close_b").alias("lp_b"),
    )


def month(ts: str = "ts") -> Column:
    """The bucket of time that rows without a place of their own go by."""
    return F.date_trunc("month", F.col(ts))


def indexed(rows: DataFrame, key: str = "pair") -> DataFrame:
    """``idx``: the place of each row in time within its key, from 0; rows are ranked month by month."""
    return numbered(rows, key, month(), ("ts",))


def counted(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__n``, how many their key has: a count by key, joined."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("__n")), key)


def static_hedge(rows: DataFrame) -> DataFrame:
    """Ordinary least squares of lp_a on lp_b, by pair."""
    return rows.groupBy("pair").agg(F.count("*").alias("n"), F.regr_slope("lp_a", "lp_b").alias("beta"), F.regr_intercept("lp_a", "lp_b").alias("alpha"), F.regr_r2("lp_a", "lp_b").alias("r2"))


def static_spread(rows: DataFrame) -> DataFrame:
    """What the static hedge leaves of lp_a."""
    fit = static_hedge(rows).select("pair", "beta", "alpha")
    return rows.join(fit, "pair").withColumn("spread", F.col("lp_a") - F.col("beta") * F.col("lp_b") - F.col("alpha"))


def noise_params(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """(pair, q, r): filter noise from the residuals of a hedge on the first rows (``idx`` below a share of all)."""
    head = counted(rows, "pair").where(F.col("idx") < F.greatest(F.floor(F.col("__n") * share), F.lit(WARM_UP + 10)))
    head = head.where(G.finite(F.col("lp_a")) & G.finite(F.col("lp_b")))
    f = head.groupBy("pair").agg(F.count("*").alias("m"), F.regr_slope("lp_a", "lp_b").alias("b"), F.regr_sxy("lp_a", "lp_b").alias("sxy"), F.regr_syy("lp_a", "lp_b").alias("syy"))
    var = F.greatest(F.try_divide(F.col("syy") - F.col("b") * F.col("sxy"), F.col("m") - 2), F.lit(G.MIN_DENOMINATOR))
    few = F.col("m") < 20
    return f.select("pair", F.when(few, F.lit(DEFAULT_Q)).otherwise(F.greatest(var * 0.01, F.lit(1e-8))).alias("q"), F.when(few, F.lit(DEFAULT_R)).otherwise(var).alias("r"))


def window_ids(idx: Column, length: int, step: int, n: Column) -> Column:
    """The ids (from 0) of the windows of ``length`` rows, one every ``step``, that hold row ``idx`` of ``n``."""
    last = F.floor((n - length) / step)
    lo = F.greatest(F.lit(0), F.ceil((idx - length + 1) / step))
    hi = F.least(last, F.floor(idx / step))
    return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def windowed(rows: DataFrame, length: int, step: int, key: str = "pair", whole_if_short: bool = False) -> DataFrame:
    """``rows`` once for each window that holds them, with ``window_id`` (from 1) and ``i``, the place within it.

    The containment is computed, not joined: a row goes to at most ceil(length / step) windows. Rows of a key with fewer
    than ``length`` rows are in no window, or all in one if ``whole_if_short``.
    """
    some = counted(rows, key)
    ids = window_ids(F.col("idx"), length, step, F.col("__n"))
    if whole_if_short:
        ids = F.when(F.col("__n") < length, F.array(F.lit(0))).otherwise(ids)
    out = some.withColumn("window_id", F.explode(ids))
    return out.withColumn("i", F.col("idx") - F.col("window_id") * step).withColumn("window_id", F.col("window_id") + 1).drop("__n")


def as_of(rows: DataFrame, params: DataFrame, key: str = "pair", columns: tuple[str, ...] = ("theta",), size: int = series.SIZE) -> DataFrame:
    """``rows`` with the latest of ``params`` at or before their ``idx``, null ones left out: no range join.

    Rows and parameters meet in buckets of ``size`` places; the last parameters of a bucket are handed on to later ones,
    so no task holds a whole key, and a parameter is found however far back it is.
    """
    tagged = rows.select(key, "idx", F.lit(1).alias("__row"), *[F.lit(None).cast(params.schema[c].dataType).alias(c) for c in columns])
    given = params.select(key, "idx", F.lit(0).alias("__row"), *columns)
    both = tagged.unionByName(given).withColumn("__bucket", series.bucket_of(F.col("idx"), size)).toDF(key, "idx", "__row", *[f"__p_{c}" for c in columns], "__bucket")
    found = series.carried(both, [key], "__bucket", ("idx", "__row"), {c: F.col(f"__p_{c}") for c in columns}, own=True)
    return found.where("__row = 1").select(key, "idx", *columns)
