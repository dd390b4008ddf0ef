"""Rolling and per-window statistics as window functions and aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import guards as G
from spreadloom.operators import pairs, series

# Limits of the mean-reversion fit, and sizes of the tests.
MIN_TRANSITIONS, MAX_HALF_LIFE, MIN_THETA, MIN_SIGMA = 50, 120.0, 1e-6, 1e-10
MIN_SERIES, HURST_LEAST, HURST_SIZES, LB_LAGS = 500, 20, 20, (5, 10, 20)
HURST_MEAN_REVERTING, HURST_TRENDING, P_LIMIT = 0.45, 0.55, 0.05


def true_range(bars: DataFrame, key: str = "symbol", size: int = series.SIZE) -> DataFrame:
    """``tr``: high - low, or the larger distance to the close before; ``idx``: the bar's place within its key.

    Bars are numbered in two levels and compared in buckets of ``size``, each with the last bar of the one before.
    """
    near = series.haloed(pairs.indexed(bars, key), 1, size)
    before = F.lag("close").over(Window.partitionBy(key, "__bucket").orderBy("idx"))
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return series.without_halo(near.withColumn("tr", wide))


def features(rows: DataFrame, key: str | list[str] = "pair", span: int = 20, size: int = series.SIZE) -> DataFrame:
    """f0 to f3 of each row: spread z-score, spread change, volume ratio and innovation-variance ratio.

    Each compares with the ``span`` rows before, the row itself left out. A row without enough of them, or with no
    spread in them, gets the means of its key's other rows. ``idx`` counts the rows of a key from 0; they are taken in
    buckets of ``size``, each with the ``span`` rows before it.
    """
    keys = [key] if isinstance(key, str) else key
    rows = series.haloed(rows, span, size)
    w = Window.partitionBy(*keys, "__bucket").orderBy("idx")
    past = w.rowsBetween(-span, -1)
    spread, volume, innov = F.col("spread"), F.col("volume"), F.col("innov_var")
    ok = lambda c: F.when(G.finite(c), c)
    positive = lambda c: F.when(G.finite(c) & (c > 0), c)
    mean, sd, n = F.avg(ok(spread)).over(past), F.stddev_samp(ok(spread)).over(past), F.count(ok(spread)).over(past)
    mean_of = lambda c: F.greatest(F.coalesce(F.avg(positive(c)).over(past), F.lit(1.0)), F.lit(G.MIN_DENOMINATOR))
    before = F.lag("spread").over(w)
    usable = (F.col("idx") >= span) & (n >= 2) & (sd >= G.MIN_DENOMINATOR)
    f0 = F.when(G.finite(spread), F.abs((spread - mean) / sd)).otherwise(0.0)
    f1 = F.when(G.finite(spread) & G.finite(before), F.abs(spread - before)).otherwise(0.0)
    f2 = F.when(G.finite(volume) & (volume >= 0), volume / mean_of(volume)).otherwise(1.0)
    f3 = F.when(G.finite(innov) & (innov > 0), innov / mean_of(innov)).otherwise(1.0)
    found = rows.withColumn("__ok", F.coalesce(usable, F.lit(False)))
    raw = {"f0": G.bounded(f0), "f1": G.bounded(f1), "f2": G.bounded(G.clamp(f2, 0.0, 10.0), 1.0), "f3": G.bounded(G.clamp(f3, 0.0, 10.0), 1.0)}
    found = found.withColumns({k: F.when(F.col("__ok"), v) for k, v in raw.items()})
    found = series.without_halo(found).drop("__ok")
    means = found.groupBy(*keys).agg(*[F.avg(k).alias(f"__{k}") for k in raw])
    return found.join(means, keys).withColumns({k: F.coalesce(k, f"__{k}") for k in raw}).select(*found.columns)


def _ou(found: DataFrame, dt: float, limit: float) -> DataFrame:
    """The estimates from the five sums n, sx, sy, sxx, syy, sxy, step by step; ``error`` is the first that fails."""
    c = F.col
    ratio = lambda a, b: G.ratio(a, b, limit=limit)
    out = found.withColumn("den_mu", c("n") * (c("sxx") - c("sxy")) - (c("sx") * c("sx") - c("sx") * c("sy")))
    out = out.withColumn("mu", ratio(c("sy") * c("sxx") - c("sx") * c("sxy"), c("den_mu")))
    out = out.withColumn("den_a", c("sxx") - 2.0 * c("mu") * c("sx") + c("n") * c("mu") * c("mu"))
    out = out.withColumn("a", ratio(c("sxy") - c("mu") * c("sx") - c("mu") * c("sy") + c("n") * c("mu") * c("mu"), c("den_a")))
    out = out.withColumn("theta", ratio(-G.safe_log(c("a")), F.lit(float(dt))))
    rest = 1.0 - c("a")
    out = out.withColumn("alpha", F.try_divide(c("syy") - 2.0 * c("a") * c("sxy") + c("a") * c("a") * c("sxx") - 2.0 * c("mu") * rest * (c("sy") - c("a") * c("sx")) + c("n") * c("mu") * c("mu") * rest * rest, c("n")))
    out = out.withColumn("variance", ratio(c("alpha") * 2.0 * c("theta"), 1.0 - c("a") * c("a")))
    out = out.withColumn("sigma", G.safe_sqrt(c("variance")))
    error = (
        F.when(c("n") < MIN_TRANSITIONS, "too few transitions")
        .when(F.abs("den_mu") < G.MIN_DENOMINATOR, "mean is undetermined")
        .when(F.abs("den_a") < G.MIN_DENOMINATOR, "degenerate series")
        .when(~((c("a") > 0) & (c("a") < 1)), "no mean reversion")
        .when(c("theta") <= MIN_THETA, "negligible mean reversion")
        .when(c("alpha") <= 0, "no variance")
        .when(1.0 - c("a") * c("a") < G.MIN_DENOMINATOR, "mean reversion too slow")
        .when(c("variance") <= 0, "no diffusion")
        .when(c("sigma") <= MIN_SIGMA, "diffusion too small")
    )
    out = out.withColumn("error", error)
    ok = c("error").isNull()
    half = G.bounded(ratio(F.lit(float(np.log(2.0))), c("theta")), MAX_HALF_LIFE + 1, limit)
    equal = G.bounded(ratio(c("sigma"), G.safe_sqrt(2.0 * c("theta"))), 0.0, limit)
    keep = lambda v: F.when(ok, v).otherwise(0.0)
    out = out.withColumn("half_life", keep(half)).withColumn("sigma_eq", keep(equal))
    out = out.withColumns({k: keep(G.bounded(c(k), 0.0, limit)) for k in ("theta", "mu", "sigma", "a")})
    valid = ok & (c("theta") > MIN_THETA) & (c("half_life") <= MAX_HALF_LIFE) & (c("sigma") > MIN_SIGMA)
    return out.withColumn("n_obs", F.when(ok, c("n")).otherwise(0).cast("long")).withColumn("is_valid", valid).withColumnRenamed("a", "a_hat")


def fit_ou(rows: DataFrame, keys: list[str], value: str = "spread", dt: float = 1.0, limit: float = G.MAX_RATIO) -> DataFrame:
    """One mean-reversion fit a key, over its rows by ``idx``: theta, mu, sigma, half_life, a_hat, sigma_eq, n_obs,
    is_valid and error.

    Values that are not finite are left out and the gap closes. ``limit`` bounds every operand of a division (as results
    to match have it); with infinity the fit is that of the unguarded formulas.
    """
    x = F.col(value)
    w = Window.partitionBy(*keys).orderBy("idx")
    pairs = rows.where(G.finite(x)).select(*keys, x.alias("y"), F.lag(x).over(w).alias("x"))
    sums = pairs.groupBy(*keys).agg(
        F.count("x").cast("double").alias("n"), *[F.coalesce(F.sum(F.when(F.col("x").isNotNull(), v)), F.lit(0.0)).alias(k) for k, v in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))]
    )
    return _ou(sums, dt, limit).select(*keys, "theta", "mu", "sigma", "half_life", "a_hat", "sigma_eq", "n_obs", "is_valid", F.coalesce("error", F.lit("")).alias("error"))


def fit_ou_windows(rows: DataFrame, length: int, step: int, key: str = "pair", value: str = "spread", whole_if_short: bool = False, dt: float = 1.0, limit: float = G.MAX_RATIO, size: int = series.SIZE) -> DataFrame:
    """The fit of :func:`fit_ou` for each window of ``length`` rows, one every ``step``, with ``window_id`` from 1.

    No row goes to several windows. A step from one finite value to the next is counted by the blocks in which it begins
    and ends (as many rows as length and step have in common), sums of steps are made by block, and a window adds up those
    that begin and end in it. ``idx`` counts the rows of a key from 0. A window without a finite value, too, gives its row.
    """
    block = math.gcd(length, step)
    v, c = F.col(value), F.col
    counts = rows.groupBy(key).agg((F.max("idx") + 1).alias("__n"))
    some = rows.where(G.finite(v)).select(key, "idx", v.alias("y"), series.bucket_of(c("idx"), size).alias("__bucket"))
    steps = series.carried(some, [key], "__bucket", ("idx",), {"__p": F.struct("y", "idx")}).where("__p is not null")
    steps = steps.select(key, "y", c("__p.y").alias("x"), F.floor(c("__p.idx") / block).alias("b0"), F.floor(c("idx") / block).alias("b1"))
    parts = {"n": F.lit(1.0), "sx": c("x"), "sy": c("y"), "sxx": c("x") * c("x"), "syy": c("y") * c("y"), "sxy": c("x") * c("y")}
    sums = steps.groupBy(key, "b0", "b1").agg(*[F.sum(p).alias(k) for k, p in parts.items()]).join(counts, key)
    last = F.floor((c("__n") - length) / step)
    lo, hi = F.greatest(F.lit(0), F.ceil(((c("b1") + 1) * block - length) / step)), F.least(last, F.floor(c("b0") * block / step))
    ids = F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    every = F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    if whole_if_short:
        one = F.array(F.lit(0))
        ids, every = F.when(c("__n") < length, one).otherwise(ids), F.when(c("__n") < length, one).otherwise(every)
    none = counts.select(key, F.explode(every).alias("window_id"), *[F.lit(0.0).alias(k) for k in parts])
    found = sums.select(key, F.explode(ids).alias("window_id"), *parts).unionByName(none).groupBy(key, "window_id").agg(*[F.sum(k).alias(k) for k in parts])
    out = _ou(found.withColumn("window_id", c("window_id") + 1), dt, limit)
    return out.select(key, "window_id", "theta", "mu", "sigma", "half_life", "a_hat", "sigma_eq", "n_obs", "is_valid", F.coalesce("error", F.lit("")).alias("error"))


def half_life_scale(valid: Column, half_life: Column) -> Column:
    """Size factor by how fast the spread reverts."""
    return F.when(~valid, 0.0).when(half_life < 5.0, 0.5).when(half_life <= 20.0, 1.0).when(half_life <= 60.0, 0.75).otherwise(0.0)


def hurst_sizes(n: int) -> list[int]:
    """Chunk sizes of the rescaled-range analysis of ``n`` values."""
    if n // 2 < 2 * HURST_LEAST:
        return []
    sizes = np.unique(np.logspace(np.log10(HURST_LEAST), np.log10(n // 2), num=HURST_SIZES, dtype=int))
    return [int(s) for s in sizes if s >= HURST_LEAST]


def hurst(rows: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Rescaled-range exponent by key over finite values in order of ``idx``: exponent, r_squared, n_windows, error.

    Each value goes once to every chunk size of its series; sizes follow from the series' length, which is known by key,
    so series of different lengths are done together. Chunks are groups of their own, however long a series is.
    """
    clean = series.compact(rows, keys, value)
    clean = clean.join(clean.groupBy(*keys).agg(F.count("*").alias("n")), keys).withColumnRenamed("idx", "j")
    lengths = clean.groupBy(*keys).agg(F.first("n").alias("n")).where(F.col("n") >= MIN_SERIES)
    # The sizes of the logarithmic grid, worked out once a key; the join keeps the partitioning by key.
    sized = lengths.select(*keys, F.expr(f"""array_distinct(filter(transform(sequence(0, {HURST_SIZES - 1}), k -> cast(
        if(k = {HURST_SIZES - 1}, floor(n / 2), floor(power(10D, log10({HURST_LEAST}D) + k * (log10(floor(n / 2)) - log10({HURST_LEAST}D)) / {HURST_SIZES - 1}) + 1e-9)) as int)), s -> s >= {HURST_LEAST}))""").alias("sizes"))
    chunked = clean.join(sized, keys).withColumn("size", F.explode("sizes")).withColumn("chunk", F.floor(F.col("j") / F.col("size")))
    chunked = chunked.where(F.col("chunk") < F.floor(F.col("n") / F.col("size")))
    one = [*keys, "size", "chunk"]
    centred = chunked.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy(*one)))
    summed = centred.withColumn("c", F.sum("d").over(Window.partitionBy(*one).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
    rs = summed.groupBy(*one).agg((F.max("c") - F.min("c")).alias("r"), F.stddev_samp("v").alias("s")).where(F.col("s") >= G.MIN_DENOMINATOR).withColumn("rs", G.ratio(F.col("r"), F.col("s"))).where("rs > 0")
    points = rs.groupBy(*keys, "size").agg(F.count("*").alias("k"), F.avg("rs").alias("rs")).where("k >= 2")
    fit = points.groupBy(*keys).agg(F.regr_slope(F.log("rs"), F.log("size")).alias("slope"), F.regr_r2(F.log("rs"), F.log("size")).alias("r2"), F.count("*").alias("n_windows"))
    out = clean.select(*keys).distinct().join(fit, keys, "left")
    ok = F.coalesce(F.col("n_windows") >= 4, F.lit(False))
    return out.select(*keys, F.when(ok, G.bounded(F.col("slope"), 0.5)).otherwise(0.5).alias("exponent"), F.when(ok, G.bounded(F.col("r2"))).otherwise(0.0).alias("r_squared"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.when(ok, "").otherwise("too few points").alias("error"))


def chi2_tail(q: Column, k: int) -> Column:
    """P(chi-squared with ``k`` degrees > q): a short sum for even k, else one less the incomplete gamma series.

    ``q`` should be a column, not a large expression, as it is used in several places.
    """
    x = q / 2.0
    if k % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, k // 2):
            term = term * x / float(i)
            total = total + term
        return F.exp(-x) * total
    start = F.struct(F.lit(2.0 / k).alias("term"), F.lit(2.0 / k).alias("total"))
    add = lambda a, n: F.struct((a["term"] * x / (k / 2 + n)).alias("term"), (a["total"] + a["term"] * x / (k / 2 + n)).alias("total"))
    below = F.pow(x, F.lit(k / 2)) * F.exp(-x) / math.gamma(k / 2) * F.aggregate(F.sequence(F.lit(1), F.lit(400)), start, add)["total"]
    return F.when(x > 100, 0.0).otherwise(1.0 - below)


def ljung_box(rows: DataFrame, keys: list[str], value: str = "x", lags: tuple[int, ...] = LB_LAGS) -> DataFrame:
    """Portmanteau statistics and p-values by key: lags, stats, pvalues, min_pvalue, has_autocorr, error."""
    clean = series.compact(rows, keys, value)
    clean = clean.join(clean.groupBy(*keys).agg(F.avg("v").alias("__mean")), keys).select(*keys, "idx", (F.col("v") - F.col("__mean")).alias("d"))
    lagged = series.lagged(clean, keys, "d", {f"d{k}": k for k in range(1, max(lags) + 1)})
    sums = lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, max(lags) + 1)])
    q = lambda m: F.col("n") * (F.col("n") + 2) * sum((F.pow(F.try_divide(F.col(f"c{k}"), F.col("c0")), F.lit(2.0)) / (F.col("n") - k) for k in range(1, m + 1)), F.lit(0.0))
    ok = F.col("n") >= MIN_SERIES
    out = sums.select(*keys, "n", ok.alias("ok"), *[F.when(ok, q(m)).alias(f"q{m}") for m in lags])
    out = out.withColumns({f"p{m}": chi2_tail(F.col(f"q{m}"), m) for m in lags})
    out = out.select(*keys, "ok", F.array(*[f"q{m}" for m in lags]).alias("stats"), F.array(*[F.when(F.col("ok"), G.clamp(F.col(f"p{m}"), 0.0, 1.0)) for m in lags]).alias("pvalues"))
    least = F.coalesce(F.array_min("pvalues"), F.lit(1.0))
    return out.select(*keys, F.array(*[F.lit(m) for m in lags]).alias("lags"), "stats", "pvalues", least.alias("min_pvalue"), (least < P_LIMIT).alias("has_autocorr"), F.when(F.col("ok"), "").otherwise("too short").alias("error"))


def unit_root_stat(rows: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The unit-root t statistic with a constant and no lagged differences, by key."""
    steps = series.lagged(series.compact(rows, keys, value), keys, "v", {"x": 1}).where("x is not null").withColumn("dy", F.col("v") - F.col("x"))
    f = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("dy", "x").alias("b"), F.regr_sxx("dy", "x").alias("sxx"), F.regr_syy("dy", "x").alias("syy"), F.regr_sxy("dy", "x").alias("sxy"))
    s2 = (F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2)
    return f.select(*keys, "n", (F.col("b") / F.sqrt(s2 / F.col("sxx"))).alias("statistic"))


def edge_ratio(reports: DataFrame, keys: list[str]) -> DataFrame:
    """How many of each key's reports confirm an edge: n_reports, n_confirmed and their ratio."""
    n, yes = F.count("*"), F.count_if("edge_confirmed")
    return reports.groupBy(*keys).agg(n.alias("n_reports"), yes.alias("n_confirmed"), (yes / n).alias("confirmed_ratio"))


def edge_class(adf_p: Column, lb_min_p: Column, exponent: Column, hurst_ok: Column) -> Column:
    """(edge_confirmed, edge_type, reason) of a series from its three tests, in their order."""
    none = lambda why: F.struct(F.lit(False).alias("edge_confirmed"), F.lit("none").alias("edge_type"), F.lit(why).alias("reason"))
    yes = lambda kind: F.struct(F.lit(True).alias("edge_confirmed"), F.lit(kind).alias("edge_type"), F.lit("all three tests pass").alias("reason"))
    return (
        F.when(~(adf_p < P_LIMIT), none("unit root not rejected")).when(~(lb_min_p < P_LIMIT), none("no autocorrelation")).when(~hurst_ok, none("no exponent"))
        .when(exponent < HURST_MEAN_REVERTING, yes("mean_reverting")).when(exponent > HURST_TRENDING, yes("trending")).otherwise(none("random walk zone"))
    )
