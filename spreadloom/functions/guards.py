"""Guarded scalar arithmetic as Column expressions.

Every guard takes Columns (or numbers) and keeps to built-in functions, so it stays inside generated code. In Spark NaN
compares above every number, so one ``abs(v) <= limit`` turns away null, NaN and both infinities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits that results depend on.
MAX_RATIO = 999.0
MAX_POSITION_MULT = 0.5
MIN_PRICE = 1e-8
MIN_DENOMINATOR = 1e-10
MAX_LOG_RETURN = 0.20


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("double")


def nan() -> Column:
    return F.lit("NaN").cast("double")


def finite(v: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(F.abs(v) <= F.lit(1.7976931348623157e308), F.lit(False))


def bounded(v, fallback=0.0, limit: float = MAX_RATIO) -> Column:
    """v if it is within ``limit`` of zero, else the fallback."""
    v = _c(v)
    return F.when(F.abs(v) <= F.lit(float(limit)), v).otherwise(_c(fallback))


def ratio(numerator, denominator, fallback=0.0, limit: float = MAX_RATIO) -> Column:
    """A bounded quotient of bounded operands; the fallback where the divisor is next to zero."""
    n, d = bounded(numerator, fallback, limit), bounded(denominator, 0.0, limit)
    return F.when(F.abs(d) < MIN_DENOMINATOR, _c(fallback)).otherwise(bounded(F.try_divide(n, d), fallback, limit))


def clamp(v, lo, hi) -> Column:
    """v within [lo, hi]; lo if v is not finite."""
    v = _c(v)
    return F.when(finite(v), F.greatest(_c(lo), F.least(_c(hi), v))).otherwise(_c(lo))


def safe_log(x) -> Column:
    """ln(x), NaN unless x is finite and above the least price."""
    x = _c(x)
    return F.when(finite(x) & (x > MIN_PRICE), F.log(F.when(x > MIN_PRICE, x).otherwise(F.lit(1.0)))).otherwise(nan())


def safe_sqrt(x) -> Column:
    """sqrt(x), 0 where there is none."""
    x = _c(x)
    return F.when(finite(x) & (x >= 0), F.sqrt(x)).otherwise(F.lit(0.0))


def safe_exp(x) -> Column:
    """exp of x within [-700, 700]."""
    return F.exp(clamp(x, -700.0, 700.0))


def log_return(price, before) -> Column:
    """ln(price / before), NaN unless both are above the least price."""
    price, before = _c(price), _c(before)
    ok = finite(price) & finite(before) & (price > MIN_PRICE) & (before > MIN_PRICE)
    return F.when(ok, safe_log(F.try_divide(price, before))).otherwise(nan())


def clamp_pnl(pnl, position) -> Column:
    """Profit within half of the position either way; 0 for a position that is not positive."""
    position = _c(position)
    half = position * MAX_POSITION_MULT
    return F.when(finite(position) & (position > 0), clamp(pnl, -half, half)).otherwise(F.lit(0.0))


def next_capital(new, old) -> Column:
    """Capital after a trade: at least 1, and the old one if the new one is not finite or over ten times it."""
    new, old = _c(new), _c(old)
    return F.when(~finite(new), F.greatest(old, F.lit(1.0))).when(new < 1.0, F.lit(1.0)).when(new > old * 10, old).otherwise(new)


def annualised(total_return, days) -> Column:
    """Compound yearly return; 0 for less than a day, -1 for ruin."""
    base, days = 1.0 + _c(total_return), _c(days)
    grown = safe_exp(safe_log(base) * F.try_divide(F.lit(365.0), days)) - 1.0
    return F.when(days < 1, F.lit(0.0)).when(base <= 0, F.lit(-1.0)).otherwise(bounded(grown))


# A guard names its argument more than once, and what is nested in it is worked out as often. Over large expressions the
# following put each step into a column of its own, which Spark evaluates once.
def with_ratio(df: DataFrame, name: str, numerator, denominator, fallback=0.0, limit: float = MAX_RATIO) -> DataFrame:
    """``df`` with :func:`ratio` as column ``name``."""
    df = df.withColumns({"__v": _c(numerator), "__w": _c(denominator)})
    df = df.withColumns({"__v": bounded(F.col("__v"), fallback, limit), "__w": bounded(F.col("__w"), 0.0, limit)})
    df = df.withColumn("__q", F.when(F.abs("__w") >= MIN_DENOMINATOR, F.try_divide(F.col("__v"), F.col("__w"))))
    return df.withColumn(name, bounded(F.col("__q"), fallback, limit)).drop("__v", "__w", "__q")


def with_annualised(df: DataFrame, name: str, total_return, days) -> DataFrame:
    """``df`` with :func:`annualised` as column ``name``."""
    df = df.withColumns({"__b": 1.0 + _c(total_return), "__d": _c(days)})
    df = df.withColumn("__g", safe_log(F.col("__b")) * F.try_divide(F.lit(365.0), F.col("__d")))
    df = df.withColumn("__g", safe_exp(F.col("__g")) - 1.0)
    return df.withColumn(name, F.when(F.col("__d") < 1, F.lit(0.0)).when(F.col("__b") <= 0, F.lit(-1.0)).otherwise(bounded(F.col("__g")))).drop("__b", "__d", "__g")


def with_log_return(df: DataFrame, name: str, price, before) -> DataFrame:
    """``df`` with :func:`log_return` as column ``name``."""
    df = df.withColumns({"__p": _c(price), "__o": _c(before)})
    df = df.withColumn("__r", F.when(finite(F.col("__p")) & finite(F.col("__o")) & (F.col("__p") > MIN_PRICE) & (F.col("__o") > MIN_PRICE), F.try_divide(F.col("__p"), F.col("__o"))))
    return df.withColumn(name, safe_log(F.col("__r"))).drop("__p", "__o", "__r")
