"""Ordered series cut into buckets, so that no task holds a whole one: what a bucket needs of the rows before it comes along.

* ``haloed``: a bucket gets copies of the last rows of the one before; rolling statistics of bounded reach need no more.
* ``carried``, ``running_max``: a bucket is summed up in one row; what all buckets before say is handed to its rows.
* ``ema``: a recurrence y = (1 - k) * y + k * x is an affine map of the y before. Maps are composed within a bucket, and
  each bucket's whole map is handed on to as many later ones as still feel it in a double.

Everything is a DataFrame expression. Only one row a bucket of a series meets in one task, and not even that for ``ema``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket.
SIZE = 4096
#: Factors of a recurrence may shrink to this within a bucket, and are felt no more when this small.
LEAST_FACTOR, NOTHING = 1e-12, 2.0**-64


def bucket_of(idx: Column, size: int = SIZE) -> Column:
    return F.floor(idx / F.lit(size)).cast("long")


def numbered(rows: DataFrame, key: str | list[str], bucket: Column, order: tuple[str, ...], name: str = "idx") -> DataFrame:
    """``name``: the place of each row within its key, from 0, in the order of ``bucket`` and then of ``order``.

    Rows are ranked within their bucket and moved on by the counts of the buckets before, so a key is spread over as many
    tasks as it has buckets; only the counts of a key meet in one. A row whose bucket is null has no place and goes.
    """
    keys = [key] if isinstance(key, str) else key
    some = rows.withColumn("__bucket", bucket).where("__bucket is not null")
    past = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = some.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n")).select(*keys, "__bucket", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    return some.join(before, [*keys, "__bucket"]).withColumn(name, (F.col("__before") + rank).cast("long")).drop("__bucket", "__before")


def compact(rows: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """keys, idx, v: the finite values of each key, numbered anew from 0 without the gaps the others leave."""
    v = F.col(value).cast("double")
    some = rows.where(F.abs(v) < float("inf")).select(*keys, "idx", v.alias("v"))
    return numbered(some, keys, bucket_of(F.col("idx"), size), ("idx",), "__j").select(*keys, F.col("__j").alias("idx"), "v")


def lagged(rows: DataFrame, keys: list[str], value: str, lags: dict[str, int], size: int = SIZE) -> DataFrame:
    """``rows`` with earlier values of theirs; ``idx`` counts the rows of a key from 0."""
    w = Window.partitionBy(*keys, "__bucket").orderBy("idx")
    return without_halo(haloed(rows, max(lags.values()), size).withColumns({n: F.lag(value, k).over(w) for n, k in lags.items()}))


def haloed(rows: DataFrame, span: int, size: int = SIZE, idx: str = "idx") -> DataFrame:
    """``rows`` with ``__bucket``, each of the last ``span`` rows of a bucket also in the next one, where ``__halo`` is true.

    ``idx`` counts the rows of a key without gaps; windows by key and ``__bucket`` then see ``span`` rows back from every
    row that is no halo, and halos are to be left out afterwards. A bucket is made no smaller than ``span``.
    """
    size = max(size, span)
    own = bucket_of(F.col(idx), size)
    here, there = F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct((own + 1).alias("b"), F.lit(True).alias("h"))
    places = F.when(F.pmod(F.col(idx), F.lit(size)) >= size - span, F.array(here, there)).otherwise(F.array(here))
    out = rows.withColumn("__p", F.explode(places))
    return out.withColumn("__bucket", F.col("__p.b")).withColumn("__halo", F.col("__p.h")).drop("__p")


def without_halo(rows: DataFrame) -> DataFrame:
    return rows.where("not __halo").drop("__halo", "__bucket")


def _joined(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the summary of their key; nulls are equal."""
    found = found.toDF(*[f"__s_{c}" if c in keys else c for c in found.columns])
    on = [rows[k].eqNullSafe(found[f"__s_{k}"]) for k in keys]
    return rows.join(found, on, "left").drop(*[f"__s_{k}" for k in keys])


def carried(rows: DataFrame, keys: list[str], bucket: str, order: tuple[str, ...], values: dict[str, Column], own: bool = False) -> DataFrame:
    """``rows`` with, under each name, the last value that is not null of the rows before it (``own``: or its own).

    A bucket of a key tells its last value; the rows of later buckets that have none of their own start from it. Buckets
    are in order, and a null one comes first.
    """
    some = rows.withColumns({f"__v_{n}": v for n, v in values.items()})
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    place = F.struct(*order)
    last = some.groupBy(*keys, bucket).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__l_{n}") for n in values])
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, bucket, *[F.last(f"__l_{n}", ignorenulls=True).over(past).alias(f"__b_{n}") for n in values])
    some = some.withColumns({f"__w_{n}": F.last(f"__v_{n}", ignorenulls=True).over(within) for n in values})
    out = _joined(some, before, [*keys, bucket])
    return out.withColumns({n: F.coalesce(f"__w_{n}", f"__b_{n}") for n in values}).drop(*[f"__{x}_{n}" for x in "vwb" for n in values])


def running_max(rows: DataFrame, keys: list[str], bucket: str, order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """``name``: the largest ``value`` of a key up to each row, from those of the bucket and the largest ones of buckets before."""
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, bucket).agg(F.max(value).alias("__most")).select(*keys, bucket, F.max("__most").over(past).alias("__most"))
    out = _joined(rows.withColumn("__own", F.max(value).over(within)), before, [*keys, bucket])
    return out.withColumn(name, F.greatest("__own", "__most")).drop("__own", "__most")


def ema_size(period: int, most: int = SIZE) -> int:
    """Rows of a bucket for which powers of the factor stay far from the ends of a double."""
    return max(1, min(most, math.floor(math.log(LEAST_FACTOR) / math.log(1 - 2 / (period + 1))))) if period > 1 else most


def ema(rows: DataFrame, key: str, value: Column, period: int, name: str, size: int | None = None, idx: str = "idx") -> DataFrame:
    """``name``: the exponential mean of ``value`` in order of ``idx`` (from 0, without gaps), started at the first row.

    y(j) = f^(j+1) * y(before the bucket) + sum of f^(j-i) * k * x(i); the sum is a running one of x(i) / f^i, scaled by
    f^j, which a bucket is short enough for. What a bucket adds fades by f^rows a bucket, so it is sent to the few next
    ones that feel it and added up there. Values may not be null.
    """
    k = 2.0 / (period + 1)
    f = 1.0 - k
    if f <= 0:
        return rows.withColumn(name, value)
    size = size or ema_size(period)
    reach = max(1, math.ceil(math.log(NOTHING) / (size * math.log(f))))
    j = F.pmod(F.col(idx), F.lit(size))
    scaled = rows.withColumn("__bucket", bucket_of(F.col(idx), size)).withColumn("__x", F.when(F.col(idx) == 0, value).otherwise(value * k) * F.pow(F.lit(f), -j))
    w = Window.partitionBy(key, "__bucket").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    part = scaled.withColumn("__part", F.sum("__x").over(w) * F.pow(F.lit(f), j))
    whole = part.groupBy(key, "__bucket").agg(F.max_by("__part", idx).alias("__whole"))
    felt = whole.withColumn("__ahead", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    sent = felt.groupBy(key, (F.col("__bucket") + F.col("__ahead")).alias("__bucket")).agg(F.sum(F.col("__whole") * F.pow(F.lit(f), (F.col("__ahead") - 1) * size)).alias("__before"))
    out = _joined(part, sent, [key, "__bucket"])
    return out.withColumn(name, F.col("__part") + F.pow(F.lit(f), j + 1) * F.coalesce("__before", F.lit(0.0))).drop("__bucket", "__x", "__part", "__before")
