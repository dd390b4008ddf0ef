"""Weighted rendezvous sharding with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.llm.store import stored

#: Sub-groups of a shard in which slots are numbered; a slot's offset is the sum of the earlier sub-groups.
SLOT_BUCKETS = 256


def rendezvous_score(key: Column, shard: int, weight: float) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from the MD5 of key and shard; the shard with the least score wins."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{shard}")).cast("binary")), 1, 13), 16, 10)
    return -F.log((h.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def best_shard(key: Column, shards: Sequence[int], weights: Sequence[float]) -> Column:
    """The winning (score, shard) of a key, which is a string."""
    return F.array_min(F.array(*[F.struct(rendezvous_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in zip(shards, weights, strict=True)]))


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", grown_weight: float = 1.0) -> DataFrame:
    """Put each row into one of ``len(weights)`` shards by its key and give it a gapless slot there.

    Returns the key, size (UTF-8 bytes of ``text`` plus 8), text_crc32, law (``key``), shard, slot, and grown_shard: the
    shard if one more (of ``grown_weight``) is added; rows then move only into the new one. Each shard gets rows in
    proportion to its weight. A null key counts as one key of its own; a null text has no bytes and the CRC of none;
    repeated rows share a shard and get slots of their own; an empty table gives an empty one. Other columns are not
    carried. Thin rows are written once and shuffled once, by (shard, sub-group); neither a shard nor the rows of one key
    are gathered in one task.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), best_shard(k, range(n), weights).alias("__best"))
    grown = F.least("__best", F.struct(rendezvous_score(k, n, grown_weight).alias("score"), F.lit(n).alias("shard")))
    # The sub-group goes by the row, not by the key, so the rows of one hot key part too. It is written once, as the
    # counts and the ranks must see the same ones.
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SLOT_BUCKETS)).cast("int")
    rows = stored(placed.select(key, "size", "text_crc32", F.col("__best.shard").alias("shard"), grown["shard"].alias("grown_shard"), bucket.alias("__bucket")), "shard-rows")
    counts = rows.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(F.col(key), "text_crc32", "size"))
    # At most len(weights) * SLOT_BUCKETS rows, whatever the input.
    return (
        rows.withColumn("__rank", slot)
        .join(F.broadcast(offsets), ["shard", "__bucket"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__offset") + F.col("__rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
