"""Exact deduplication: counting quotient filters find the fingerprints that repeat; bytes are compared for those only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.llm import cqf
from spreadloom.llm.store import small_side, stored

#: Fingerprints that one block of the filters should hold, and the least number of blocks (a power of two).
BLOCK_ROWS, LEAST_BLOCKS = 1 << 18, 1 << 8
#: Runs of these are one space. A single space needs no rewriting, so the pattern looks for all else.
SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``docs`` with the normalised text, its SHA-256 and a fingerprint of 64 of its bits."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    return (
        docs.withColumn("__norm", norm)
        .withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256))
        .withColumn("__fp", F.xxhash64("__sha"))
    )


def repeated_fingerprints(rows: DataFrame, n_rows: int) -> DataFrame:
    """The values of ``__fp`` that ``rows`` has more than once.

    Each task builds one filter; its blocks go to the task of that block, where they merge by sorted remainders. A hot
    value is one remainder with a large count, so nothing grows with the size of a group.
    """
    n_blocks = max(LEAST_BLOCKS, 1 << (max(1, n_rows // BLOCK_ROWS) - 1).bit_length())
    bits = n_blocks.bit_length() - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        if parts:
            made = list(cqf.blocks(np.concatenate(parts), bits))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([f.to_bytes(bits) for _, f in made], pa.binary())], ["block", "filter"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = cqf.merged(list(pdf["filter"]), int(key[0]), bits)
        return pd.DataFrame({"__fp": values[counts > 1].view(np.int64)})

    filters = rows.select("__fp").mapInArrow(build, "block int, filter binary")
    return filters.groupBy("block").applyInPandas(merge, "__fp long")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): one thin row for each document, and one for each text that more than one row has.

    rows: doc_id, __row (unique), __sha. groups: __sha, keep_id, __keep_row, group_size.
    """
    rows = stored(fingerprinted(docs.select("doc_id", "text")).select("doc_id", F.monotonically_increasing_id().alias("__row"), "__sha", "__fp"), "exact-rows")
    repeated = stored(repeated_fingerprints(rows, rows.count()), "exact-repeated")
    repeated = small_side(repeated)
    # The bytes: texts of repeated fingerprints are grouped as they are, so different ones part here. Copies collapse
    # before the shuffle, in the map-side half of the aggregation.
    texts = fingerprinted(docs.select("text")).join(repeated, "__fp", "left_semi").groupBy("__sha", "__norm").agg(F.count("*").alias("n"))
    checked = texts.groupBy("__sha").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n > 1")
    checked = checked.withColumn("__sha", F.when(F.col("texts") == 1, F.col("__sha")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__row"))).alias("first")
    found = rows.join(repeated, "__fp", "left_semi").groupBy("__sha").agg(first, F.count("*").alias("group_size"))
    found = found.join(checked.select("__sha"), "__sha").select("__sha", F.col("first.doc_id").alias("keep_id"), F.col("first.__row").alias("__keep_row"), "group_size")
    return rows, stored(found, "exact-groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of ASCII white space is one space; a null text counts as empty. Of equal
    texts the row with the smallest doc_id stays (one of them if rows repeat; a null doc_id comes last). Every input row
    gives one output row, and other columns are left out; an empty table gives an empty one.
    """
    rows, found = groups(docs)
    own = F.col("__keep_row").isNull()
    return rows.join(small_side(found), "__sha", "left").select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("__row") == F.col("__keep_row"))).alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` drops, with the same columns.

    Documents go by doc_id; where one doc_id has both kept and dropped rows (repeated rows), one row of each of its kept
    texts stays.
    """
    own = [f"__c{k}" for k in range(len(docs.columns))]
    doc_id, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows, found = groups(docs)
    placed = rows.join(small_side(found), "__sha").withColumn("kept", F.col("__row") == F.col("__keep_row"))
    verdict = stored(placed.groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("doc_id").isNull().alias("__none")).agg(F.max("kept").alias("any"), F.min("kept").alias("all")), "exact-verdicts").where("not all")
    keyed = docs.toDF(*own).select(*own, F.coalesce(doc_id, F.lit(-(2**63))).alias("__id"), doc_id.isNull().alias("__none"))
    dropped, mixed = verdict.where("not any").select("__id", "__none"), verdict.where("any").select("__id", "__none")
    if verdict.where("any").isEmpty() and verdict.where("__none").isEmpty():
        return keyed.join(small_side(dropped), ["__id", "__none"], "left_anti").select(own).toDF(*docs.columns)
    # Rows that repeat a doc_id: each is set against the groups by its text.
    bad = dropped.unionByName(mixed)
    rest = keyed.join(small_side(bad), ["__id", "__none"], "left_anti")
    odd = fingerprinted(keyed.join(small_side(bad), ["__id", "__none"], "left_semi").withColumn("text", text))
    firsts = found.select("__sha", F.col("keep_id").alias("__keep_id"), F.lit(True).alias("__grouped"))
    odd = odd.join(small_side(firsts), "__sha", "left").where(F.col("__grouped").isNull() | doc_id.eqNullSafe(F.col("__keep_id")))
    return rest.unionByName(odd.dropDuplicates(["__id", "__none", "__sha"]).select(rest.columns)).select(own).toDF(*docs.columns)
