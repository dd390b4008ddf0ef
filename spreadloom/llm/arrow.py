"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def with_columns_from_text(df: DataFrame, carry: list[str], new: T.StructType, make: Callable[[], Callable[[pa.Array], list]], text: str = "text") -> DataFrame:
    """``carry`` of ``df`` and the ``new`` columns computed from ``text``, batch by batch, without a shuffle.

    ``make()`` runs once in each task and returns a function from the text column to one list or array for each new
    column. A carried column with the name of a new one gives way to it.
    """
    carry = [c for c in carry if c not in new.names]
    schema = T.StructType([*(df.schema[c] for c in carry), *new.fields])
    names = new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        f = make()
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                got = dict(zip(names, f(part.column(text)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) if x.name in got else part.column(x.name).cast(x.type) for x in out], schema=out)

    columns = list(dict.fromkeys([*carry, text]))
    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)
