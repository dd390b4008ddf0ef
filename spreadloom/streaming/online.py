"""Filters, windows and bars on streams: one small state for each pair, kept by Structured Streaming.

State is typed (a value or a list a pair, in RocksDB, which ``transformWithStateInPandas`` needs: the session's state store
is set to it). A ``reset`` row clears its pair's state; with ``idle_ms``, so does a time without rows, so that pairs that
have stopped cost nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spreadloom.functions import kernels as K
from spreadloom.operators.models import STATE_FIELDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Bars without repeated (symbol, ts) among those that come within ``late`` of one another."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def bars(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of an event stream, final once the watermark has passed them."""
    at = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
    made = grouped.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class _Filter(StatefulProcessor):
    """A filter a key: ``load`` makes it from the values of its state (none: a new one), ``save`` gives those, and ``run``
    takes the rows in order and returns the output. Rows from one that has ``reset`` true on meet a new filter."""

    def __init__(self, fields: str, load: Callable, save: Callable, run: Callable, idle_ms: int | None):
        self.fields, self.load, self.save, self.run, self.idle_ms = T.StructType.fromDDL(fields), load, save, run, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("filter", self.fields, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("idx", ignore_index=True)
        anew = pdf["reset"].fillna(False).astype(bool).to_numpy() if "reset" in pdf else np.zeros(len(pdf), bool)
        f = self.load(tuple(self.held.get()) if self.held.exists() else None)
        for part in np.split(np.arange(len(pdf)), np.flatnonzero(anew)):
            if len(part) and anew[part[0]]:
                self.held.clear()
                f = self.load(None)
            if len(part):
                yield self.run(key[0], f, pdf.iloc[part])
        self.held.update(self.save(f))

    def close(self) -> None:
        pass


def _kept(stream: DataFrame, processor: StatefulProcessor, schema: str, idle_ms: int | None) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy("pair").transformWithStateInPandas(processor, T.StructType.fromDDL(schema), "Append", "ProcessingTime" if idle_ms else "None")


def _columns(stream: DataFrame, *names: str) -> DataFrame:
    return stream.select("pair", "idx", *names, *["reset"] * ("reset" in stream.columns))


def hedge(stream: DataFrame, q: float = 1e-5, r: float = 1e-3, idle_ms: int | None = None) -> DataFrame:
    """The dynamic hedge of each pair, bar by bar (pair, idx, lp_a, lp_b). Rows of a batch are taken in order of ``idx``;
    the state is six numbers a pair, so a restart goes on where the last batch ended. Where the stream has a boolean
    ``reset``, a row that has it true starts its pair's filter anew, before the row is taken in."""

    def run(pair: str, f: K.Hedge, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([f.step(a, b) for a, b in zip(rows["lp_a"].tolist(), rows["lp_b"].tolist(), strict=True)], columns=K.HEDGE_COLUMNS)
        return out.assign(pair=[pair] * len(out), idx=rows["idx"].to_numpy())[["pair", "idx", *K.HEDGE_COLUMNS]]

    held = "beta double, alpha double, p00 double, p01 double, p11 double, n long"
    filters = _Filter(held, lambda state: K.Hedge(q, r, state=state), lambda f: f.state, run, idle_ms)
    return _kept(_columns(stream, "lp_a", "lp_b"), filters, f"pair string, idx long, {STATE_FIELDS}", idle_ms)


def regimes(stream: DataFrame, model: dict, idle_ms: int | None = None) -> DataFrame:
    """Filtered regimes of a stream of features (pair, idx, f0 to f3) under one model; ``reset`` as for :func:`hedge`."""

    def run(pair: str, f: K.Regimes, rows: pd.DataFrame) -> pd.DataFrame:
        out = [f.step(o) for o in rows[["f0", "f1", "f2", "f3"]].to_numpy(float)]
        return pd.DataFrame({"pair": [pair] * len(out), "idx": rows["idx"].to_numpy(), "state": [s for _, s, *_ in out], "kelly_scale": [k for _, _, k, _ in out], "is_no_trade": [n for *_, n in out]})

    load = lambda state: K.Regimes(model["pi"], model["trans"], model["mu"], model["sigma"], state and list(state))
    filters = _Filter("a double, b double, c double", load, lambda f: tuple(np.asarray(f.log_alpha).tolist()), run, idle_ms)
    return _kept(_columns(stream, "f0", "f1", "f2", "f3"), filters, "pair string, idx long, state int, kelly_scale double, is_no_trade boolean", idle_ms)


class _Ring(StatefulProcessor):
    """The last rows of a key in list state; read and written once a batch, one step a row in between."""

    def __init__(self, length: int, step: int, idle_ms: int | None):
        self.length, self.step, self.idle_ms = length, step, idle_ms
        self.row, self.count = T.StructType.fromDDL("idx long, x double"), T.StructType.fromDDL("n long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.row, self.idle_ms)
        self.seen = handle.getValueState("seen", self.count, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        ring: deque = deque(map(tuple, self.rows.get()) if self.rows.exists() else [], maxlen=self.length)
        pdf, out = pd.concat(list(rows)).sort_values("idx"), []
        anew = pdf["reset"].fillna(False).astype(bool).tolist() if "reset" in pdf else [False] * len(pdf)
        for idx, x, fresh in zip(pdf["idx"].tolist(), pdf["x"].tolist(), anew, strict=True):
            if fresh:
                ring.clear()
                seen = 0
            ring.append((idx, x))
            seen += 1
            if seen >= self.length and (seen - self.length) % self.step == 0:
                out.append((key[0], (seen - self.length) // self.step + 1, ring[0][0], idx, [v for _, v in ring]))
        self.rows.put(list(ring))
        self.seen.update((seen,))
        yield pd.DataFrame(out, columns=["pair", "window_id", "first_idx", "last_idx", "values"])

    def close(self) -> None:
        pass


def windowed(stream: DataFrame, length: int, step: int, value: str = "x", idle_ms: int | None = None) -> DataFrame:
    """Count-based sliding windows: (pair, window_id, first_idx, last_idx, values) each time ``length`` rows of a pair are
    there, one every ``step`` rows. The state is a pair's last ``length`` rows and how many came; a ``reset`` row begins
    the count anew."""
    schema = "pair string, window_id long, first_idx long, last_idx long, values array<double>"
    return _kept(_columns(stream.withColumn("x", F.col(value).cast("double")), "x"), _Ring(length, step, idle_ms), schema, idle_ms)
