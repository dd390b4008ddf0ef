"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.llm.arrow import with_columns_from_text
from spreadloom.llm.textscan import buffers


@dataclass(frozen=True)
class Settings:
    """The network and its training. ``sample`` bounds the labelled rows it is fitted on, for each language.

    Bytes become ``classes`` symbols (the most common ones of the sample, and one for the rest), so that a filter over
    two symbols is one table of rows, and wider filters are sums of such rows.
    """

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    dim: int = 8
    classes: int = 64
    sample: int = 400
    crops: int = 6
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    seed: int = 11
    #: Predictions with a lower mean probability are rejected by :func:`identified`.
    least_score: float = 0.5


def _parts(widths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(filter, offset, symbols) of the table rows that make up each filter's sum."""
    return [(i, j, min(2, w - j)) for i, w in enumerate(widths) for j in range(0, w, 2)]


class Network:
    """Embedding, convolutions of several widths, maximum over a window, and softmax."""

    def __init__(self, labels: list[str], symbol: np.ndarray, weights: dict, s: Settings):
        self.labels, self.symbol, self.weights, self.s = labels, symbol, weights, s

    @functools.cached_property
    def tables(self) -> list[np.ndarray]:
        """What one or two neighbouring symbols add to a filter's output, for each part of it."""
        e, out = self.weights["embed"], []
        for i, j, k in _parts(self.s.widths):
            one = [e @ self.weights[f"conv{i}"][j + d] for d in range(k)]
            out.append(np.ascontiguousarray((one[0] if k == 1 else (one[0][:, None] + one[1][None]).reshape(-1, self.s.filters)).astype(np.float32)))
        return out

    def features(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """The pooled filters of windows of symbols (n, window), and with ``keep`` where each maximum was."""
        n, length = x.shape
        pair = x[:, :-1].astype(np.int32) * self.s.classes + x[:, 1:]
        sums: list = [None] * len(self.s.widths)
        for (i, j, k), table in zip(_parts(self.s.widths), self.tables, strict=True):
            reach = length - self.s.widths[i] + 1
            got = table[(pair if k == 2 else x)[:, j : j + reach]]
            sums[i] = got if sums[i] is None else sums[i].__iadd__(got)
        at = [y.argmax(1) for y in sums] if keep else []
        pooled = np.concatenate([y.max(1) for y in sums], 1) + self.weights["bias"]
        return np.maximum(pooled, 0), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)[0] @ self.weights["out"] + self.weights["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _padded(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint8)
    out[: len(data)] = data
    return out


def train(rows: list[tuple[str, str]], s: Settings = Settings()) -> Network | None:  # noqa: B008
    """A network fitted to (text, lang) rows; None if there are none."""
    rng = np.random.default_rng(s.seed)
    rows = sorted((t, lang) for t, lang in rows if t and lang)
    if not rows:
        return None
    labels = sorted({lang for _, lang in rows})
    counts = np.bincount(np.frombuffer(b"".join(t.encode() for t, _ in rows), np.uint8), minlength=256)
    counts[0] = 0
    common = np.argsort(-counts, kind="stable")[: s.classes - 2]
    symbol = np.ones(256, np.uint8)
    symbol[common] = np.arange(2, s.classes)
    symbol[0] = 0  # padding
    xs, ys = [], []
    for t, lang in rows:
        data = symbol[np.frombuffer(t.encode(), np.uint8)]
        for _ in range(min(s.crops, 1 + len(data) // 64)):
            size = int(min(len(data), s.window if rng.random() < 0.5 else rng.integers(8, s.window)))
            a = int(rng.integers(0, len(data) - size + 1))
            xs.append(_padded(data[a : a + size], s.window))
            ys.append(labels.index(lang))
    x, y = np.stack(xs), np.array(ys)
    k, f = len(s.widths), s.filters
    share = len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels))))
    w = {"embed": rng.normal(0, 0.5, (s.classes, s.dim)), "bias": np.zeros(k * f), "out": rng.normal(0, 0.3, (k * f, len(labels))), "out_bias": np.zeros(len(labels))}
    w |= {f"conv{i}": rng.normal(0, (2 / (width * s.dim)) ** 0.5, (width, s.dim, f)) for i, width in enumerate(s.widths)}
    m1, m2, step = {n: np.zeros_like(v) for n, v in w.items()}, {n: np.zeros_like(v) for n, v in w.items()}, 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), s.batch):
            pick = order[a : a + s.batch]
            net = Network(labels, symbol, w, s)
            h, at = net.features(x[pick], keep=True)
            z = h @ w["out"] + w["out_bias"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            dz = p * share[y[pick], None] / len(pick)
            g = {"out": h.T @ dz, "out_bias": dz.sum(0), "embed": np.zeros_like(w["embed"])}
            dh = (dz @ w["out"].T) * (h > 0)
            g["bias"] = dh.sum(0)
            for i, width in enumerate(s.widths):
                d = dh[:, i * f : (i + 1) * f]
                g[f"conv{i}"] = np.zeros_like(w[f"conv{i}"])
                for j in range(width):
                    sym = np.take_along_axis(x[pick], at[i] + j, 1)  # the symbol under each filter's maximum
                    e = w["embed"][sym]
                    g[f"conv{i}"][j] = np.einsum("nf,nfd->df", d, e)
                    np.add.at(g["embed"], sym, d[..., None] * w[f"conv{i}"][j].T[None])
            step += 1
            rate = s.rate * (1 - epoch / s.epochs)
            for n, v in w.items():
                m1[n] = 0.9 * m1[n] + 0.1 * g[n]
                m2[n] = 0.999 * m2[n] + 0.001 * g[n] ** 2
                w[n] = v - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
    return Network(labels, symbol, {n: v.astype(np.float32) for n, v in w.items()}, s)


def lowest(docs: DataFrame, key: str, counts: dict, most: int) -> DataFrame:
    """doc_id and ``key`` of the ``most`` rows of each value in ``counts`` (its rows) whose doc_id hashes lowest.

    Rows whose hash stands beyond four times their share go before any are ranked, so a value that most rows have brings
    some ``4 * most`` of them to the task that ranks it.
    """
    h = F.xxhash64("doc_id")
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 4 * most / n))])
    few = docs.select("doc_id", key).where(h / 2.0**64 + 0.5 <= share[F.col(key)])
    return few.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(h, "doc_id"))).where(F.col("k") <= most).drop("k")


def sample(docs: DataFrame, s: Settings) -> list[tuple[str, str]]:
    """At most ``s.sample`` labelled rows of each language, those whose doc_id hashes lowest."""
    labelled = docs.where("lang is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().toLocalIterator()}  # one for each of the network's outputs
    if not counts:
        return []
    # At most s.sample rows a language, so the broadcast is small whatever the table.
    rows = labelled.join(F.broadcast(lowest(labelled, "lang", counts, s.sample).select("doc_id").distinct()), "doc_id", "left_semi")
    return [(r[0], r[1]) for r in rows.select("text", "lang").toLocalIterator() if r[0]]


def _spread(parts: Iterator[tuple[int, np.ndarray]], net: Network, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's summed window probabilities, weighted by the windows' bytes, and those weights' sum."""
    total, weight = np.zeros((n, len(net.labels))), np.zeros(n)
    for rows, x in parts:
        size = (x > 0).sum(1)
        np.add.at(total, rows, net.probabilities(x) * size[:, None])
        np.add.at(weight, rows, size)
    return total, weight


def windows(col: pa.Array, net: Network, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, windows) in batches: all texts cut into windows of fixed length, the last of each padded."""
    buf, offs = buffers(col)
    size = np.diff(offs)
    n = -(-size // net.s.window)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start, end = offs[row] + nth * net.s.window, offs[row + 1] if len(row) else offs[:0]
    steps = np.arange(net.s.window)
    for a in range(0, len(row), at_once):
        at = start[a : a + at_once, None] + steps
        inside = at < end[a : a + at_once, None]
        yield row[a : a + at_once], np.where(inside, net.symbol[buf[np.minimum(at, len(buf) - 1)]], 0).astype(np.uint8)


def predict(docs: DataFrame, net: Network | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, lang_pred and score (0 to 1, the mean probability of that language over the whole text).

    A null text, one without a letter, and any text if nothing was learned is ``und`` with score 0. Very long texts are
    more windows, not larger ones; ties go to the language that sorts first; repeated rows are predicted alike and an
    empty table gives an empty one. Only the text is looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = model.value

        def run(col: pa.Array) -> list:
            n = len(col)
            lettered = pc.fill_null(pc.match_substring_regex(col, r"\pL"), False).to_numpy(zero_copy_only=False)
            if net is None:
                return [["und"] * n, [0.0] * n]
            total, weight = _spread(windows(col, net), net, n)
            p = total / np.maximum(weight, 1)[:, None]
            best = p.argmax(1)
            score = np.where(lettered, np.clip(p[np.arange(n), best], 0, 1), 0.0)
            return [[net.labels[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score]

        return run

    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return with_columns_from_text(docs, list(carry), new, make)


def held_out() -> Column:
    """Documents that are kept from training: the CRC-32 of doc_id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, net: Network | None, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The documents whose language is known well enough, with the columns of ``docs``."""
    own = [f"__c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")]))
    return predict(named, net, tuple(own)).where((F.col("lang_pred") != "und") & (F.col("score") >= s.least_score)).select(own).toDF(*docs.columns)
