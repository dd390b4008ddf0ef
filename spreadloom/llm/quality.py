"""Text quality from weak labels: EM weighs overlapping heuristic labellers, and their posteriors train a linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.llm.arrow import with_columns_from_text
from spreadloom.llm.langid import lowest
from spreadloom.llm.store import dropped, stored
from spreadloom.llm.textscan import Words, mix, steps


@dataclass(frozen=True)
class Settings:
    """``buckets`` of the hashed features; ``per_pattern`` bounds the rows of each vote pattern that train the scorer,
    ``patterns`` the patterns they come from (the most frequent); ``keep`` is the least score of a kept document."""

    buckets: int = 1 << 12
    per_pattern: int = 120
    patterns: int = 60
    rounds: int = 60
    steps: int = 300
    rate: float = 0.05
    penalty: float = 1e-4
    keep: float = 0.5


#: The labellers: what each looks at, from where on it votes for good, and from where on for bad. Between, it abstains.
LABELLERS = (
    ("symbols", 0.015, 0.06),  # bytes that are signs of no prose
    ("shouting", 0.15, 0.35),  # capitals among ASCII letters
    ("letters", 0.90, 0.84),  # bytes of letters and spaces (more is better)
    ("variety", 0.45, 0.30),  # distinct words among all (more is better; of long texts less is asked)
    ("lines", 0.15, 0.30),  # repeated lines among all
    ("word_size", 8.0, 11.0),  # mean bytes of a word between white space
    ("stops", 0.004, 0.0015),  # full stops a byte (more is better)
    ("runs", 0.02, 0.10),  # words equal to the one before
)
_b = np.arange(256)
_SIGNS = np.isin(_b, [ord(c) for c in "*#$%&@~^=<>{}[]\\|!_+"])
_CAPITAL, _SMALL = (_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122)
_PROSE = _CAPITAL | _SMALL | (_b >= 128) | (_b == 32) | (_b == 10)


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, bool)
    return np.bincount(row[fresh], minlength=n)


def measures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What the labellers look at, (rows, labellers); rows without words have NaN."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    w = Words(buf, offs, "space")
    h = w.hashes()
    count = np.maximum(w.counts, 1)
    row = np.repeat(np.arange(n), w.counts)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    capital, small = _sums(_CAPITAL[buf], offs), _sums(_SMALL[buf], offs)
    # A line hashes to the sum of its words' mixed with their places in it; equal lines have equal sums.
    ends = np.flatnonzero(buf == 10)
    line = np.searchsorted(ends, w.start) + row  # words of different rows are on different lines
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    lines = np.add.reduceat(mix(h + place.astype(np.uint64)), first) if len(first) else h
    line_row = row[first]
    n_lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    out = np.stack([
        _sums(_SIGNS[buf], offs) / size,
        capital / np.maximum(capital + small, 1),
        _sums(_PROSE[buf], offs) / size,
        _distinct(h, row, n) / count * np.maximum(1, count / 300) ** 0.3,
        1 - _distinct(lines, line_row, n) / n_lines,
        np.bincount(row, (w.end - w.start).astype(np.float64), n) / count,
        _sums(buf == 46, offs) / size,
        _sums_at(same, row, n) / count,
    ], 1)
    out[w.counts == 0] = np.nan
    return out


def _sums_at(flags: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, flags.astype(np.float64), n)


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 abstains, for each labeller. A text without words is bad to all."""
    good, bad = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    more = good > bad
    v = np.full(m.shape, 2)
    with np.errstate(invalid="ignore"):
        v[np.where(more, m >= good, m <= good)] = 1
        v[np.where(more, m <= bad, m >= bad)] = 0
    v[np.isnan(m)] = 0
    return v


_POWERS = 3 ** np.arange(len(LABELLERS))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """The posterior of good for each vote pattern, by expectation-maximisation over what each labeller says of good and
    of bad texts. It starts from the majority of those that do not abstain."""
    v = patterns[:, None] // _POWERS % 3
    says = np.stack([v == k for k in range(3)], 2)
    p = ((v == 1).sum(1) + 1.0) / ((v < 2).sum(1) + 2.0)
    p = np.where((v == 0).any(1), np.minimum(p, 0.4), p)
    for _ in range(rounds):
        good, bad = counts * p, counts * (1 - p)
        lg = np.log((np.einsum("n,nlk->lk", good, says) + 1) / (good.sum() + 3))
        lb = np.log((np.einsum("n,nlk->lk", bad, says) + 1) / (bad.sum() + 3))
        z = np.log((good.sum() + 1) / (bad.sum() + 1)) + np.einsum("nlk,lk->n", says, lg - lb)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p


# ---- the scorer -----------------------------------------------------------------------------------------------------
def _grams(buf: np.ndarray, buckets: int) -> np.ndarray:
    """The hashed feature of each run of three bytes: letters count alike by case and kind, so signs and shapes show."""
    kind = np.select([_CAPITAL, _SMALL, (_b >= 48) & (_b <= 57), _b >= 128], [65, _b, 48, 128], _b).astype(np.uint64)
    x = kind[buf]
    y = x[:-2] * np.uint64(65537) + x[1:-1] * np.uint64(257) + x[2:] if len(x) > 2 else np.empty(0, np.uint64)
    return (mix(y) >> np.uint64(40)).astype(np.int64) % buckets


def _cells(m: np.ndarray, buckets: int) -> np.ndarray:
    """The hashed features of what was measured: each labeller's measure in tenths of its range."""
    good, bad = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    step = np.clip(np.nan_to_num((m - bad) / (good - bad) * 4, nan=-8), -8, 12).astype(np.int64) + 8
    return (mix((step + 32 * np.arange(m.shape[1])).astype(np.uint64) ^ np.uint64(0x5EED)) >> np.uint64(40)).astype(np.int64) % buckets


def features(buf: np.ndarray, offs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(hashed run of each byte, hashed cells of each row)."""
    return _grams(buf, s.buckets), _cells(measures(buf, offs), s.buckets)


def _sparse(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's features start, their numbers, their values); the last one of each text is the constant."""
    starts, at, values, n = [], [], [], 0
    for _, buf, offs in steps(pa.array(texts, pa.large_string())):
        g, cells = features(buf, offs, s)
        for k in range(len(offs) - 1):
            own, count = np.unique(g[offs[k] : max(offs[k], min(offs[k + 1] - 2, len(g)))], return_counts=True)
            starts.append(n)
            at += [own, s.buckets + cells[k], [2 * s.buckets]]
            values += [count / max(1, count.sum()), np.full(cells.shape[1], 1 / cells.shape[1]), [1.0]]
            n += len(own) + cells.shape[1] + 1
    return np.array(starts), np.concatenate(at).astype(np.int32), np.concatenate(values).astype(np.float32)


def train(texts: list[str], target: np.ndarray, weight: np.ndarray, s: Settings) -> np.ndarray | None:
    """Weights of a logistic scorer (the last is the constant) fitted to soft labels."""
    if not len(texts):
        return None
    starts, at, values = _sparse(texts, s)
    size = np.diff(np.append(starts, len(at)))
    w, m1, m2 = (np.zeros(2 * s.buckets + 1) for _ in range(3))
    weight = weight / weight.sum()
    for k in range(1, s.steps + 1):
        p = 1 / (1 + np.exp(-np.add.reduceat(values * w[at], starts)))
        g = np.bincount(at, values * np.repeat((p - target) * weight, size), len(w)) + s.penalty * np.append(w[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w - 10 * s.rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    return w.astype(np.float32)


def _voted(docs: DataFrame) -> DataFrame:
    def make():
        def run(col: pa.Array) -> list:
            got = [votes(measures(buf, offs)) @ _POWERS for _, buf, offs in steps(col)]
            return [np.concatenate(got) if got else np.empty(0, np.int64)]

        return run

    return with_columns_from_text(docs, ["doc_id"], T.StructType().add("pattern", T.LongType()), make)


def scored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, weak_label (the labellers' posterior), score (0 to 1, the linear scorer's) and kept.

    The labellers vote on every whole text; the posterior depends on the pattern of votes only, so EM runs on the counts
    of patterns (at most 3 to the power of the labellers) over all documents. The scorer is fitted to a bounded sample:
    of each frequent pattern the ``per_pattern`` rows whose doc_id hashes lowest. A text without words, or null, gets
    score 0 and is not kept; rows that repeat get the same; with no words anywhere nothing is learned and all scores are
    those of the labellers. An empty table gives an empty one. Other columns, and true labels, are not looked at.
    """
    spark = docs.sparkSession
    voted = stored(_voted(docs), "quality-votes")
    found = voted.groupBy("pattern").count().toPandas().sort_values("pattern")
    patterns, counts = found["pattern"].to_numpy(np.int64), found["count"].to_numpy(np.float64)
    posterior = fit_labellers(patterns, counts, s.rounds) if len(patterns) else np.empty(0)
    by = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    top = found.sort_values(["count", "pattern"], ascending=[False, True]).head(s.patterns)["pattern"].tolist()
    size = dict(zip(patterns.tolist(), counts.tolist(), strict=True))
    ids = lowest(voted, "pattern", {p: size[p] for p in top}, s.per_pattern).groupBy("doc_id").agg(F.min("pattern").alias("pattern")) if top else None
    # At most per_pattern * patterns rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "pattern").toLocalIterator() if top else []
    rows = [(r[0], r[1]) for r in rows]
    dropped(voted)
    seen: dict[int, int] = {}
    for _, p in rows:
        seen[p] = seen.get(p, 0) + 1
    model = train([t for t, _ in rows], np.array([by[p] for _, p in rows], np.float32), np.array([(size[p] / seen[p]) ** 0.5 for _, p in rows]), s)
    shared = spark.sparkContext.broadcast((model, by))

    def make():
        w, by = shared.value

        def run(col: pa.Array) -> list:
            weak, score = [], []
            for _, buf, offs in steps(col):
                m = measures(buf, offs)
                p = np.array([by[x] for x in (votes(m) @ _POWERS).tolist()])
                z = np.log(p / (1 - p))
                if w is not None:
                    g = np.concatenate([[0], np.cumsum(w[_grams(buf, s.buckets)], dtype=np.float64)])
                    last = np.clip(np.minimum(offs[1:] - 2, len(g) - 1), offs[:-1].clip(max=len(g) - 1), None)
                    n = last - offs[:-1].clip(max=len(g) - 1)
                    z = (g[last] - g[offs[:-1].clip(max=len(g) - 1)]) / np.maximum(n, 1) + w[s.buckets + _cells(m, s.buckets)].mean(1) + w[-1]
                q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                q[np.isnan(m).any(1)] = 0
                weak.append(p)
                score.append(q)
            return [np.concatenate(x) if x else [] for x in (weak, score)]

        return run

    new = T.StructType().add("weak_label", T.DoubleType()).add("score", T.DoubleType())
    return with_columns_from_text(docs, ["doc_id"], new, make).withColumn("kept", F.col("score") >= s.keep)
