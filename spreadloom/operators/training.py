"""Regime models trained over series of any length: expectation-maximisation by chunk, one small model a pair and round.

A pair's rows are packed into chunks once. In each round a chunk tells its forward matrix; from those of the chunks before
and after it, it gets the probabilities at its two ends, and so its expected counts, which tasks add up by pair before they
are sent. What a round hands on is a stored table with one model a pair; a pair that has converged takes no further part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions import kernels as K
from spreadloom.operators import pairs, scans, series
from spreadloom.sources.scratch import stored

#: Rows of a chunk.
CHUNK = 16_384
FEATURES = scans.FEATURES
S, D = K.STATES, K.FEATURES
_MODEL = "pair string, pi array<double>, trans array<double>, mu array<double>, sigma array<double>, likes array<double>, turn int, converged boolean, done boolean"
_STATE = ["pair", "pi", "trans", "mu", "sigma", "likes", "turn", "converged", "done"]


def packed(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """pair, chunk, n, obs: the finite rows (pair, idx, f0 to f3) of each pair in order, ``size`` a chunk, as a stored table."""
    finite = F.lit(True)
    for c in FEATURES:
        finite = finite & (F.abs(c) < float("inf"))
    own = pairs.numbered(rows.where(finite).select("pair", "idx", *FEATURES), "pair", series.bucket_of(F.col("idx"), size), ("idx",), "j")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, len(pdf), pdf.sort_values("j")[FEATURES].to_numpy(float).tobytes())], columns=["pair", "chunk", "n", "obs"])

    return stored(own.withColumn("chunk", series.bucket_of(F.col("j"), size)).groupBy("pair", "chunk").applyInPandas(pack, "pair string, chunk long, n long, obs binary"), "regime-chunks")


def _obs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, float).reshape(-1, D)


def _by_chunk(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f`` of each row, which gives one tuple or none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for r in pdf.itertuples(index=False) if (x := f(r)) is not None], columns=names)

    return df.mapInPandas(run, schema)


def _by_pair(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f`` of (pair, its rows), which gives a list of tuples."""
    names = [c.split()[0] for c in schema.split(", ")]
    return df.groupBy("pair").applyInPandas(lambda key, pdf: pd.DataFrame(f(key[0], pdf), columns=names), schema)


def _started(chunks: DataFrame, seed: int) -> DataFrame:
    """The first model of each pair with enough rows: means at rows picked far from each other, equal spreads and chances.

    Draws are those of one generator a pair: the first row of all, then each next one by its squared distance from those
    picked, found by the chunks' sums and then inside one chunk.
    """

    def moments(r) -> tuple:
        x = _obs(r.obs)
        return r.pair, r.n, x.mean(0).tolist(), ((x - x.mean(0)) ** 2).sum(0).tolist()

    def merged(pair: str, pdf: pd.DataFrame) -> list:
        n = pdf["n"].to_numpy(float)
        if n.sum() < K.MIN_TRAIN:
            return []
        means, own = np.array(pdf["mean"].tolist()), np.array(pdf["m2"].tolist())
        mean = n @ means / n.sum()
        sd = np.sqrt((own.sum(0) + n @ (means - mean) ** 2) / n.sum())
        t, rng = int(n.sum()), np.random.default_rng(seed)
        return [(pair, t, (sd + K.MIN_VAR).tolist(), int(rng.integers(0, t)), 0.0, [])]

    schema = "pair string, t long, sd array<double>, pick long, u double, picked array<double>"
    state = _by_pair(_by_chunk(chunks, moments, "pair string, n long, mean array<double>, m2 array<double>"), merged, schema)
    firsts = chunks.groupBy("pair", "chunk").agg(F.first("n").alias("n"))
    # Chunks but the last are full, so the longest tells where a row is.
    longest = firsts.groupBy("pair").agg(F.max("n").alias("size"))
    for k in range(S):
        state = stored(state.join(longest, "pair"), "regime-picks")
        if k:
            def far(r) -> tuple:
                x = _obs(r.obs)
                d = ((x[:, None] - np.array(r.picked).reshape(-1, D)) ** 2).sum(2).min(1)
                return r.pair, r.chunk, float(d.sum()), r.t, r.sd, r.picked, r.size

            def choose(pair: str, pdf: pd.DataFrame, k: int = k) -> list:
                pdf = pdf.sort_values("chunk")
                sums, first = np.cumsum(pdf["d"].to_numpy()), pdf.iloc[0]
                rng = np.random.default_rng(seed)
                rng.integers(0, int(first["t"]))
                for _ in range(k - 1):
                    rng.random()
                if sums[-1] <= K.MIN_DENOMINATOR:
                    j = int(rng.integers(0, int(first["t"])))
                    return [(pair, first["t"], first["sd"], j // int(first["size"]), float(j % int(first["size"])), False, first["picked"])]
                at = rng.random() * sums[-1]
                c = min(int(np.searchsorted(sums, at, "right")), len(sums) - 1)
                return [(pair, first["t"], first["sd"], int(pdf["chunk"].iloc[c]), float(at - (sums[c - 1] if c else 0.0)), True, first["picked"])]

            sums = _by_chunk(chunks.join(state, "pair"), far, "pair string, chunk long, d double, t long, sd array<double>, picked array<double>, size long")
            chosen = _by_pair(sums, choose, "pair string, t long, sd array<double>, chunk long, u double, near boolean, picked array<double>")
        else:
            at, size = F.col("pick"), F.col("size")
            chosen = state.select("pair", "t", "sd", F.floor(at / size).alias("chunk"), F.pmod(at, size).cast("double").alias("u"), F.lit(False).alias("near"), "picked")

        def take(r) -> tuple:
            x, j = _obs(r.obs), int(r.u)
            if r.near:
                d = ((x[:, None] - np.array(r.picked).reshape(-1, D)) ** 2).sum(2).min(1)
                j = min(int(np.searchsorted(np.cumsum(d), r.u, "right")), len(x) - 1)
            return r.pair, r.t, r.sd, 0, 0.0, [*r.picked, *x[j].tolist()]

        state = _by_chunk(chunks.join(chosen, ["pair", "chunk"]), take, schema)
    flat = F.array_repeat(F.lit(1.0 / S), S)
    return state.select(
        "pair", flat.alias("pi"), F.array_repeat(F.lit(1.0 / S), S * S).alias("trans"), F.col("picked").alias("mu"), F.flatten(F.array_repeat("sd", S)).alias("sigma"),
        F.array().cast("array<double>").alias("likes"), F.lit(0).alias("turn"), F.lit(False).alias("converged"), F.lit(False).alias("done"),
    )


def _densities(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rows, transition matrix, densities relative to each row's best state, the logs of the latter summed)."""
    x, trans = _obs(r.obs), np.array(r.trans).reshape(S, S)
    logs = K.log_density(x, np.array(r.mu).reshape(S, D), np.array(r.sigma).reshape(S, D))
    best = logs.max(1)
    return x, trans, np.exp(np.maximum(logs - best[:, None], -700.0)), float(best.sum())


def _scaled(first: tuple, then: tuple) -> tuple:
    made = first[0] @ then[0]
    top = made.max((1, 2))
    return made / top[:, None, None], first[1] + then[1] + np.log(top)


def _map(r) -> tuple:
    """A chunk's forward matrix with its scale; the series' first row makes no transition."""
    _, trans, dens, best = _densities(r)
    steps = trans[None] * dens[:, None, :]
    if r.chunk == 0:
        steps[0] = np.diag(dens[0])
    made, scale = scans.folded((steps, np.zeros(len(steps))), _scaled)
    return r.pair, r.chunk, made[0].ravel().tolist(), best + float(scale[0]), r.pi


def _ends(pair: str, pdf: pd.DataFrame) -> list:
    """For each chunk, the states' probabilities before it and what the chunks after it say; and the log-likelihood."""
    pdf = pdf.sort_values("chunk")
    maps, n = [np.array(m).reshape(S, S) for m in pdf["map"]], len(pdf)
    ahead, at, like = [], np.array(pdf["pi"].iloc[0]), float(pdf["scale"].sum())
    for m in maps:
        ahead.append(at)
        at = at @ m
        like, at = like + math.log(at.sum()), at / at.sum()
    behind, at = [None] * n, np.ones(S)
    for k in range(n - 1, -1, -1):
        behind[k] = at
        at = maps[k] @ at
        at = at / at.max()
    return [(pair, int(c), a.tolist(), b.tolist(), like) for c, a, b in zip(pdf["chunk"], ahead, behind, strict=True)]


_STATS = S + S * S + S + 2 * S * D


def _counts(r) -> np.ndarray:
    """A chunk's expected counts: first state, transitions, mass, and sums and squares of rows relative to the old means."""
    x, trans, dens, _ = _densities(r)
    before, mu = np.array(r.ahead), np.array(r.mu).reshape(S, D)
    ahead, scale = K.forward(before if r.chunk == 0 else before @ trans, trans, dens)
    behind = K.backward(trans, dens, scale, tuple(r.behind))
    gamma = ahead * behind
    gamma = np.maximum(gamma / gamma.sum(1, keepdims=True), K.MIN_STATE)
    gamma /= gamma.sum(1, keepdims=True)
    first, into = (gamma[0], ahead[:-1]) if r.chunk == 0 else (np.zeros(S), np.concatenate([before[None], ahead[:-1]]))
    xi = into[:, :, None] * trans * (dens * behind)[len(x) - len(into) :, None, :]
    xi = (xi / xi.sum((1, 2), keepdims=True)).sum(0)
    off = x[:, None] - mu
    return np.concatenate([first, xi.ravel(), gamma.sum(0), np.einsum("tk,tkd->kd", gamma, off).ravel(), np.einsum("tk,tkd->kd", gamma, off * off).ravel()])


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of a task's chunks, added up by pair."""
    held: dict[str, tuple] = {}
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            old = held.get(r.pair)
            held[r.pair] = (_counts(r) + (old[0] if old else 0.0), r)
    yield pd.DataFrame([(p, v.tolist(), r.like, *(getattr(r, c) for c in _STATE[1:7])) for p, (v, r) in held.items()], columns=["pair", "counts", "like", *_STATE[1:7]])


def _updated(pair: str, pdf: pd.DataFrame, rounds: int) -> list:
    """The next model of a pair from its counts, or the same one, done, where the likelihood says so."""
    r = pdf.iloc[0]
    like, likes, turn = float(r["like"]), list(r["likes"]), int(r["turn"])
    keep = lambda likes, converged: [(pair, r["pi"], r["trans"], r["mu"], r["sigma"], likes, turn + 1, converged, True)]
    if not math.isfinite(like):
        return keep(likes, False)
    likes = [*likes, like]
    if turn and (abs(like - likes[-2]) < K.TOLERANCE or like - likes[-2] < -1e-3):
        return keep(likes, abs(like - likes[-2]) < K.TOLERANCE)
    pi, xi, mass, s1, s2 = np.split(np.sum(pdf["counts"].tolist(), axis=0), np.cumsum([S, S * S, S, S * D]))
    pi = np.maximum(pi, K.MIN_STATE)
    xi = xi.reshape(S, S)
    trans = np.maximum(xi / np.maximum(xi.sum(1, keepdims=True), K.MIN_DENOMINATOR), K.MIN_STATE)
    mass = np.maximum(mass, K.MIN_DENOMINATOR)[:, None]
    move = s1.reshape(S, D) / mass
    mu = np.array(r["mu"]).reshape(S, D) + move
    sigma = np.sqrt(np.maximum(s2.reshape(S, D) / mass - move * move, K.MIN_VAR))
    made = [(pi / pi.sum()).tolist(), (trans / trans.sum(1, keepdims=True)).ravel().tolist(), mu.ravel().tolist(), sigma.ravel().tolist()]
    return [(pair, *made, likes, turn + 1, False, turn + 1 >= rounds)]


def train_regimes(rows: DataFrame, seed: int = 42, size: int = CHUNK, rounds: int = K.MAX_ROUNDS) -> DataFrame:
    """One regime model a pair (pair, idx, f0 to f3), as ``models.train_regimes`` gives it, with no series in one task.

    Results equal those of the kernel to rounding. Pairs with too few finite rows get a row that is not valid. A round is
    one Spark job; at most ``rounds`` are made, each over the pairs that have not converged.
    """
    chunks = packed(rows, size)
    model = stored(_started(chunks, seed), "regime-model")
    finished = []
    held = ", ".join(f"{c} array<double>" for c in ("pi", "trans", "mu", "sigma", "likes"))
    while not model.isEmpty():
        own = chunks.join(model.drop("done", "converged"), "pair")
        ends = _by_pair(_by_chunk(own, _map, "pair string, chunk long, map array<double>, scale double, pi array<double>"), _ends, "pair string, chunk long, ahead array<double>, behind array<double>, like double")
        counts = own.join(ends, ["pair", "chunk"]).mapInPandas(_summed, f"pair string, counts array<double>, like double, {held}, turn int")
        every = stored(_by_pair(counts, lambda pair, pdf: _updated(pair, pdf, rounds), _MODEL), "regime-model")
        finished.append(every.where("done"))
        model = every.where("not done")
    sizes = chunks.groupBy("pair").agg(F.sum("n").cast("int").alias("n_train"))
    out = model.drop("turn")
    for f in finished:
        out = out.unionByName(f.drop("turn"))
    every = rows.select("pair").distinct().join(out, "pair", "left").join(sizes, "pair", "left")
    ok = F.coalesce(F.size("likes") > 0, F.lit(False))
    none = F.array().cast("array<double>")
    return every.select(
        "pair", *[F.when(ok, F.col(c)).otherwise(none).alias(c) for c in ("pi", "trans", "mu", "sigma")], F.when(ok, F.size("likes")).otherwise(0).cast("int").alias("n_iters"),
        F.when(ok, F.col("n_train")).otherwise(0).cast("int").alias("n_train"), (ok & F.coalesce("converged", F.lit(False))).alias("converged"), F.when(ok, F.element_at("likes", -1)).alias("log_like"), ok.alias("is_valid"),
    )
