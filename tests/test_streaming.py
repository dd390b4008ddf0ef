from __future__ import annotations

import datetime as dt
import time

import numpy as np

from spreadloom.functions import kernels as K
from spreadloom.operators import models
from spreadloom.sources import bars as batch
from spreadloom.streaming import online

START = dt.datetime(2024, 1, 1)


def run(df, folder: str, name: str):
    out = f"{folder}/{name}"
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_hedge_over_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(p, k, float(a), float(b)) for p in ("x", "y") for k, (a, b) in enumerate(rng.normal(5, 1, (240, 2)))]
    df = spark.createDataFrame(rows, "pair string, idx long, lp_a double, lp_b double")
    df.where("idx < 80").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(online.hedge(stream), str(tmp_path), "out")
    df.where("idx >= 80").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(online.hedge(stream), str(tmp_path), "out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, models.kalman_states(df).collect()))


def test_regimes(spark, tmp_path):
    rng = np.random.default_rng(2)
    obs = np.abs(np.concatenate([rng.normal(m, 0.2, (250, 4)) for m in (0.5, 1.5, 3.0)]))
    m = K.train_regimes(obs, 1)
    f = K.Regimes(m["pi"], m["trans"], m["mu"], m["sigma"])
    want = [f.step(o)[1] for o in obs]
    df = spark.createDataFrame([("p", k, *map(float, o)) for k, o in enumerate(obs)], "pair string, idx long, f0 double, f1 double, f2 double, f3 double")
    for lo, hi in ((0, 400), (400, 750)):
        df.where(f"idx >= {lo} and idx < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(online.regimes(stream, m), str(tmp_path), "out").orderBy("idx").collect()
    assert [r.state for r in got] == want


def test_bars_and_duplicates(spark, tmp_path):
    rows = [(k, START + dt.timedelta(seconds=20 * k), "e" if k % 5 else "f", float(k % 7)) for k in range(300)]
    late = [(1000, START + dt.timedelta(days=1), "z", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(late, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(online.bars(stream), str(tmp_path), "bars").collect()
    want = batch.event_bars(df, "1 minute").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    twice = online.deduplicated(stream.selectExpr("'A' AS symbol", "date_trunc('minute', ts) AS ts"))
    assert run(twice, str(tmp_path), "once").count() == len({r[1].replace(second=0) for r in rows}) + 1


def test_reset_starts_a_pair_anew(spark, tmp_path):
    rng = np.random.default_rng(4)
    obs = [(float(a), float(b)) for a, b in rng.normal(5, 1, (60, 2))]
    df = spark.createDataFrame([(p, k, a, b, p == "x" and k == 35) for p in ("x", "y") for k, (a, b) in enumerate(obs)], "pair string, idx long, lp_a double, lp_b double, reset boolean")
    for lo, hi in ((0, 30), (30, 60)):
        df.where(f"idx >= {lo} and idx < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.pair, r.idx): tuple(r)[2:] for r in run(online.hedge(stream), str(tmp_path), "out").collect()}
    whole, again = K.Hedge(), K.Hedge()
    want = [whole.step(*o) for o in obs]
    anew = want[:35] + [again.step(*o) for o in obs[35:]]
    assert [got["y", k] for k in range(60)] == want and [got["x", k] for k in range(60)] == anew and anew != want


def test_windows_by_count_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(p, k, float(k * m)) for p, m, n in (("x", 1, 57), ("y", -1, 19)) for k in range(n)], "pair string, idx long, v double")
    for lo, hi in ((0, 13), (13, 14), (14, 60)):
        df.where(f"idx >= {lo} and idx < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(online.windowed(stream, 20, 6, "v"), str(tmp_path), "out").orderBy("window_id").collect()
    want = [(w + 1, 6 * w, 6 * w + 19) for w in range((57 - 20) // 6 + 1)]
    assert [(r.window_id, r.first_idx, r.last_idx) for r in got] == want and {r.pair for r in got} == {"x"}
    assert all(r["values"] == [float(k) for k in range(r.first_idx, r.last_idx + 1)] for r in got)


def test_windows_and_regimes_after_a_reset(spark, tmp_path):
    df = spark.createDataFrame([("x", k, float(k), k == 17) for k in range(45)], "pair string, idx long, v double, reset boolean")
    for lo, hi in ((0, 12), (12, 45)):
        df.where(f"idx >= {lo} and idx < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(online.windowed(stream, 10, 5, "v"), str(tmp_path), "out").orderBy("first_idx").collect()
    assert [(r.window_id, r.first_idx, r.last_idx) for r in got] == [(1, 0, 9), (2, 5, 14), *((k + 1, 17 + 5 * k, 26 + 5 * k) for k in range(4))]
    rng = np.random.default_rng(6)
    obs = np.abs(np.concatenate([rng.normal(m, 0.2, (250, 4)) for m in (0.5, 1.5, 3.0)]))
    m = K.train_regimes(obs, 1)
    part = obs[rng.integers(0, 750, 60)]
    rows = spark.createDataFrame([("p", k, *map(float, o), k in (20, 40)) for k, o in enumerate(part)], "pair string, idx long, f0 double, f1 double, f2 double, f3 double, reset boolean")
    rows.coalesce(1).write.parquet(f"{tmp_path}/obs")
    want = []
    for k, o in enumerate(part):
        f = K.Regimes(m["pi"], m["trans"], m["mu"], m["sigma"]) if k in (0, 20, 40) else f
        want.append(f.step(o)[1])
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/obs")
    assert [r.state for r in run(online.regimes(stream, m), str(tmp_path), "states").orderBy("idx").collect()] == want


def test_an_idle_pair_loses_its_state(spark, tmp_path):
    rng = np.random.default_rng(7)
    obs = [(float(a), float(b)) for a, b in rng.normal(5, 1, (40, 2))]
    df = spark.createDataFrame([("x", k, *o) for k, o in enumerate(obs)], "pair string, idx long, lp_a double, lp_b double")
    whole, again = K.Hedge(), K.Hedge()
    want = [whole.step(*o) for o in obs]
    for idle, name in ((200, "short"), (3_600_000, "long")):
        folder = f"{tmp_path}/{name}"
        df.where("idx < 20").coalesce(1).write.parquet(f"{folder}/in/a")
        stream = online.hedge(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in"), idle_ms=idle)
        q = stream.writeStream.format("memory").queryName(f"idle_{name}").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(processingTime="300 milliseconds").start()
        try:
            for n in (20, 40):
                end = time.time() + 40
                while spark.table(f"idle_{name}").count() < n and time.time() < end:
                    time.sleep(0.3)
                if n == 20:
                    time.sleep(1.5)  # far beyond the short idle time
                    df.where("idx >= 20").coalesce(1).write.parquet(f"{folder}/in/b")
            got = {r.idx: tuple(r)[2:] for r in spark.table(f"idle_{name}").collect()}
        finally:
            q.stop()
        assert [got[k] for k in range(40)] == (want if name == "long" else want[:20] + [again.step(*o) for o in obs[20:]])
