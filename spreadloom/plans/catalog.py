"""The registered queries of the analytics engine, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.functions import guards as G
from spreadloom.operators import metrics, models, pairs, quality, rolling, series, sizing
from spreadloom.plans import backtest, fixtures
from spreadloom.plans.fixtures import table
from spreadloom.sources import bars, scratch, sinks
from spreadloom.streaming import online

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of two engines do not matter; -0.0 is 0.0."""
    kind = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if kind[c] == "double" else F.col(c) for c in df.columns])


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


B0 = "b0 AS (SELECT l_returnflag AS symbol, l_shipdate::TIMESTAMP AS ts, floor(sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (sum(l_quantity) * 100) * 1e6 + 0.5) / 1e6 AS close, sum(l_quantity)::DOUBLE AS volume FROM lineitem GROUP BY 1, 2)"
BARS = B0 + """,
    sm AS (SELECT symbol, ts, volume, row_number() OVER w AS k, round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING), 8) AS close FROM b0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    op AS (SELECT symbol, ts, close, volume, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open FROM sm WHERE k >= 60),
    bars AS (SELECT symbol, ts, open, greatest(open, close) AS high, least(open, close) AS low, close, volume FROM op)"""
ROWS = BARS + """,
    al AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, a.close AS close_a, b.close AS close_b, a.volume AS volume, ln(greatest(a.close, 1e-8)) AS lp_a, ln(greatest(b.close, 1e-8)) AS lp_b FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS idx FROM al)"""
HEDGE = ROWS + """,
    fit AS (SELECT pair, count(*) AS n, regr_slope(lp_a, lp_b) AS beta, regr_intercept(lp_a, lp_b) AS alpha, regr_r2(lp_a, lp_b) AS r2 FROM r GROUP BY 1),
    sp AS (SELECT r.pair, idx, ts, volume, lp_a, lp_b, lp_a - beta * lp_b - alpha AS spread, pow(lp_a - lp_b, 2) + 1e-6 AS innov_var FROM r JOIN fit USING (pair))"""

def sql_n(v: str, fb: str = "0.0") -> str:
    return f"(CASE WHEN isfinite({v}) AND abs({v}) <= 999 THEN {v} ELSE {fb} END)"


def sql_div(n: str, d: str, fb: str = "0.0") -> str:
    a, b = sql_n(n, fb), sql_n(d)
    return f"(CASE WHEN abs({b}) < 1e-10 THEN {fb} ELSE {sql_n(f'({a} / {b})', fb)} END)"


def sql_clamp(v: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN isfinite({v}) THEN greatest({lo}, least({hi}, {v})) ELSE {lo} END)"


# ---- bars -----------------------------------------------------------------------------------------------------------
@query(f"WITH {BARS} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, open, high, low, close, volume FROM bars")
def bars_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day(fixtures.smooth(spark, sf_dir)).select("symbol", "day", "open", "high", "low", "close", "volume")


@query("""SELECT symbol, day, close FROM (SELECT l_returnflag AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS day, l_extendedprice / l_quantity AS close,
    row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def bars_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), *order)
    return day(quality.deduplicated(raw, [F.col(c) for c in order])).select("symbol", "day", "close")


DIRTY = B0 + """,
    kb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b0),
    db AS (SELECT symbol, ts, CASE WHEN k % 89 = 0 THEN -500.0 ELSE close END AS open, CASE WHEN k % 83 = 0 THEN close * 0.9 - 10 ELSE close * 1.01 END AS high, close * 0.99 AS low,
        CASE WHEN k % 97 = 0 THEN 0.0 WHEN k % 79 = 0 THEN close + 500 ELSE close END AS close, CASE WHEN k % 71 = 0 THEN -1.0 ELSE volume END AS volume FROM kb),
    c1 AS (SELECT *, (open <= 0)::INT + (high <= 0)::INT + (low <= 0)::INT + (close <= 0)::INT AS np FROM db),
    c2 AS (SELECT *, CASE WHEN np > 0 THEN NULL WHEN high < open THEN 'high<open' WHEN high < close THEN 'high<close' WHEN low > open THEN 'low>open' WHEN low > close THEN 'low>close' WHEN high < low THEN 'high<low' END AS oe FROM c1),
    c3 AS (SELECT *, np = 0 AND oe IS NULL AND volume >= 0 AS fine FROM c2),
    c4 AS (SELECT *, last_value(CASE WHEN fine THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS pts FROM c3),
    c5 AS (SELECT *, CASE WHEN fine AND before IS NOT NULL THEN ln(close / before) END AS lr FROM c4),
    v AS (SELECT *, coalesce(abs(lr) > 0.2, false) AS spike, concat_ws('|', CASE WHEN open <= 0 THEN 'open<=0' END, CASE WHEN high <= 0 THEN 'high<=0' END, CASE WHEN low <= 0 THEN 'low<=0' END, CASE WHEN close <= 0 THEN 'close<=0' END, oe, CASE WHEN volume < 0 THEN 'volume<0' END, CASE WHEN coalesce(abs(lr) > 0.2, false) THEN 'spike' END) AS reason FROM c5)"""


@query(f"WITH {DIRTY} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, fine AND NOT spike AS valid_bar, reason AS invalid_reason FROM v")
def bars_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day(quality.validated(fixtures.dirty(spark, sf_dir))).select("symbol", "day", "valid_bar", "invalid_reason")


@query(f"WITH {DIRTY} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(lr, 6) + 0.0 AS log_return FROM v WHERE lr IS NOT NULL")
def bars_log_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(day(quality.validated(fixtures.dirty(spark, sf_dir))).select("symbol", "day", "log_return").where("log_return is not null"))


@query(f"WITH {DIRTY} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day FROM v WHERE spike")
def bars_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day(quality.validated(fixtures.dirty(spark, sf_dir)).where("spike")).select("symbol", "day")


@query("""WITH b AS (SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL '1 minute', ts) AS ts FROM events)
    SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE gap > 120) AS n_gaps FROM (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM b) GROUP BY 1""")
def bars_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.validated(bars.event_bars(table(spark, sf_dir, "events"), "1 minute"))
    return found.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.count_if("gap").alias("n_gaps"))


@query("""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, open, high, low, close, volume FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)""")
def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.event_bars(table(spark, sf_dir, "events")).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm")).drop("ts")


@query(f"""WITH {DIRTY} SELECT symbol, count(*) AS n_raw, count(*) FILTER (WHERE fine AND NOT spike) AS n_valid, count(*) FILTER (WHERE NOT (fine AND NOT spike)) AS n_invalid,
    count(*) FILTER (WHERE epoch(ts) - epoch(pts) > 120) AS n_gaps, 0::BIGINT AS n_duplicates, sum(np + (oe IS NOT NULL)::INT)::BIGINT AS n_ohlc_errors, count(*) FILTER (WHERE spike) AS n_spikes,
    count(*) FILTER (WHERE fine AND NOT spike) >= 800 AS ok FROM v GROUP BY 1""")
def bars_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.dirty(spark, sf_dir)
    return quality.summary(raw, quality.validated(quality.deduplicated(raw)), 800).drop("error_message", "warnings")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({sql_n('l_extendedprice')}, 6) + 0.0 AS n, round({sql_div('l_extendedprice', '(l_quantity - 25)', '7.0')}, 6) + 0.0 AS q,
    round({sql_clamp('(l_tax * 1000 - 40)', '0.0', '20.0')}, 6) + 0.0 AS c, CASE WHEN l_discount - 0.02 > 1e-8 THEN round(ln(l_discount - 0.02), 6) + 0.0 END AS l,
    round(CASE WHEN l_discount >= 0.055 THEN sqrt(l_discount - 0.05) ELSE 0.0 END, 6) AS s, round(exp(least(l_tax, 700)), 6) AS e, CASE WHEN l_discount > 1e-8 AND l_tax > 1e-8 THEN round(ln(l_discount / l_tax), 6) + 0.0 END AS r,
    round(greatest(-l_quantity * 50, least(l_quantity * 50, l_extendedprice - 30000)), 6) + 0.0 AS p,
    round(CASE WHEN l_extendedprice - 40000 < 1 THEN 1.0 WHEN l_extendedprice - 40000 > l_quantity * 1000 THEN l_quantity * 100 ELSE l_extendedprice - 40000 END, 6) AS k,
    round(CASE WHEN l_quantity - 2 < 1 THEN 0.0 ELSE {sql_n('(exp(ln(0.95 + l_discount) * 365.0 / (l_quantity - 2)) - 1)')} END, 5) + 0.0 AS y FROM lineitem""")
def guard_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, q, d, t = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "discount", "tax"))
    keys, c = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col
    out = table(spark, sf_dir, "lineitem").select(
        *keys, x.alias("n"), (x - 30000).alias("p"), (x - 40000).alias("k"), (q * 100).alias("__size"), (q - 25).alias("__q25"), (q - 2).alias("__days"), d.alias("__d"), t.alias("__t"),
        (t * 1000 - 40).alias("c"), (d - 0.02).alias("l"), F.when(d >= 0.055, d - 0.05).otherwise(-1.0).alias("s"), t.alias("e"),
    )
    out = G.with_annualised(G.with_log_return(G.with_ratio(out, "q", c("n"), c("__q25"), 7.0), "r", c("__d"), c("__t")), "y", c("__d") - 0.05, c("__days"))
    made = {"n": G.bounded(c("n")), "c": G.clamp(c("c"), 0.0, 20.0), "l": G.safe_log(c("l")), "s": G.safe_sqrt(c("s")), "e": G.safe_exp(c("e")), "p": G.clamp_pnl(c("p"), c("__size")), "k": G.next_capital(c("k"), c("__size"))}
    out = out.withColumns(made)
    real = lambda n: F.when(~F.isnan(n), F.col(n))
    out = out.withColumns({"l": real("l"), "r": real("r"), "y": F.round("y", 5)})
    return rounded(out.select(*keys, "n", "q", "c", "l", "s", "e", "r", "p", "k", "y"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'unsupported symbol' WHEN o_orderkey % 7 = 0 THEN 'times must have a zone' WHEN d <= 0 THEN 'end must be after start' WHEN d < 30 THEN 'range too short' WHEN d > 730 THEN 'range too long' ELSE '' END AS error
    FROM (SELECT o_orderkey, o_custkey % 900 - 50 AS d FROM orders)""")
def arg_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    symbol = F.element_at(F.array(*[F.lit(s) for s in (*bars.SYMBOLS, "DOGE/USD")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    end = F.timestamp_seconds(F.unix_seconds(start) + (F.col("o_custkey") % 900 - 50) * 86400)
    return o.select("o_orderkey", bars.request_error(symbol, start, end, F.col("o_orderkey") % 7 != 0).alias("error"))


# ---- pairs ----------------------------------------------------------------------------------------------------------
@query(f"WITH {ROWS} SELECT pair, strftime(ts, '%Y-%m-%d') AS day, idx, close_a, close_b, round(lp_a, 6) AS lp_a, round(lp_b, 6) AS lp_b FROM r")
def pair_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day(fixtures.rows(spark, sf_dir)).select("pair", "day", "idx", "close_a", "close_b", F.round("lp_a", 6).alias("lp_a"), F.round("lp_b", 6).alias("lp_b"))


@query("SELECT DISTINCT a.l_returnflag AS symbol_a, b.l_returnflag AS symbol_b FROM (SELECT DISTINCT l_returnflag FROM lineitem) a JOIN (SELECT DISTINCT l_returnflag FROM lineitem) b ON a.l_returnflag < b.l_returnflag")
def pair_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.all_pairs(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol")))


@query(f"WITH {B0} SELECT strftime(ts, '%Y-%m-%d') AS day FROM (SELECT ts FROM b0 GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM b0))")
def ts_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times that all symbols have."""
    b = bars.daily_bars(table(spark, sf_dir, "lineitem")).select("symbol", "ts").distinct()
    n = b.agg(F.count_distinct("symbol").alias("n"))
    return day(b.groupBy("ts").agg(F.count("*").alias("n")).join(F.broadcast(n), "n")).select("day")


@query(f"WITH {DIRTY}, ok AS (SELECT symbol, ts, fine AND NOT spike AS valid FROM v) SELECT a.symbol || '-' || b.symbol AS pair, strftime(a.ts, '%Y-%m-%d') AS day, a.valid AND b.valid AS valid FROM ok a JOIN ok b ON a.ts = b.ts AND a.symbol < b.symbol")
def pair_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both bars of each aligned row are valid."""
    b = quality.validated(fixtures.dirty(spark, sf_dir))
    return day(pairs.aligned(b, pairs.all_pairs(b))).select("pair", "day", "valid")


@query(f"WITH {HEDGE} SELECT pair, n, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM fit")
def static_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.static_hedge(fixtures.rows(spark, sf_dir)))


@query(f"WITH {HEDGE} SELECT pair, idx, round(spread, 6) + 0.0 AS spread FROM sp")
def static_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.static_spread(fixtures.rows(spark, sf_dir)).select("pair", "idx", "spread"))


NOISE = ROWS + """,
    hd AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS n FROM r) WHERE idx < greatest(floor(n * 0.3), 110)),
    nz AS (SELECT pair, greatest((regr_syy(lp_a, lp_b) - regr_slope(lp_a, lp_b) * regr_sxy(lp_a, lp_b)) / (count(*) - 2), 1e-10) AS r FROM hd GROUP BY 1)"""


@query(f"WITH {NOISE} SELECT pair, round(greatest(r * 0.01, 1e-8), 9) AS q, round(r, 8) AS r FROM nz")
def noise_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.noise_params(fixtures.rows(spark, sf_dir)).select("pair", F.round("q", 9).alias("q"), F.round("r", 8).alias("r"))


KALMAN = ROWS.replace("b0 AS", "RECURSIVE b0 AS", 1) + """,
    kf AS (
        SELECT pair, -1::BIGINT AS idx, 1.0::DOUBLE AS be, 0.0::DOUBLE AS al, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS e, 0.0::DOUBLE AS s, 0.0::DOUBLE AS spread FROM (SELECT DISTINCT pair FROM r)
        UNION ALL
        SELECT pair, idx, be, al, greatest(t00 * (1 - k0 * b) - t01 * k0 + k0 * k0 * 1e-3, 1e-10), ((-t00 * k1 * b + t01 * (1 - k1) + k0 * k1 * 1e-3) + (t10 * (1 - k0 * b) - t11 * k0 + k0 * k1 * 1e-3)) / 2,
            greatest(-t10 * k1 * b + t11 * (1 - k1) + k1 * k1 * 1e-3, 1e-10), e, s, a - be * b - al
        FROM (SELECT *, (1 - k0 * b) * q00 - k0 * p01 AS t00, (1 - k0 * b) * p01 - k0 * q11 AS t01, -k1 * b * q00 + (1 - k1) * p01 AS t10, -k1 * b * p01 + (1 - k1) * q11 AS t11, be0 + k0 * e AS be, al0 + k1 * e AS al
        FROM (SELECT *, (b * q00 + p01) / s AS k0, (b * p01 + q11) / s AS k1
        FROM (SELECT *, greatest((b * q00 + p01) * b + b * p01 + q11 + 1e-3, 1e-8) AS s
        FROM (SELECT r.pair, r.idx, r.lp_a AS a, r.lp_b AS b, be AS be0, al AS al0, p00 + 1e-5 AS q00, p01, p11 + 1e-5 AS q11, r.lp_a - (r.lp_b * be + al) AS e FROM kf JOIN r ON r.pair = kf.pair AND r.idx = kf.idx + 1))))
    )"""
KALMAN_ROWS = f"WITH {KALMAN} SELECT pair, idx, round(be, 5) + 0.0 AS beta, round(al, 5) + 0.0 AS alpha, round(spread, 5) + 0.0 AS spread, round(e, 5) + 0.0 AS innovation, round(s, 5) AS innov_var, round(p00, 5) AS p00, round(p11, 5) AS p11, idx >= 100 AS is_warmed_up FROM kf WHERE idx >= 0"


@query(KALMAN_ROWS)
def kalman_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.kalman_states(fixtures.rows(spark, sf_dir)), 5)


@query(f"""WITH {KALMAN} SELECT pair, count(*) AS n_bars, count(*) FILTER (WHERE idx >= 100) AS n_warmed_up, round(min(spread), 5) AS spread_min, round(max(spread), 5) AS spread_max, round(avg(spread), 5) + 0.0 AS spread_mean, round(stddev_pop(spread), 5) AS spread_std,
    round(arg_max(be, idx), 5) AS beta_last, round(arg_max(al, idx), 5) AS alpha_last FROM kf WHERE idx >= 0 GROUP BY 1""")
def kalman_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.kalman_summary(models.kalman_states(fixtures.rows(spark, sf_dir))), 5)


@query(KALMAN_ROWS)
def stream_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hedge filter on a stream of the same rows, several files a batch, with a restart in between."""
    home = scratch.new_path(spark, "stream")
    rows = scratch.stored(fixtures.rows(spark, sf_dir).select("pair", "idx", "lp_a", "lp_b"), "stream-rows")
    for k in range(2):  # two runs, the second from the state of the first; files are dealt by pair
        rows.where(F.col("idx") >= 1000 if k else F.col("idx") < 1000).repartition("pair").write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
        online.hedge(stream).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{home}/out"), 5)


# ---- rolling statistics ---------------------------------------------------------------------------------------------
TR = BARS + """,
    tr AS (SELECT symbol, ts, row_number() OVER w AS k, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query(f"WITH {TR} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(tr, 6) AS tr FROM tr")
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(day(rolling.true_range(fixtures.smooth(spark, sf_dir))).select("symbol", "day", "tr"))


@query(f"""WITH {TR.replace("b0 AS", "RECURSIVE b0 AS", 1)}, em AS (SELECT symbol, k, tr AS atr FROM tr WHERE k = 1 UNION ALL SELECT tr.symbol, tr.k, tr.tr * (2.0 / 15) + em.atr * (1 - 2.0 / 15) FROM em JOIN tr ON tr.symbol = em.symbol AND tr.k = em.k + 1)
    SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(atr, 6) AS atr FROM em JOIN tr USING (symbol, k)""")
def atr_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(day(models.atr(fixtures.smooth(spark, sf_dir))).select("symbol", "day", "atr"))


OU_STEPS = f"""
    o1 AS (SELECT *, n * (sxx - sxy) - (sx * sx - sx * sy) AS dm FROM os),
    o2 AS (SELECT *, {sql_div('(sy * sxx - sx * sxy)', 'dm')} AS mu FROM o1),
    o3 AS (SELECT *, sxx - 2 * mu * sx + n * mu * mu AS da FROM o2),
    o4 AS (SELECT *, {sql_div('(sxy - mu * sx - mu * sy + n * mu * mu)', 'da')} AS a FROM o3),
    o5 AS (SELECT *, CASE WHEN a > 1e-8 THEN {sql_n('(-ln(CASE WHEN a > 1e-8 THEN a ELSE 1 END))')} ELSE 0.0 END AS theta FROM o4),
    o6 AS (SELECT *, (syy - 2 * a * sxy + a * a * sxx - 2 * mu * (1 - a) * (sy - a * sx) + n * mu * mu * (1 - a) * (1 - a)) / n AS al FROM o5),
    o7 AS (SELECT *, {sql_div('(al * 2 * theta)', '(1 - a * a)')} AS va FROM o6),
    o8 AS (SELECT *, CASE WHEN va >= 0 THEN sqrt(CASE WHEN va >= 0 THEN va ELSE 0 END) ELSE 0.0 END AS sg FROM o7),
    o9 AS (SELECT *, CASE WHEN n < 50 THEN 'too few transitions' WHEN abs(dm) < 1e-10 THEN 'mean is undetermined' WHEN abs(da) < 1e-10 THEN 'degenerate series' WHEN NOT (a > 0 AND a < 1) THEN 'no mean reversion' WHEN theta <= 1e-6 THEN 'negligible mean reversion'
        WHEN al <= 0 THEN 'no variance' WHEN 1 - a * a < 1e-10 THEN 'mean reversion too slow' WHEN va <= 0 THEN 'no diffusion' WHEN sg <= 1e-10 THEN 'diffusion too small' ELSE '' END AS error FROM o8),
    ou AS (SELECT *, CASE WHEN error = '' THEN {sql_n(sql_div('ln(2.0::DOUBLE)', 'theta'), '121.0')} ELSE 0.0 END AS half_life, CASE WHEN error = '' THEN {sql_div('sg', 'sqrt(2 * greatest(theta, 0))')} ELSE 0.0 END AS sigma_eq FROM o9)"""
OU_SUMS = "count(x)::DOUBLE AS n, coalesce(sum(x), 0) AS sx, coalesce(sum(y) FILTER (WHERE x IS NOT NULL), 0) AS sy, coalesce(sum(x * x), 0) AS sxx, coalesce(sum(y * y) FILTER (WHERE x IS NOT NULL), 0) AS syy, coalesce(sum(x * y), 0) AS sxy"
OU_ROLL = HEDGE + f""",
    wn AS (SELECT pair, count(*) AS n FROM sp GROUP BY 1), ws AS (SELECT pair, CASE WHEN n < 500 THEN 0 ELSE unnest(range(0, greatest(1, (n - 500) // 100 + 1))) END AS w FROM wn),
    wr AS (SELECT DISTINCT sp.pair, w + 1 AS window_id, idx, spread FROM sp JOIN wn USING (pair) JOIN ws ON ws.pair = sp.pair AND (n < 500 OR idx BETWEEN w * 100 AND w * 100 + 499)),
    wl AS (SELECT pair, window_id, spread AS y, lag(spread) OVER (PARTITION BY pair, window_id ORDER BY idx) AS x FROM wr),
    os AS (SELECT pair, window_id, {OU_SUMS} FROM wl GROUP BY 1, 2), {OU_STEPS}"""
OU_OUT = "round(CASE WHEN error = '' THEN theta ELSE 0 END, 5) AS theta, round(CASE WHEN error = '' THEN mu ELSE 0 END, 5) + 0.0 AS mu, round(CASE WHEN error = '' THEN sg ELSE 0 END, 5) AS sigma, round(half_life, 4) AS half_life, round(sigma_eq, 5) AS sigma_eq, error = '' AND half_life <= 120 AS is_valid, error"


def _ou_out(df: DataFrame, *keys: str) -> DataFrame:
    return rounded(df.withColumn("half_life", F.round("half_life", 4)), 5).select(*keys, "theta", "mu", "sigma", "half_life", "sigma_eq", "is_valid", "error")


@query(f"WITH {HEDGE}, wl AS (SELECT pair, spread AS y, lag(spread) OVER (PARTITION BY pair ORDER BY idx) AS x FROM sp), os AS (SELECT pair, {OU_SUMS} FROM wl GROUP BY 1), {OU_STEPS} SELECT pair, {OU_OUT} FROM ou")
def ou_fit_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ou_out(rolling.fit_ou(fixtures.spreads(spark, sf_dir), ["pair"]), "pair")


def _rolling_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.fit_ou_windows(fixtures.spreads(spark, sf_dir), 500, 100, whole_if_short=True)


@query(f"WITH {OU_ROLL} SELECT pair, window_id::INT AS window_id, {OU_OUT} FROM ou")
def ou_fit_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ou_out(_rolling_fits(spark, sf_dir), "pair", "window_id")


@query(f"WITH {OU_ROLL} SELECT pair, window_id::INT AS window_id, CASE WHEN NOT (error = '' AND half_life <= 120) THEN 0.0 WHEN half_life < 5 THEN 0.5 WHEN half_life <= 20 THEN 1.0 WHEN half_life <= 60 THEN 0.75 ELSE 0.0 END::DOUBLE AS scale FROM ou")
def half_life_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling_fits(spark, sf_dir).select("pair", "window_id", rolling.half_life_scale(F.col("is_valid"), F.col("half_life")).alias("scale"))


@query(f"""WITH {HEDGE}, w AS (SELECT pair, idx, spread, volume, innov_var, row_number() OVER o AS k, lag(spread) OVER o AS ps, avg(spread) OVER p AS m, stddev_samp(spread) OVER p AS sd, count(*) OVER p AS c, avg(CASE WHEN volume > 0 THEN volume END) OVER p AS mv, avg(CASE WHEN innov_var > 0 THEN innov_var END) OVER p AS mi
    FROM sp WINDOW o AS (PARTITION BY pair ORDER BY idx), p AS (PARTITION BY pair ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT pair, idx, CASE WHEN ok THEN abs((spread - m) / sd) END AS f0, CASE WHEN ok THEN abs(spread - ps) END AS f1, CASE WHEN ok THEN greatest(0, least(10, volume / mv)) END AS f2, CASE WHEN ok THEN greatest(0, least(10, innov_var / mi)) END AS f3 FROM (SELECT *, k > 20 AND c >= 2 AND sd >= 1e-10 AS ok FROM w))
    SELECT pair, idx, round(coalesce(f0, avg(f0) OVER (PARTITION BY pair)), 5) AS f0, round(coalesce(f1, avg(f1) OVER (PARTITION BY pair)), 5) AS f1, round(coalesce(f2, avg(f2) OVER (PARTITION BY pair)), 5) AS f2, round(coalesce(f3, avg(f3) OVER (PARTITION BY pair)), 5) AS f3 FROM f""")
def hmm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.features(fixtures.spreads(spark, sf_dir)).select("pair", "idx", "f0", "f1", "f2", "f3"), 5)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.lagged(fixtures.rows(spark, sf_dir).select("pair", "idx", "lp_a"), ["pair"], "lp_a", {"before": 1}).where("before is not null")
    return found.select("pair", "idx", (F.col("lp_a") - F.col("before")).alias("x"))


STEPS = ROWS + ", d AS (SELECT * FROM (SELECT pair, idx, lp_a - lag(lp_a) OVER (PARTITION BY pair ORDER BY idx) AS x FROM r) WHERE x IS NOT NULL)"


@query(f"""WITH {STEPS}, dn AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY idx) - 1 AS j, count(*) OVER (PARTITION BY pair) AS n FROM d),
    sz AS (SELECT DISTINCT n, size FROM (SELECT n, CASE WHEN k = 19 THEN n // 2 ELSE floor(pow(10, log10(20.0::DOUBLE) + k * (log10((n // 2)::DOUBLE) - log10(20.0::DOUBLE)) / 19) + 1e-9)::BIGINT END AS size FROM (SELECT DISTINCT n FROM dn WHERE n >= 500), range(20) t(k)) WHERE size >= 20),
    ch AS (SELECT pair, size, j // size AS chunk, j, x FROM dn JOIN sz USING (n) WHERE j // size < n // size),
    de AS (SELECT *, x - avg(x) OVER (PARTITION BY pair, size, chunk) AS dv FROM ch), cu AS (SELECT *, sum(dv) OVER (PARTITION BY pair, size, chunk ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM de),
    rs AS (SELECT pair, size, chunk, (max(c) - min(c)) / stddev_samp(x) AS rs FROM cu GROUP BY ALL HAVING stddev_samp(x) >= 1e-10), pt AS (SELECT pair, size, avg(rs) AS rs, count(*) AS k FROM rs WHERE rs > 0 GROUP BY ALL HAVING count(*) >= 2)
    SELECT pair, round(regr_slope(ln(rs), ln(size)), 5) AS exponent, round(regr_r2(ln(rs), ln(size)), 5) AS r_squared, count(*) AS n_windows, '' AS error FROM pt GROUP BY 1""")
def hurst_rs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.hurst(_steps(spark, sf_dir), ["pair"]), 5)


LB = STEPS + ", dm AS (SELECT pair, idx, x - avg(x) OVER (PARTITION BY pair) AS d FROM d), lg AS (SELECT pair, d, " + ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, 21)) + " FROM dm WINDOW w AS (PARTITION BY pair ORDER BY idx)), ac AS (SELECT pair, count(*) AS n, " + ", ".join(f"pow(sum(d * d{k}) / sum(d * d), 2) AS r{k}" for k in range(1, 21)) + " FROM lg GROUP BY 1)"
_q = lambda m: "n * (n + 2) * (" + " + ".join(f"r{k} / (n - {k})" for k in range(1, m + 1)) + ")"


def sql_tail(q: str, k: int) -> str:
    """P(chi-squared with ``k`` degrees > q): a sum for even k; for odd k one less a power series."""
    x = f"({q} / 2)"
    if k % 2 == 0:
        return f"(exp(-{x}) * list_sum(list_transform(range({k // 2}), lambda i: pow({x}, i) / gamma(i + 1.0::DOUBLE))))"
    return f"(CASE WHEN {x} > 100 THEN 0.0 ELSE 1 - list_sum(list_transform(range(400), lambda i: exp((i + {k / 2}) * ln(greatest({x}, 1e-300)) - {x} - lgamma(i + 1 + {k / 2}::DOUBLE)))) END)"


@query(f"WITH {LB}, qs AS (SELECT pair, {_q(5)} AS q5, {_q(10)} AS q10, {_q(20)} AS q20 FROM ac), ps AS (SELECT *, {sql_tail('q5', 5)} AS p5, {sql_tail('q10', 10)} AS p10, {sql_tail('q20', 20)} AS p20 FROM qs) SELECT pair, round(q5, 4) AS q5, round(q10, 4) AS q10, round(q20, 4) AS q20, round(p5, 6) + 0.0 AS p5, round(p10, 6) + 0.0 AS p10, round(p20, 6) + 0.0 AS p20, round(least(p5, p10, p20), 6) + 0.0 AS min_pvalue, least(p5, p10, p20) < 0.05 AS has_autocorr FROM ps")
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rolling.ljung_box(_steps(spark, sf_dir), ["pair"])
    stats = [F.round(F.col("stats")[k], 4).alias(f"q{m}") for k, m in enumerate(rolling.LB_LAGS)]
    return found.select("pair", *stats, *[(F.round(F.col("pvalues")[k], 6) + 0.0).alias(f"p{m}") for k, m in enumerate(rolling.LB_LAGS)], (F.round("min_pvalue", 6) + 0.0).alias("min_pvalue"), "has_autocorr")


@query(f"WITH {HEDGE}, st AS (SELECT pair, lag(spread) OVER w AS x, spread - lag(spread) OVER w AS dy FROM sp WINDOW w AS (PARTITION BY pair ORDER BY idx)) SELECT pair, count(x) AS n, round(regr_slope(dy, x) / sqrt((regr_syy(dy, x) - regr_slope(dy, x) * regr_sxy(dy, x)) / (count(x) - 2) / regr_sxx(dy, x)), 5) AS statistic FROM st WHERE x IS NOT NULL GROUP BY 1")
def adf_lag0_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.unit_root_stat(fixtures.spreads(spark, sf_dir), ["pair"], "spread"), 5)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT (l_discount >= 0.05) AND NOT (l_tax >= 0.05) AND (l_quantity < 22.5 OR l_quantity > 27.5) AS edge_confirmed,
    CASE WHEN l_discount >= 0.05 OR l_tax >= 0.05 THEN 'none' WHEN l_quantity < 22.5 THEN 'mean_reverting' WHEN l_quantity > 27.5 THEN 'trending' ELSE 'none' END AS edge_type FROM lineitem""")
def edge_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = rolling.edge_class(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(True))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", edge.alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e.edge_confirmed", "e.edge_type")


@query("""SELECT l_returnflag AS pair, count(*) AS n_reports, count(*) FILTER (WHERE ok) AS n_confirmed, round(count(*) FILTER (WHERE ok) / count(*), 6) AS confirmed_ratio
    FROM (SELECT l_returnflag, NOT (l_discount >= 0.05) AND NOT (l_tax >= 0.05) AND (l_quantity < 22.5 OR l_quantity > 27.5) AS ok FROM lineitem) GROUP BY 1""")
def edge_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = rolling.edge_class(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(True))
    reports = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pair"), edge.alias("e")).select("pair", "e.*")
    return rounded(rolling.edge_ratio(reports, ["pair"]))


@query(f"WITH {HEDGE}, pm AS (SELECT pair, idx, spread AS theta FROM sp WHERE idx % 100 = 0) SELECT sp.pair, sp.idx, round(theta, 6) + 0.0 AS theta FROM sp ASOF JOIN pm ON sp.pair = pm.pair AND sp.idx >= pm.idx")
def asof_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.spreads(spark, sf_dir)
    return rounded(pairs.as_of(s, s.where("idx % 100 = 0").select("pair", "idx", F.col("spread").alias("theta"))))


# ---- sizing ---------------------------------------------------------------------------------------------------------
def sql_area(depth: str) -> str:
    return f"(list_sum(list_transform(range(201), lambda i: exp(least(500, pow({depth} * (i / 200.0::DOUBLE - 1), 2))) * CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) * ({depth}) / 600)"


def sql_win(theta: str, sigma: str, a: str) -> tuple[str, str]:
    depth = f"(({a}) / (({sigma}) / sqrt(2 * ({theta}))))"
    return sql_clamp(sql_div("near", "far", "0.5"), "0.0", "1.0"), f"{sql_area(depth)} AS near, {sql_area('(2 * ' + depth + ')')} AS far"


CASES = "cs AS (SELECT DISTINCT l_quantity AS qy, l_discount AS dc, l_tax AS tx FROM lineitem)"
_WIN, _AREAS = sql_win("(dc * 5 + 0.01)", "(tx + 0.01)", "qy / 500")


@query(f"WITH {CASES}, ar AS (SELECT *, {_AREAS} FROM cs) SELECT qy, dc, tx, round({_WIN}, 6) AS p FROM ar")
def win_prob_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("qy"), F.col("l_discount").alias("dc"), F.col("l_tax").alias("tx")).distinct()
    return rounded(sizing.with_win_probability(c, F.col("dc") * 5 + 0.01, F.col("tx") + 0.01, F.col("qy") / 500, "p"))


@query(f"WITH {CASES} SELECT qy, dc, tx, round({sql_clamp(sql_div('(qy / 10 * (dc * 5 + 0.3) - (1 - (dc * 5 + 0.3)))', 'qy / 10'), '0.0', '0.25')}, 6) AS f FROM cs")
def kelly_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("qy"), F.col("l_discount").alias("dc"), F.col("l_tax").alias("tx")).distinct()
    return rounded(c.select("qy", "dc", "tx", sizing.kelly(F.col("dc") * 5 + 0.3, F.col("qy") / 10).alias("f")))


_WIN2, _AREAS2 = sql_win("(dc * 5 + 0.01)", "(tx + 0.01)", "(1.5 * qy / 900)")


@query(f"""WITH {CASES}, ar AS (SELECT *, {_AREAS2} FROM cs), pw AS (SELECT *, {_WIN2} AS p FROM ar), kf AS (SELECT *, greatest(0.0, least(0.25, (2.5 / 1.5 * p - (1 - p)) / (2.5 / 1.5))) AS f FROM pw),
    sz AS (SELECT *, least(3000.0, least(0.25, f * 0.5) * 10000) AS pk, least(3000.0, 100 / (1.5 * qy) * 900) AS pa FROM kf)
    SELECT qy, dc, tx, round(CASE WHEN least(pk, pa) < 50 THEN 0 ELSE least(pk, pa) END, 4) AS position_usd, NOT least(pk, pa) < 50 AS is_valid FROM sz""")
def position_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("qy"), F.col("l_discount").alias("dc"), F.col("l_tax").alias("tx")).distinct()
    case = {"capital": F.lit(10_000.0), "atr": F.col("qy"), "price": F.lit(900.0), "theta": F.col("dc") * 5 + 0.01, "sigma": F.col("tx") + 0.01, "ou_valid": F.lit(True), "scale": F.lit(0.5), "no_trade": F.lit(False)}
    return rounded(sizing.sized(c.withColumns(case)).select("qy", "dc", "tx", "position_usd", "is_valid"), 4)


# ---- metrics --------------------------------------------------------------------------------------------------------
TRADES = """tr AS (SELECT l_returnflag AS pair, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, round((l_discount - 0.05) * 1000 - 2, 6) AS pnl, l_linenumber % 3 AS state, l_quantity::BIGINT AS held FROM lineitem),
    tw AS (SELECT *, ((k - 1) // 500 + 1)::INT AS window_id, pnl / 10000 AS r FROM tr)"""
_sharpe = "CASE WHEN count(*) < 2 OR NOT stddev_samp(r) >= 1e-10 THEN 0.0 ELSE avg(r) / stddev_samp(r) * sqrt(greatest(count(*) * 365 / 250.0::DOUBLE, 1)) END"
_sortino = "CASE WHEN count(*) FILTER (WHERE r < 0) < 2 THEN 0.0 ELSE avg(r) / sqrt(avg(r * r) FILTER (WHERE r < 0)) * sqrt(greatest(count(*) * 365 / 250.0::DOUBLE, 1)) END"
_gw, _gl = "coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0)", "coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0)"
_pf = f"CASE WHEN {_gl} > 1e-10 THEN {sql_clamp(sql_div(_gw, _gl), '0.0', '9.99')} WHEN {_gw} > 0 THEN 9.99 ELSE 0.0 END"
WINDOWS = TRADES + f""",
    eq AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY pair, window_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS eq FROM tw), pk AS (SELECT *, max(eq) OVER (PARTITION BY pair, window_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS pk FROM eq),
    wr AS (SELECT pair, window_id, count(*) AS n, sum(pnl) / 10000 AS tret, {_sharpe} AS sharpe, {_sortino} AS sortino, max((pk - eq) / greatest(pk, 1)) AS mdd, count(*) FILTER (WHERE pnl > 0) / count(*) AS wrate FROM pk GROUP BY 1, 2),
    wc AS (SELECT *, CASE WHEN mdd < 1e-10 THEN 0.0 ELSE {sql_div('(tret * (365.0::DOUBLE / 250))', 'mdd')} END AS calmar, n >= 100 AS ok FROM wr)"""


@query(f"WITH {TRADES} SELECT pair, count(*) AS total_trades, count(*) FILTER (WHERE pnl > 0) AS wins, round(count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate, round(sum(pnl) / count(*), 6) AS avg_trade_usd, round(avg(held), 6) AS avg_holding_bars FROM tw GROUP BY 1")
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.trade_metrics(fixtures.trades(spark, sf_dir), ["pair"], F.lit(fixtures.DAYS)).select("pair", "total_trades", "wins", "win_rate", "avg_trade_usd", "avg_holding_bars"))


@query(f"WITH {TRADES} SELECT pair, window_id, round({_sharpe}, 6) AS sharpe, round({_sortino}, 6) AS sortino FROM tw GROUP BY 1, 2")
def sharpe_sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.trade_metrics(fixtures.trades(spark, sf_dir), ["pair", "window_id"], F.lit(fixtures.DAYS)).select("pair", "window_id", "sharpe", "sortino"))


@query(f"WITH {TRADES} SELECT pair, window_id, round({_pf}, 5) AS profit_factor FROM tw GROUP BY 1, 2")
def profit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.trade_metrics(fixtures.trades(spark, sf_dir), ["pair", "window_id"], F.lit(fixtures.DAYS)).select("pair", "window_id", "profit_factor"), 5)


@query(f"WITH {WINDOWS} SELECT pair, window_id, k::INT AS k, round(eq, 4) AS equity, round((pk - eq) / greatest(pk, 1), 6) AS drawdown FROM pk")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("pair", "window_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = fixtures.trades(spark, sf_dir).withColumn("equity", F.lit(10_000.0) + F.sum("net_pnl").over(w))
    return rounded(metrics.drawdowns(t, ["pair", "window_id"], order="k", size=128).select("pair", "window_id", "k", F.round("equity", 4).alias("equity"), "drawdown"))


@query(f"WITH {TRADES} SELECT pair, round(count(*) FILTER (WHERE state = 0) / count(*) * 100, 6) AS pct_high_mr, round(count(*) FILTER (WHERE state = 1) / count(*) * 100, 6) AS pct_low_mr, round(count(*) FILTER (WHERE state = 2) / count(*) * 100, 6) AS pct_breakdown FROM tw GROUP BY 1")
def regime_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regime_share(fixtures.trades(spark, sf_dir), ["pair"]))


@query(f"WITH {ROWS}, wn AS (SELECT pair, count(*) AS n FROM r GROUP BY 1), ws AS (SELECT pair, w, n FROM (SELECT pair, n, unnest(range(0, CASE WHEN n < 900 THEN 0 ELSE (n - 900) // 300 + 1 END)) AS w FROM wn)) SELECT ws.pair, (w + 1)::INT AS window_id, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx FROM ws JOIN r ON r.pair = ws.pair AND idx BETWEEN w * 300 AND w * 300 + 899 GROUP BY 1, 2")
def wf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = pairs.windowed(fixtures.rows(spark, sf_dir), 900, 300)
    return w.groupBy("pair", "window_id").agg(F.count("*").alias("n_rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


VERDICT = WINDOWS + """,
    ag AS (SELECT pair, count(*) AS n_windows, count(*) FILTER (WHERE ok) AS n_valid, median(tret) FILTER (WHERE ok) AS mr, median(sharpe) FILTER (WHERE ok) AS ms, median(sortino) FILTER (WHERE ok) AS mo, median(calmar) FILTER (WHERE ok) AS mc, median(mdd) FILTER (WHERE ok) AS md, median(wrate) FILTER (WHERE ok) AS mw,
        count(*) FILTER (WHERE ok AND tret > 0) / count(*) FILTER (WHERE ok) * 100 AS pp, count(*) FILTER (WHERE ok AND sharpe >= 0.5) / count(*) FILTER (WHERE ok) * 100 AS ph, count(*) FILTER (WHERE ok AND sharpe >= 1) / count(*) FILTER (WHERE ok) * 100 AS po, count(*) FILTER (WHERE ok AND sharpe < -1) AS n_fragile FROM wc GROUP BY 1)"""
_keep = lambda c, name: f"round(CASE WHEN n_valid >= 3 THEN {c} ELSE 0 END, 6) + 0.0 AS {name}"


@query(f"WITH {VERDICT} SELECT pair, n_windows, n_valid, {_keep('mr', 'median_return')}, {_keep('ms', 'median_sharpe')}, {_keep('mo', 'median_sortino')}, {_keep('mc', 'median_calmar')}, {_keep('md', 'median_maxdd')}, {_keep('mw', 'median_winrate')} FROM ag")
def wf_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.verdict(fixtures.window_results(spark, sf_dir)).select("pair", "n_windows", "n_valid", "median_return", "median_sharpe", "median_sortino", "median_calmar", "median_maxdd", "median_winrate"))


@query(f"""WITH {VERDICT} SELECT pair, {_keep('pp', 'pct_profitable')}, {_keep('ph', 'pct_sharpe_gt_half')}, {_keep('po', 'pct_sharpe_gt_one')}, n_fragile,
    CASE WHEN n_valid < 3 THEN 'INSUFFICIENT_DATA' WHEN pp < 60 THEN 'NOT_ROBUST' WHEN ms >= 1 THEN 'STRONG_EDGE' WHEN ms >= 0.5 THEN 'DEPLOYABLE' ELSE 'WEAK_EDGE' END AS verdict, n_valid >= 3 AND pp >= 60 AND ms >= 0.5 AS deployable FROM ag""")
def wf_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.verdict(fixtures.window_results(spark, sf_dir)).select("pair", "pct_profitable", "pct_sharpe_gt_half", "pct_sharpe_gt_one", "n_fragile", "verdict", "deployable"))


@query(f"WITH {WINDOWS} SELECT pair, window_id, round(sharpe, 6) AS sharpe FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(sharpe, 9) DESC, window_id) AS k FROM wc WHERE ok) WHERE k = 1")
def best_window_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_window(fixtures.window_results(spark, sf_dir).withColumn("sharpe", F.round("sharpe", 9))).select("pair", "window_id", "sharpe"))


# ---- models and trades ----------------------------------------------------------------------------------------------
@query("""SELECT pair, round(m, 6) AS median_sharpe FROM (SELECT c_mktsegment AS pair, median(c_acctbal) / 4000 AS m FROM customer GROUP BY 1) WHERE m >= 0.5 ORDER BY m DESC, pair LIMIT 1""")
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deployable one of derived verdicts with the highest median."""
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("pair")).agg((F.median("c_acctbal") / 4000).alias("median_sharpe"))
    return rounded(metrics.best_pair(v.withColumn("deployable", F.col("median_sharpe") >= metrics.SHARPE_DEPLOY)).select("pair", "median_sharpe"))


#: A stop close enough for the win probability to leave room for trades on the derived pairs.
TRADING = backtest.Settings(stop_mult=0.5)


def sql_psi(x: str) -> str:
    """exp(z * z) * erfc(-z) at z = x / sqrt(2), times sqrt(pi / 2): 1 - erf(-z) by its power series, whose terms are all positive."""
    z = f"(({x}) / sqrt(2.0::DOUBLE))"
    return f"(sqrt(pi() / 2) * (exp({z} * {z}) + list_sum(list_transform(range(90), lambda n: pow({z}, 2 * n + 1) / gamma(n + 1.5::DOUBLE)))))"


def sql_threshold(source: str, keys: str, out: str) -> str:
    """CTEs up to ``out`` (keys, threshold): the best entry distance of each fit in ``source`` (theta, sigma, sigma_eq, is_valid)."""
    return f"""{out}_g AS (SELECT *, CASE WHEN sigma_eq > 0 THEN 1.5 * sigma_eq ELSE 0.01 END AS fb, 0.002 + 1e-6 AS lo, greatest(4 * sigma_eq, 0.002 + 1e-6 + 0.001) AS hi FROM {source}),
    {out}_a AS (SELECT *, g, lo + (hi - lo) / 199 * g AS lv FROM {out}_g, range(200) t(g) WHERE is_valid AND sigma_eq >= 1e-10 AND sigma >= 1e-10),
    {out}_v AS (SELECT *, {sql_psi('lv / sigma_eq')} - {sql_psi('0.002 / sigma_eq')} AS gap FROM {out}_a),
    {out}_w AS (SELECT *, CASE WHEN abs(gap) < 1e-10 THEN 0.0 ELSE {sql_div('(2 * (lv - 0.002) * theta)', 'gap')} END AS value FROM {out}_v),
    {out}_b AS (SELECT {keys}, arg_max(lv, (value, -g)) AS lv, max(value) AS value FROM {out}_w GROUP BY ALL),
    {out} AS (SELECT s.*, CASE WHEN b.value > 0 AND b.lv > 0.002 THEN b.lv ELSE fb END AS threshold FROM {out}_g s LEFT JOIN {out}_b b USING ({keys}))"""


@query(f"WITH {OU_ROLL}, fits AS (SELECT pair, window_id, CASE WHEN error = '' THEN theta ELSE 0.0 END AS theta, CASE WHEN error = '' THEN sg ELSE 0.0 END AS sigma, sigma_eq, error = '' AND half_life <= 120 AS is_valid FROM ou), {sql_threshold('fits', 'pair, window_id', 'th')} SELECT pair, window_id::INT AS window_id, round(sigma_eq, 6) + 0.0 AS sigma_eq, round(threshold, 6) AS threshold FROM th")
def bertram_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.entry_thresholds(_rolling_fits(spark, sf_dir)).select("pair", "window_id", "sigma_eq", "threshold"))


#: A fixed model of three regimes, for inference without training: start, transitions, means and deviations of four features.
FIXED = {
    "pi": [0.5, 0.3, 0.2], "trans": [[0.9, 0.07, 0.03], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]],
    "mu": [[0.3, 0.001, 1.0, 1.0], [1.0, 0.003, 1.0, 0.8], [2.5, 0.01, 2.5, 3.0]], "sigma": [[0.8, 0.05, 0.8, 0.8], [1.2, 0.1, 0.9, 0.8], [2.0, 0.2, 1.5, 2.0]],
}
#: The same with a third regime that spreads far from their mean belong to.
APART = FIXED | {"mu": [*FIXED["mu"][:2], [2.4, 0.006, 1.0, 1.0]], "sigma": [*FIXED["sigma"][:2], [0.6, 0.05, 0.8, 0.8]]}


def sql_dens(model: dict) -> str:
    return ", ".join("exp(-0.5 * (" + " + ".join(f"pow((f{j} - {model['mu'][k][j]}) / {model['sigma'][k][j]}, 2) + 2 * ln({model['sigma'][k][j]}) + ln(2 * pi())" for j in range(4)) + f")) AS e{k}" for k in range(3))


_ahead = ", ".join(f"e{k} * (" + " + ".join(f"g{i} * {FIXED['trans'][i][k]}" for i in range(3)) + f") AS a{k}" for k in range(3))


def _fixed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features at six digits, so that both engines start from the same numbers."""
    f = rolling.features(fixtures.spreads(spark, sf_dir)).select("pair", "idx", *[F.round(f"f{k}", 6).alias(f"f{k}") for k in range(4)])
    return f.where(" and ".join(f"f{k} is not null" for k in range(4)))


HMM = ORACLE["hmm_features"].replace("WITH b0 AS", "WITH RECURSIVE b0 AS", 1).replace(", 5) AS f", ", 6) AS f")
HMM = HMM[: HMM.rindex("SELECT pair, idx, round(")] + ", ft AS (" + HMM[HMM.rindex("SELECT pair, idx, round(") :] + f"), dn AS (SELECT pair, idx, {sql_dens(FIXED)} FROM ft), hm AS (SELECT DISTINCT pair, -1::BIGINT AS idx, {', '.join(f'{p}::DOUBLE AS g{k}' for k, p in enumerate(FIXED['pi']))} FROM dn UNION ALL SELECT pair, idx, a0 / (a0 + a1 + a2), a1 / (a0 + a1 + a2), a2 / (a0 + a1 + a2) FROM (SELECT dn.pair, dn.idx, {_ahead} FROM hm JOIN dn ON dn.pair = hm.pair AND dn.idx = hm.idx + 1))"


@query(HMM + " SELECT pair, idx, round(g0, 5) + 0.0 AS g0, round(g1, 5) + 0.0 AS g1, round(g2, 5) + 0.0 AS g2, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS state, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 1.0 WHEN g1 >= g2 THEN 0.5 ELSE 0.0 END::DOUBLE AS kelly_scale, g2 > g0 AND g2 > g1 AS is_no_trade FROM hm WHERE idx >= 0")
def hmm_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered regimes under a fixed model: emission, recursion and the state's scale, without training."""
    f = _fixed_features(spark, sf_dir)
    out = models.regimes(f, _fixed_model(f.select("pair").distinct(), FIXED))
    return rounded(out.select("pair", "idx", *[F.col("gamma")[k].alias(f"g{k}") for k in range(3)], "state", "kelly_scale", "is_no_trade"), 5)


# ---- the backtest in SQL: windows too short for a regime model, and windows with a given one -----------------------
_SZ, _AR = sql_win("theta", "sigma", sql_div("(0.5 * atr)", "price"))
#: Regimes of each bar from the warm-up on under a fixed model; a bar without features keeps what was known before it.
REGIMES = f"""fw AS (SELECT *, avg(spread) OVER p AS m, stddev_samp(spread) OVER p AS sd, lag(spread) OVER o AS ps, avg(CASE WHEN iv > 0 THEN iv END) OVER p AS mi, lag(volume) OVER o AS vol, avg(CASE WHEN volume > 0 THEN volume END) OVER q AS mv
        FROM (SELECT kf.pair, kf.window_id, kf.i, kf.spread, kf.iv, wv.volume FROM kf JOIN wv ON wv.pair = kf.pair AND wv.window_id = kf.window_id AND wv.i = kf.i)
        WINDOW o AS (PARTITION BY pair, window_id ORDER BY i), p AS (PARTITION BY pair, window_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY pair, window_id ORDER BY i ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)),
    fx AS (SELECT pair, window_id, i, sd >= 1e-10 AS known, {sql_n('(abs((spread - m) / sd))')} AS f0, {sql_n('abs(spread - ps)')} AS f1, greatest(0.0, least(10.0, vol / greatest(mv, 1e-10))) AS f2, greatest(0.0, least(10.0, iv / greatest(mi, 1e-10))) AS f3 FROM fw WHERE i >= 300),
    dn AS MATERIALIZED (SELECT pair, window_id, i, known, {sql_dens(APART)} FROM fx),
    rm AS (
        SELECT pair, window_id, 299::BIGINT AS i, {', '.join(f'{p}::DOUBLE AS g{k}' for k, p in enumerate(FIXED['pi']))}, false AS known FROM nz
        UNION ALL
        SELECT pair, window_id, i, {', '.join(f'CASE WHEN known THEN a{k} / (a0 + a1 + a2) ELSE g{k} END' for k in range(3))}, known FROM (SELECT dn.pair, dn.window_id, dn.i, dn.known, g0, g1, g2, {_ahead} FROM rm JOIN dn ON dn.pair = rm.pair AND dn.window_id = rm.window_id AND dn.i = rm.i + 1)
    ),
    rg AS MATERIALIZED (SELECT pair, window_id, i, state, CASE state WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS scale FROM (SELECT pair, window_id, i, CASE WHEN NOT known THEN 1 WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS state FROM rm WHERE i >= 300))"""
#: Without a model, each bar is in state 1 at half size.
NO_REGIMES = "rg AS MATERIALIZED (SELECT pair, window_id, i, 1 AS state, 0.5::DOUBLE AS scale FROM kf WHERE i >= 300)"


def sql_backtest(length: int, step: int, regimes: str) -> str:
    """CTEs of the backtest over windows of ``length`` rows, one every ``step``; ``bt`` has a row for each bar."""
    refits = ", ".join(f"({k}, {max(0, k - 499)}, {k - 1})" for k in range(400, length, 100))
    return ROWS.replace("b0 AS", "RECURSIVE b0 AS", 1) + f""",
    rv AS (SELECT pair, idx, ts, volume, 0.1 * (lp_b - ln(2500.0::DOUBLE)) AS b, 0.1 * (0.1 * (lp_b - ln(2500.0::DOUBLE)) - ln(2500.0::DOUBLE)) + 0.1 * (avg(volume) OVER (PARTITION BY pair ORDER BY idx ROWS 9 PRECEDING) / avg(volume) OVER (PARTITION BY pair ORDER BY idx ROWS 99 PRECEDING) - 1) AS a FROM r),
    ww AS (SELECT pair, unnest(range(0, CASE WHEN n < {length} THEN 0 ELSE (n - {length}) // {step} + 1 END)) AS w FROM (SELECT pair, count(*) AS n FROM rv GROUP BY 1)),
    wv AS MATERIALIZED (SELECT pair, (w + 1)::INT AS window_id, idx - w * {step} AS i, ts, a, b, 1000 * exp(a) AS price, volume FROM rv JOIN ww USING (pair) WHERE idx BETWEEN w * {step} AND w * {step} + {length - 1}),
    nz AS MATERIALIZED (SELECT pair, window_id, r, greatest(r * 0.01, 1e-8) AS q FROM (SELECT pair, window_id, greatest((regr_syy(a, b) - regr_slope(a, b) * regr_sxy(a, b)) / (count(*) - 2), 1e-10) AS r FROM wv WHERE i < 110 GROUP BY 1, 2)),
    kf AS (
        SELECT pair, window_id, -1::BIGINT AS i, 1.0::DOUBLE AS be, 0.0::DOUBLE AS al, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS spread, 0.0::DOUBLE AS iv FROM nz
        UNION ALL
        SELECT pair, window_id, i, be, al, greatest(t00 * (1 - k0 * b) - t01 * k0 + k0 * k0 * r, 1e-10), ((-t00 * k1 * b + t01 * (1 - k1) + k0 * k1 * r) + (t10 * (1 - k0 * b) - t11 * k0 + k0 * k1 * r)) / 2, greatest(-t10 * k1 * b + t11 * (1 - k1) + k1 * k1 * r, 1e-10), a - be * b - al, s
        FROM (SELECT *, (1 - k0 * b) * q00 - k0 * p01 AS t00, (1 - k0 * b) * p01 - k0 * q11 AS t01, -k1 * b * q00 + (1 - k1) * p01 AS t10, -k1 * b * p01 + (1 - k1) * q11 AS t11, be0 + k0 * e AS be, al0 + k1 * e AS al
        FROM (SELECT *, (b * q00 + p01) / s AS k0, (b * p01 + q11) / s AS k1
        FROM (SELECT *, greatest((b * q00 + p01) * b + b * p01 + q11 + r, 1e-8) AS s
        FROM (SELECT wv.pair, wv.window_id, wv.i, wv.a, wv.b, nz.r, be AS be0, al AS al0, p00 + nz.q AS q00, p01, p11 + nz.q AS q11, wv.a - (wv.b * be + al) AS e
            FROM kf JOIN nz ON nz.pair = kf.pair AND nz.window_id = kf.window_id JOIN wv ON wv.pair = kf.pair AND wv.window_id = kf.window_id AND wv.i = kf.i + 1))))
    ),
    tr AS MATERIALIZED (SELECT pair, window_id, i, greatest(price * 1.0005 - price * 0.9995, abs(price * 1.0005 - lag(price) OVER o), abs(price * 0.9995 - lag(price) OVER o)) AS tr FROM wv WINDOW o AS (PARTITION BY pair, window_id ORDER BY i)),
    em AS (SELECT pair, window_id, i, tr AS atr FROM tr WHERE i = 0 UNION ALL SELECT tr.pair, tr.window_id, tr.i, tr.tr * (2.0 / 15) + em.atr * (1 - 2.0 / 15) FROM em JOIN tr ON tr.pair = em.pair AND tr.window_id = em.window_id AND tr.i = em.i + 1),
    fl AS (SELECT pair, window_id, k, spread AS y, lag(spread) OVER (PARTITION BY pair, window_id, k ORDER BY i) AS x FROM kf JOIN (VALUES (300, 0, 298), {refits}) t(k, lo, hi) ON i BETWEEN lo AND hi),
    os AS (SELECT pair, window_id, k, {OU_SUMS} FROM fl GROUP BY 1, 2, 3), {OU_STEPS},
    fits AS (SELECT pair, window_id, k, CASE WHEN error = '' THEN theta ELSE 0.0 END AS theta, CASE WHEN error = '' THEN mu ELSE 0.0 END AS mu, CASE WHEN error = '' THEN sg ELSE 0.0 END AS sigma, half_life, sigma_eq, error = '' AND half_life <= 120 AS is_valid FROM ou),
    {sql_threshold("fits", "pair, window_id, k", "th")},
    {regimes},
    fa AS (SELECT * FROM th WHERE k = 300 OR is_valid),
    s1 AS (SELECT kf.pair, kf.window_id, kf.i, kf.spread AS x, em.atr, wv.price, wv.ts, rg.state, rg.scale FROM kf JOIN em USING (pair, window_id, i) JOIN wv USING (pair, window_id, i) JOIN rg USING (pair, window_id, i) WHERE kf.i >= 300),
    s2 AS (SELECT s1.*, theta, mu, sigma, half_life, sigma_eq, threshold / greatest(sigma_eq, 1e-10) AS enter, is_valid AND sigma_eq >= 1e-10 AS ok FROM s1 ASOF JOIN fa ON s1.pair = fa.pair AND s1.window_id = fa.window_id AND s1.i >= fa.k),
    s3 AS (SELECT *, {_AR}, {sql_div("(x - mu)", "sigma_eq")} AS z, {sql_div("(2.5 * atr)", "(0.5 * atr)")} AS reward FROM s2),
    s4 AS (SELECT *, CASE WHEN theta <= 1e-10 OR sigma <= 1e-10 OR abs(far) < 1e-10 THEN 0.5 ELSE {_SZ} END AS p FROM s3),
    st AS MATERIALIZED (SELECT pair, window_id, i, x, z, ok, price, atr, half_life, state, scale, greatest(0.0, least(0.25, {sql_div("(reward * p - (1 - p))", "reward")})) AS f, state <> 2 AND ok AND half_life >= 2 AND half_life <= 60 AND abs(z) > enter AND atr > 0 AND price > 0 AND 0.5 * atr >= 1e-10 AND reward >= 0.1 AS may FROM s4),
    bt AS (
        SELECT pair, window_id, 299::BIGINT AS i, 10000.0::DOUBLE AS cap, 10000.0::DOUBLE AS peak, 0.0::DOUBLE AS worst, false AS held, 0::BIGINT AS e_i, 0 AS d, 0.0::DOUBLE AS e_x, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS e_p, 0.0::DOUBLE AS size, 0 AS bars, 0.0::DOUBLE AS hl,
            '' AS why, 0::BIGINT AS t_i, 0 AS t_d, 0.0::DOUBLE AS t_x, 0.0::DOUBLE AS x, 0.0::DOUBLE AS t_p, 0.0::DOUBLE AS t_s, 0.0::DOUBLE AS raw, 0.0::DOUBLE AS net, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS t_hl, 0 AS e_s, 0 AS t_st, 0 AS state FROM nz
        UNION ALL
        SELECT pair, window_id, i, cap1, CASE WHEN ok THEN greatest(peak, cap1) ELSE peak END, CASE WHEN ok THEN greatest(worst, (greatest(peak, cap1) - cap1) / greatest(greatest(peak, cap1), 1)) ELSE worst END,
            held1 OR buy, CASE WHEN buy THEN i ELSE e_i END, CASE WHEN buy THEN dn ELSE d END, CASE WHEN buy THEN x ELSE e_x END, CASE WHEN buy THEN x - dn * 0.5 * seq ELSE stop END, CASE WHEN buy THEN price ELSE e_p END, CASE WHEN buy THEN usd ELSE size END, CASE WHEN buy THEN 0 ELSE bars1 END, CASE WHEN buy THEN half_life ELSE hl END,
            why, e_i, d, e_x, x, e_p, size, raw, net, net / greatest(cap, 1), hl, CASE WHEN buy THEN state ELSE e_s END, e_s, state
        FROM (SELECT *, NOT held1 AND may AND cap1 >= 1 AND usd >= 0.005 * cap1 AND usd > 0 AS buy, CASE WHEN z < 0 THEN 1 ELSE -1 END AS dn
        FROM (SELECT *, held AND why = '' AS held1, least(least(0.3 * cap1, least(0.25, f * scale) * cap1), least(0.3 * cap1, greatest(0.0, {sql_div("(cap1 * 0.01)", "(0.5 * atr)")} * price))) AS usd
        FROM (SELECT *, CASE WHEN why = '' THEN cap WHEN cap + net < 1 THEN 1.0 WHEN cap + net > 10 * cap THEN cap ELSE cap + net END AS cap1
        FROM (SELECT *, greatest(-0.5 * size, least(0.5 * size, raw)) - 0.002 * size AS net
        FROM (SELECT *, d * (x - e_x) / greatest(e_p, 1e-8) * size AS raw, CASE WHEN NOT (ok AND held) THEN '' WHEN d * z >= 0 THEN 'target' WHEN abs(z) > 3.5 THEN 'emergency' WHEN d * (x - stop) < 0 THEN 'stop' WHEN bars1 >= 60 THEN 'time' ELSE '' END AS why
        FROM (SELECT bt.pair, bt.window_id, st.i, st.x, st.z, st.ok, st.price, st.atr, st.half_life, st.f, st.may, st.state, st.scale, s2.sigma_eq AS seq, cap, peak, worst, held, e_i, d, e_x, stop, e_p, size, CASE WHEN st.ok AND held THEN bars + 1 ELSE bars END AS bars1, hl, e_s
            FROM bt JOIN st ON st.pair = bt.pair AND st.window_id = bt.window_id AND st.i = bt.i + 1 JOIN se s2 ON s2.pair = st.pair AND s2.window_id = st.window_id AND s2.i = st.i))))))
    )""".replace("    bt AS (\n", "    se AS MATERIALIZED (SELECT pair, window_id, i, sigma_eq FROM s2),\n    bt AS (\n", 1)


def sql_results(length: int, source: str) -> str:
    """``source`` with ``res``: the numbers of each window from its trades and bars."""
    return source + f"""
    , lw AS (SELECT pair, window_id, min(ts) AS t0, max(ts) AS t1, greatest(date_diff('day', min(ts), max(ts)), 1) AS days FROM wv GROUP BY 1, 2),
    tc AS (SELECT bt.*, days, t_s, net AS pnl, ret AS r, i - t_i AS held_bars FROM bt JOIN lw USING (pair, window_id) WHERE why <> ''),
    ta AS (SELECT pair, window_id, count(*) AS n, count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate, {_pf} AS profit_factor, sum(pnl) / count(*) AS avg_trade_usd, avg(held_bars) AS avg_holding_bars, {sql_n('(count(*) * (365.0::DOUBLE / greatest(any_value(days), 1)))')} AS trades_per_year,
        CASE WHEN count(*) < 2 OR NOT stddev_samp(r) >= 1e-10 THEN 0.0 ELSE {sql_n(f'(avg(r) / stddev_samp(r) * sqrt({_py}))')} END AS sharpe, CASE WHEN count(*) FILTER (WHERE r < 0) < 2 THEN 0.0 ELSE {sql_n(f'(avg(r) / sqrt(avg(r * r) FILTER (WHERE r < 0)) * sqrt({_py}))')} END AS sortino FROM tc GROUP BY 1, 2),
    sn AS (SELECT pair, window_id, {', '.join(f'count(*) FILTER (WHERE i >= 300 AND state = {k}) AS n{k}' for k in range(3))} FROM bt GROUP BY 1, 2),
    fe AS (SELECT pair, window_id, cap, worst, (cap - 10000) / 10000 AS tret FROM bt WHERE i = {length - 1}),
    fr AS (SELECT *, CASE WHEN 1 + tret <= 0 THEN -1.0 ELSE {sql_n('(exp(ln(greatest(1 + tret, 1e-8)) * 365.0 / days) - 1)')} END AS yearly FROM fe JOIN lw USING (pair, window_id) JOIN sn USING (pair, window_id) LEFT JOIN ta USING (pair, window_id)),
    res AS (SELECT *, CASE WHEN worst < 1e-10 THEN 0.0 ELSE {sql_div('yearly', 'worst')} END AS calmar FROM fr)"""


_py = "greatest(count(*) * 365.0::DOUBLE / greatest(any_value(days), 1), 1)"
BACKTEST, GIVEN = sql_backtest(700, 400, NO_REGIMES), sql_backtest(900, 300, REGIMES)
SHORT, GIVEN_RESULTS = sql_results(700, BACKTEST), sql_results(900, GIVEN)
TRADES_OUT = """SELECT pair, window_id, t_i::INT AS bar_entry, i::INT AS bar_exit, t_d AS direction, round(t_x, 5) + 0.0 AS entry_spread, round(x, 5) + 0.0 AS exit_spread, round(t_p, 5) AS entry_price_a, round(t_s, 4) AS position_usd, round(raw, 4) + 0.0 AS raw_pnl, round(net, 4) + 0.0 AS net_pnl,
    round(ret, 7) + 0.0 AS trade_return, why AS exit_reason, t_st AS regime_state, round(t_hl, 4) AS half_life, round(cap, 4) AS capital_after FROM bt WHERE why <> ''"""
RESULTS_OUT = """SELECT pair, window_id, strftime(t0, '%Y-%m-%d') AS start_date, strftime(t1, '%Y-%m-%d') AS end_date, {n} AS n_bars, days::INT AS observation_days, round(cap, 4) AS final_capital, round(tret, 6) + 0.0 AS total_return, round(yearly, 6) + 0.0 AS annualised_return, round(calmar, 4) + 0.0 AS calmar, round(worst, 6) AS max_drawdown,
    coalesce(n, 0) AS total_trades, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(profit_factor, 0), 5) AS profit_factor, round(coalesce(avg_trade_usd, 0), 4) + 0.0 AS avg_trade_usd, round(coalesce(avg_holding_bars, 0), 4) AS avg_holding_bars, round(coalesce(trades_per_year, 0), 4) AS trades_per_year,
    round(coalesce(sharpe, 0), 5) + 0.0 AS sharpe, round(coalesce(sortino, 0), 5) + 0.0 AS sortino, round(n0 / greatest(n0 + n1 + n2, 1) * 100, 6)::DOUBLE AS pct_high_mr, round(n1 / greatest(n0 + n1 + n2, 1) * 100, 6)::DOUBLE AS pct_low_mr, round(n2 / greatest(n0 + n1 + n2, 1) * 100, 6)::DOUBLE AS pct_breakdown, true AS ok FROM res"""
VERDICT_OUT = f""", vg AS (SELECT pair, count(*) AS n_windows, count(*) AS n_valid, median(tret) AS mr, median(coalesce(sharpe, 0)) AS ms, median(worst) AS md, count(*) FILTER (WHERE tret > 0) / count(*) * 100 AS pp FROM res GROUP BY 1)
    SELECT pair, n_windows, n_valid, {_keep('mr', 'median_return')}, {_keep('ms', 'median_sharpe')}, {_keep('md', 'median_maxdd')}, {_keep('pp', 'pct_profitable')},
        CASE WHEN n_valid < 3 THEN 'INSUFFICIENT_DATA' WHEN pp < 60 THEN 'NOT_ROBUST' WHEN ms >= 1 THEN 'STRONG_EDGE' WHEN ms >= 0.5 THEN 'DEPLOYABLE' ELSE 'WEAK_EDGE' END AS verdict FROM vg"""


def _trades_out(runs: DataFrame) -> DataFrame:
    at = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return backtest.trades(runs).select(
        "pair", "window_id", "bar_entry", "bar_exit", "direction", at("entry_spread", 5), at("exit_spread", 5), at("entry_price_a", 5), at("position_usd", 4), at("raw_pnl", 4), at("net_pnl", 4), at("trade_return", 7),
        "exit_reason", "regime_state", at("half_life", 4), at("capital_after", 4),
    )


def _results_out(made: DataFrame) -> DataFrame:
    digits = {"final_capital": 4, "calmar": 4, "avg_trade_usd": 4, "avg_holding_bars": 4, "trades_per_year": 4, "profit_factor": 5, "sharpe": 5, "sortino": 5}
    return rounded(made.drop("initial_capital", "error").withColumns({c: F.round(c, k) for c, k in digits.items()}))


def _verdict_out(verdicts: DataFrame) -> DataFrame:
    return rounded(verdicts.select("pair", "n_windows", "n_valid", "median_return", "median_sharpe", "median_maxdd", "pct_profitable", "verdict"))


def _short(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results and runs of windows of 700 rows, one every 400: too short for a regime model, so SQL can follow them."""
    return backtest.run(pairs.windowed(fixtures.reverting(spark, sf_dir), 700, 400), TRADING)


def _fixed_model(keys: DataFrame, model: dict) -> DataFrame:
    """The model for each row of ``keys``."""
    flat = {k: [float(x) for r in v for x in r] if isinstance(v[0], list) else v for k, v in model.items()}
    return keys.select("*", *[F.array(*[F.lit(x) for x in v]).alias(k) for k, v in flat.items()], F.lit(True).alias("is_valid"))


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts, results and runs of walk-forward windows under a given regime model, in force from the warm-up on."""
    rows = fixtures.reverting(spark, sf_dir)
    return backtest.walk_forward(rows, 600, 300, 300, TRADING, _fixed_model(rows.select("pair").distinct(), APART))


@query(f"WITH {BACKTEST} {TRADES_OUT}")
def backtest_trades_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades_out(_short(spark, sf_dir)[1])


@query(f"WITH {BACKTEST} SELECT pair, window_id, i::INT AS idx, round(cap, 4) AS equity FROM bt")
def backtest_equity_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity from the last bar of the warm-up on."""
    return rounded(backtest.equity(_short(spark, sf_dir)[1]).where("idx >= 299"), 4)


@query(f"WITH {SHORT} {RESULTS_OUT.replace('{n}', '700')}")
def backtest_results_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results_out(_short(spark, sf_dir)[0])


@query(f"WITH {SHORT}{VERDICT_OUT}")
def walk_forward_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict_out(metrics.verdict(_short(spark, sf_dir)[0]))


@query(f"WITH {GIVEN} {TRADES_OUT}")
def backtest_trades_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades_out(_given(spark, sf_dir)[2])


@query(f"WITH {GIVEN} SELECT pair, window_id, i::INT AS idx, round(cap, 4) AS equity FROM bt")
def backtest_equity_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity from the last bar of the warm-up on."""
    return rounded(backtest.equity(_given(spark, sf_dir)[2]).where("idx >= 299"), 4)


@query(f"WITH {GIVEN_RESULTS} {RESULTS_OUT.replace('{n}', '900')}")
def backtest_results_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results_out(_given(spark, sf_dir)[1])


@query(f"WITH {GIVEN_RESULTS}{VERDICT_OUT}")
def walk_forward_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict_out(_given(spark, sf_dir)[0])


@query(f"""WITH {GIVEN_RESULTS}, bw AS (SELECT pair, window_id FROM (SELECT pair, window_id, row_number() OVER (PARTITION BY pair ORDER BY coalesce(sharpe, 0) DESC, window_id) AS k FROM res) WHERE k = 1)
    SELECT pair, t_i::INT AS bar_entry, i::INT AS bar_exit, CASE WHEN t_d = 1 THEN 'long' ELSE 'short' END AS direction, round(t_x, 5) + 0.0 AS entry_spread, round(x, 5) + 0.0 AS exit_spread, round(t_s, 2) AS position_usd, round(raw, 2) + 0.0 AS raw_pnl, round(net, 2) + 0.0 AS net_pnl,
        round(ret * 100, 4) + 0.0 AS trade_return, why AS exit_reason, t_st AS regime_state, round(t_hl, 2) AS half_life_bars, round(cap, 2) AS capital_after FROM bt JOIN bw USING (pair, window_id) WHERE why <> ''""")
def trade_log_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, made, runs = _given(spark, sf_dir)
    return rounded(sinks.trade_log(backtest.trades(runs), made), 5)


def sql_cdf(z: str) -> str:
    """The normal distribution function at a column, by the series of the error function."""
    u = f"(least(abs({z}), 8) / sqrt(2.0::DOUBLE))"
    return f"(0.5 + 0.5 * sign({z}) * exp(-{u} * {u}) * list_sum(list_transform(range(90), lambda i: pow({u}, 2 * i + 1) / gamma(i + 1.5::DOUBLE))))"


def sql_projected(name: str, source: str, last: str) -> str:
    """A recursive CTE over vectors (pair, t, j, v): step by step, column k = 0, 1, .. is projected out of those after it."""
    return f"""{name} AS (SELECT pair, 0 AS k, t, j, v FROM {source} UNION ALL
        SELECT pair, k + 1, t, j, v - c * vk FROM (SELECT *, sum(v * vk) OVER (PARTITION BY pair, j) / sum(vk * vk) OVER (PARTITION BY pair, j) AS c
        FROM (SELECT {name}.*, max(v) FILTER (WHERE j = k) OVER (PARTITION BY pair, t) AS vk FROM {name} JOIN {last} USING (pair) WHERE k <= {last}.most)) WHERE j > k)"""


ADF = HEDGE.replace("b0 AS", "RECURSIVE b0 AS", 1) + f""",
    xs AS MATERIALIZED (SELECT pair, row_number() OVER w - 1 AS i, spread AS x, lead(spread) OVER w - spread AS d FROM sp WINDOW w AS (PARTITION BY pair ORDER BY idx)),
    mx AS MATERIALIZED (SELECT pair, n, least(n // 2 - 2, ceil(12 * pow(n / 100.0::DOUBLE, 0.25)))::INT + 1 AS most FROM (SELECT pair, count(*) AS n FROM xs GROUP BY 1)),
    lg AS MATERIALIZED (SELECT a.pair, a.i AS t, k, b.d FROM xs a JOIN mx USING (pair), range(1, 60) r(k) JOIN xs b ON b.pair = a.pair AND b.i = a.i - k WHERE k < most AND a.d IS NOT NULL),
    v1 AS MATERIALIZED (SELECT pair, i AS t, 0 AS j, x AS v FROM xs JOIN mx USING (pair) WHERE i >= most - 1 AND d IS NOT NULL UNION ALL SELECT pair, i, 1, 1.0 FROM xs JOIN mx USING (pair) WHERE i >= most - 1 AND d IS NOT NULL
        UNION ALL SELECT pair, t, k + 1, d FROM lg JOIN mx USING (pair) WHERE t >= most - 1 UNION ALL SELECT pair, i, 99, d FROM xs JOIN mx USING (pair) WHERE i >= most - 1 AND d IS NOT NULL),
    {sql_projected("g1", "v1", "mx")},
    ai AS (SELECT pair, k - 2 AS lags, count(*) * ln(sum(v * v) / count(*)) + 2 * k AS aic FROM g1 WHERE j = 99 AND k >= 2 GROUP BY pair, k),
    pk AS MATERIALIZED (SELECT pair, arg_min(lags, (aic, lags)) AS most FROM ai GROUP BY 1),
    v2 AS MATERIALIZED (SELECT pair, i AS t, 0 AS j, 1.0::DOUBLE AS v FROM xs JOIN pk USING (pair) WHERE i >= most AND d IS NOT NULL UNION ALL SELECT pair, t, k, d FROM lg JOIN pk USING (pair) WHERE t >= most AND k <= most
        UNION ALL SELECT pair, i, 90, x FROM xs JOIN pk USING (pair) WHERE i >= most AND d IS NOT NULL UNION ALL SELECT pair, i, 99, d FROM xs JOIN pk USING (pair) WHERE i >= most AND d IS NOT NULL),
    {sql_projected("g2", "v2", "pk")},
    xy AS (SELECT pair, most AS lags, count(*) AS n, sum(a.v * b.v) AS sxy, sum(a.v * a.v) AS sxx, sum(b.v * b.v) AS syy FROM pk JOIN g2 a USING (pair) JOIN g2 b USING (pair) WHERE a.k = most + 1 AND b.k = most + 1 AND a.j = 90 AND b.j = 99 AND a.t = b.t GROUP BY 1, 2),
    ad AS (SELECT pair, lags, n, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - lags - 2) / sxx) AS tau FROM xy),
    ap AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS z FROM ad),
    af AS (SELECT *, CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE {sql_cdf('z')} END AS p FROM ap)"""


@query(f"WITH {ADF} SELECT pair, round(tau, 5) AS statistic, round(p, 5) + 0.0 AS pvalue, lags::INT AS n_lags, n::INT AS n_obs, '' AS error, p < 0.05 AS is_stationary FROM af")
def adf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.unit_root(fixtures.spreads(spark, sf_dir), ["pair"], "spread"), 5)


_hurst = ORACLE["hurst_rs"][len(f"WITH {STEPS}") :]
GATE = ADF + ", dl AS (SELECT pair, idx, spread AS x FROM sp), dh AS (SELECT pair, i AS idx, d AS x FROM xs WHERE d IS NOT NULL)" + LB[len(STEPS) :].replace("FROM d)", "FROM dl)").replace("lg AS", "ll AS").replace("FROM lg", "FROM ll")
GATE += _hurst[: _hurst.index("SELECT pair, round(regr_slope")].replace("FROM d)", "FROM dh)") + f""", hu AS (SELECT pair, regr_slope(ln(rs), ln(size)) AS h, count(*) AS n_windows FROM pt GROUP BY 1),
    qs AS (SELECT pair, {_q(5)} AS q5, {_q(10)} AS q10, {_q(20)} AS q20 FROM ac), lb AS (SELECT pair, least({sql_tail('q5', 5)}, {sql_tail('q10', 10)}, {sql_tail('q20', 20)}) AS q FROM qs),
    gt AS (SELECT pair, tau, p, q, CASE WHEN n_windows >= 4 THEN h ELSE 0.5 END AS h, coalesce(n_windows, 0) AS n_windows, CASE WHEN NOT p < 0.05 THEN 'unit root not rejected' WHEN NOT q < 0.05 THEN 'no autocorrelation' WHEN NOT coalesce(n_windows >= 4, false) THEN 'no exponent' WHEN h < 0.45 OR h > 0.55 THEN 'all three tests pass' ELSE 'random walk zone' END AS reason FROM af JOIN lb USING (pair) LEFT JOIN hu USING (pair))"""
GATE_OUT = "round(tau, 5) AS statistic, round(p, 5) + 0.0 AS pvalue, round(q, 6) + 0.0 AS min_pvalue, round(h, 5) AS exponent, n_windows, reason = 'all three tests pass' AS edge_confirmed, CASE WHEN reason <> 'all three tests pass' THEN 'none' WHEN h < 0.45 THEN 'mean_reverting' ELSE 'trending' END AS edge_type, reason"


def _gate_out(made: DataFrame, *keys: str) -> DataFrame:
    at = lambda c, k=5: (F.round(c, k) + 0.0).alias(c.rpartition(".")[2])
    return made.select(*keys, at("adf.statistic"), at("adf.pvalue"), at("ljung_box.min_pvalue", 6), at("hurst.exponent"), "hurst.n_windows", "edge_confirmed", "edge_type", "reason")


@query(f"WITH {GATE} SELECT pair, {GATE_OUT} FROM gt")
def stationarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tests of each whole series and the edge they confirm."""
    return _gate_out(models.gate(fixtures.spreads(spark, sf_dir), ["pair"], "spread"), "pair")


# The same tests, with each window of five hundred rows as a series of its own.
_head = HEDGE.replace("b0 AS", "RECURSIVE b0 AS", 1)
GATE_ROLL = _head.replace(" sp AS (", " s0 AS (") + """,
    wn AS (SELECT pair, count(*) AS n FROM s0 GROUP BY 1), ws AS (SELECT pair, unnest(range(0, (n - 500) // 100 + 1)) AS w FROM wn WHERE n >= 500),
    sp AS (SELECT s0.pair || '#' || (w + 1) AS pair, idx, spread FROM s0 JOIN ws ON ws.pair = s0.pair AND idx BETWEEN w * 100 AND w * 100 + 499)""" + GATE[len(_head) :]


@query(f"WITH {GATE_ROLL} SELECT split_part(pair, '#', 1) AS pair, split_part(pair, '#', 2)::INT AS window_id, {GATE_OUT} FROM gt")
def stationarity_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tests of each window of five hundred rows, one every hundred."""
    made = models.stationarity(pairs.windowed(fixtures.spreads(spark, sf_dir), 500, 100), ["pair", "window_id"], "spread")
    return _gate_out(made, "pair", "window_id")


@query()
def hmm_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.train_regimes(rolling.features(fixtures.spreads(spark, sf_dir)))


@query()
def hmm_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rolling.features(fixtures.spreads(spark, sf_dir))
    return models.regimes(f, models.train_regimes(f))


@query()
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.trades(backtest.backtest(fixtures.reverting(spark, sf_dir), TRADING)[1])


@query()
def backtest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.backtest(fixtures.reverting(spark, sf_dir), TRADING)[0]


@query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.walk_forward(fixtures.reverting(spark, sf_dir), 600, 300, 300, TRADING)[0]


@query()
def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.walk_forward(fixtures.reverting(spark, sf_dir), 600, 300, 300, TRADING)[1]


@query()
def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, made, runs = backtest.walk_forward(fixtures.reverting(spark, sf_dir), 600, 300, 300, TRADING)
    return sinks.trade_log(backtest.trades(runs), made)
