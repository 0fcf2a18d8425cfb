"""Queries of the store, vendor payloads, panels, winners, drifting books and trend signals."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlab.operators import broker, calendar, catalog, intervals, joins, metrics, normalize, panel, store, strategies, trend
from marketlab.plans.queries import _BOOK, _COVER, _HOL, _LOCAL, _MERGED, _book, _cover, DAY, HOUR, KEYS, W, book_sql, lag, over, query, r6
from marketlab.sources import vendors
from marketlab.sources.series import PX_DAILY_SQL, PX_SMOOTH_SQL, bars, px_daily, px_smooth

OHLCV = ("open", "high", "low", "close", "volume")
_IST = "(ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata'"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in OHLCV)

# --- store --------------------------------------------------------------------------------------------------------

query("coverage_scan", f"WITH {_COVER} SELECT * FROM cov WHERE instrument_id = 'click'")(lambda s, d: _cover(s, d).where("instrument_id = 'click'").orderBy("start_utc"))
query("coverage_inventory", f"WITH {_COVER} SELECT * FROM cov")(lambda s, d: _cover(s, d).orderBy("instrument_id", "start_utc"))
query("interval_merge", f"WITH {_MERGED} SELECT * FROM merged")(lambda s, d: intervals.merge(_cover(s, d), "instrument_id"))
query("snapshot_latest_poll", "SELECT event_type AS instrument_id, user_id % 3 AS source, max(ts) AS polled_at FROM events GROUP BY 1, 2")(
    lambda s, d: store.latest_poll(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("instrument_id"), (F.col("user_id") % 3).alias("source"), F.col("ts").alias("polled_at")))
)


@query(
    "prune_hot_candidates",
    """SELECT event_type AS instrument_id, user_id % 3 AS source, strftime(ts, '%Y%m') AS ym, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-21' AND event_type <> 'view' AND user_id % 3 < 2 GROUP BY ALL""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("instrument_id"), (F.col("user_id") % 3).alias("source"), F.lit("1m").alias("timeframe"), F.col("ts").cast("timestamp").alias("ts_utc"))
    coverage = rows.where("instrument_id <> 'view' AND source < 2").select("instrument_id", "source", F.lit("1d").alias("timeframe")).distinct()
    return store.prune_candidates(rows, coverage, datetime(2024, 1, 21))


query("instrument_lookup", "SELECT c_custkey AS instrument_id, c_name AS symbol FROM customer")(
    lambda s, d: joins.keep_latest(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("instrument_id"), F.col("c_name").alias("symbol")), ["instrument_id"], "symbol")
)
query("alias_lookup", "SELECT '  ' || upper(c_name) || ' ' AS alias, c_custkey AS instrument_id FROM customer")(
    lambda s, d: store.by_alias(
        s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("instrument_id"), F.array("c_name").alias("aliases")),
        s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("alias")),
    )
)
query("bars_json", f"WITH b AS ({DAY}) SELECT {KEYS}, strftime(ts_utc, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM b")(
    lambda s, d: bars(s, d, "day").select("instrument_id", "ts_utc", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"))
)
query("limit_truncated", f"WITH b AS ({HOUR}), t AS (SELECT *, row_number() OVER (ORDER BY ts_utc, instrument_id) AS n FROM b) SELECT {KEYS}, (SELECT count(*) FROM b) > 100 AS truncated FROM t WHERE n <= 100")(lambda s, d: _limited(bars(s, d), 100))
query("union_frames", f"WITH a AS ({DAY}), b AS ({HOUR}) SELECT {KEYS}, round(close, 6) AS close, round(high, 6) AS high FROM a UNION ALL SELECT {KEYS}, round(close, 6), NULL FROM b")(
    lambda s, d: bars(s, d, "day").select("instrument_id", "ts_utc", "close", "high").unionByName(bars(s, d).select("instrument_id", "ts_utc", "close"), allowMissingColumns=True)
)


def _limited(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows, and whether there are more: n + 1 rows are read, not all counted."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts_utc", "instrument_id")
    some = rows.select("instrument_id", "ts_utc").orderBy("ts_utc", "instrument_id").limit(n + 1)
    some = some.withColumn("__n", F.row_number().over(w)).withColumn("truncated", F.max("__n").over(Window.partitionBy(F.lit(0))) > n)
    return some.where(F.col("__n") <= n).drop("__n")


# --- payloads: written from bars, so that what is parsed must equal the bars ----------------------------------------

_BARS_BACK = f"WITH b AS ({HOUR}) SELECT instrument_id AS vendor_symbol, ts_utc AS ts, {_ROUNDED} FROM b"


def _payloads(b: DataFrame, entry, around=lambda x: x) -> DataFrame:
    """One payload for each instrument and day of bars."""
    listed = F.array_sort(F.collect_list(entry))
    return b.groupBy(F.col("instrument_id").alias("vendor_symbol"), F.to_date("ts_utc").alias("day")).agg(F.to_json(around(listed)).alias("payload"))


def _cells(unit: int):
    return F.array((F.unix_micros("ts_utc") / unit).cast("double"), *OHLCV)


query("src_klines_json", _BARS_BACK)(lambda s, d: vendors.kline_bars(_payloads(bars(s, d), _cells(1_000))))
query("src_gecko_json", _BARS_BACK)(
    lambda s, d: vendors.gecko_bars(_payloads(bars(s, d), _cells(1_000_000), lambda x: F.struct(F.struct(F.struct(F.concat(x, x).alias("ohlcv_list")).alias("attributes")).alias("data"))))
)
query("src_yahoo_json", _BARS_BACK)(
    lambda s, d: vendors.yahoo_bars(_payloads(bars(s, d), F.struct((F.unix_micros("ts_utc") / 1_000).cast("long").alias("ts"), *OHLCV), lambda x: F.struct(x.alias("bars")))).drop("adj_close")
)


@query("src_av_json", _BARS_BACK.replace(HOUR, DAY))
def _(s: SparkSession, d: str) -> DataFrame:
    day = F.create_map(F.date_format("ts_utc", "yyyy-MM-dd"), F.create_map(*(x for i, c in enumerate(OHLCV, 1) for x in (F.lit(f"{i}. {c}"), F.col(c).cast("string")))))
    rows = bars(s, d, "day").select(F.col("instrument_id").alias("vendor_symbol"), F.to_json(F.create_map(F.lit("Time Series (Daily)"), day)).alias("payload"))
    return vendors.alphavantage_bars(vendors.alphavantage_status(rows).where("status = 'ok'")).drop("adj_close")


@query("src_bhavcopy_csv", f"WITH b AS ({DAY}) SELECT upper(instrument_id) AS vendor_symbol, ts_utc + INTERVAL '3 hours 45 minutes' AS ts, {_ROUNDED} FROM b WHERE instrument_id <> 'click'")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = bars(s, d, "day").select(
        F.to_date("ts_utc").alias("session_date"), F.col("instrument_id").alias("TckrSymb"), F.when(F.col("instrument_id") == "click", "BE").otherwise(" EQ ").alias("SctySrs"),
        *(F.col(a).cast("string").alias(b) for a, b in zip(OHLCV, ("OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol"), strict=True)),
    )
    return vendors.bhavcopy_bars(rows).drop("adj_close")


def _pair_payloads(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/supplier.parquet")
    pair = F.struct(F.lit("solana").alias("chainId"), F.col("s_suppkey").cast("string").alias("pairAddress"), F.col("s_acctbal").cast("string").alias("priceUsd"), F.struct(F.col("s_acctbal").alias("usd")).alias("liquidity"))
    return p.groupBy(F.col("s_nationkey").cast("string").alias("vendor_symbol")).agg(F.to_json(F.struct(F.collect_list(pair).alias("pairs"))).alias("payload"))


query("src_snapshot_json", "SELECT s_suppkey::VARCHAR AS pair_address, round(s_acctbal, 6) AS price_usd, round(s_acctbal, 6) AS liquidity_usd, CASE WHEN s_acctbal > 0 THEN 'ok' ELSE 'suspect' END AS quality FROM supplier")(
    lambda s, d: vendors.snapshots(_pair_payloads(s, d), F.lit("2024-01-01").cast("timestamp")).select("pair_address", "price_usd", "liquidity_usd", "quality")
)
query("snapshot_quality", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'ok' ELSE 'suspect' END AS quality FROM supplier")(
    lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", vendors.snapshot_quality(F.lit(1.0), F.col("s_acctbal")).alias("quality"))
)
query(
    "dex_rank_pairs",
    "SELECT s_nationkey::VARCHAR AS vendor_symbol, first(s_suppkey::VARCHAR ORDER BY s_acctbal DESC, s_suppkey::VARCHAR) AS best, array_to_string(list(s_suppkey::VARCHAR ORDER BY s_acctbal DESC, s_suppkey::VARCHAR)[2:], ',') AS alternatives FROM supplier GROUP BY 1",
)(
    lambda s, d: vendors.ranked_pairs(vendors.pairs(_pair_payloads(s, d)).select("vendor_symbol", F.col("pairAddress").alias("pair_address"), F.col("liquidity.usd").alias("liquidity_usd"))).withColumn(
        "alternatives", F.concat_ws(",", "alternatives")
    )
)
query("parse_instrument_id", "SELECT c_custkey, 'equity' AS asset_class, 'XNAS' AS venue, upper(c_name) AS symbol FROM customer")(
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", catalog.parsed_id(F.concat(F.lit("eq:xnas:"), F.col("c_name"))).alias("p")).select("c_custkey", "p.*")
)
query("vendor_ticker", "SELECT n_nationkey, n_name || CASE n_nationkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '=X' ELSE '' END AS ticker FROM nation")(
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", catalog.vendor_ticker(F.lit("equity"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'XNSE' WHEN 1 THEN 'CCY' ELSE 'XNAS' END"), F.col("n_name")).alias("ticker"))
)

# --- panels -------------------------------------------------------------------------------------------------------

_GRID = f"""grid AS (SELECT d AS session_date, ((d + TIME '09:30:00') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS o, ((d + TIME '16:00:00') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS c
FROM (SELECT t::DATE AS d FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS t) WHERE isodow(t) < 6 AND t::DATE NOT IN ({_HOL})))"""
_NY = "((b.ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE"


def _grid(s: SparkSession) -> DataFrame:
    return calendar.nyse_grid(calendar.sessions(s, date(2024, 1, 1), date(2024, 1, 31)))


query("join_metadata", f"WITH b AS ({DAY}) SELECT b.instrument_id, b.ts_utc, length(instrument_id) AS code FROM b")(
    lambda s, d: panel.with_metadata(bars(s, d, "day"), bars(s, d, "day").select("instrument_id").distinct().withColumn("code", F.length("instrument_id").cast("long"))).select("instrument_id", "ts_utc", "code")
)
query(
    "sample_session_daily",
    f"WITH b AS ({DAY}), {_GRID} SELECT n.instrument_id, g.c AS ts_utc, g.session_date, round(b.close, 6) AS close FROM grid g CROSS JOIN (SELECT DISTINCT instrument_id FROM b) n LEFT JOIN b ON b.instrument_id = n.instrument_id AND {_NY} = g.session_date",
)(lambda s, d: panel.sample_daily(bars(s, d, "day"), _grid(s)).select("instrument_id", "ts_utc", "session_date", "close"))
query(
    "sample_session_intraday",
    f"""WITH b AS ({HOUR}), {_GRID} SELECT b.instrument_id, g.session_date, any_value(g.c) AS ts_utc, {r6(open='arg_min(b.open, b.ts_utc)', high='max(b.high)', low='min(b.low)', close='arg_max(b.close, b.ts_utc)', volume='sum(b.volume)')}
FROM b JOIN grid g ON {_NY} = g.session_date WHERE b.ts_utc + INTERVAL 1 HOUR > g.o AND b.ts_utc + INTERVAL 1 HOUR <= g.c GROUP BY 1, 2""",
)(lambda s, d: panel.sample_hourly(bars(s, d), _grid(s)))
_RATES = "rt AS (SELECT ts_utc, close / 100 / 365 AS rate FROM b WHERE instrument_id = 'click' AND day(ts_utc) % 4 = 1), st AS (SELECT DISTINCT ts_utc FROM b), aj AS (SELECT st.ts_utc, rt.rate FROM st ASOF LEFT JOIN rt ON st.ts_utc >= rt.ts_utc)"
_CASH = f"{_RATES}, cash AS (SELECT ts_utc, coalesce(rate, 0) * coalesce(date_diff('microsecond', lag(ts_utc) OVER (ORDER BY ts_utc), ts_utc) / 86400000000, 0) AS daily_tbill FROM aj)"


def _yields(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d, "day").where("instrument_id = 'click' AND day(ts_utc) % 4 = 1").select("ts_utc", "close")


query("asof_cash_rate", f"WITH b AS ({DAY}), {_CASH} SELECT {KEYS}, round(daily_tbill, 6) AS daily_tbill FROM b JOIN cash USING (ts_utc)")(lambda s, d: panel.with_cash(bars(s, d, "day"), _yields(s, d)).select("instrument_id", "ts_utc", "daily_tbill"))
query("tbill_period_return", f"WITH b AS ({DAY}), {_CASH} SELECT ts_utc, round(daily_tbill, 6) AS daily_tbill FROM cash")(
    lambda s, d: panel.period_cash(joins.asof_backward(bars(s, d, "day").select("ts_utc").distinct(), _yields(s, d).select("ts_utc", (F.col("close") / 100 / 365).alias("tbill_per_day")), "ts_utc", "tbill_per_day"))
)
_FX = "q AS (SELECT ts_utc, close AS fx FROM b WHERE instrument_id = 'click' AND day(ts_utc) % 4 = 1), f AS (SELECT b.*, q.fx FROM b ASOF LEFT JOIN q ON b.ts_utc >= q.ts_utc)"


def _universe(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d, "day").select("instrument_id").distinct().selectExpr("instrument_id", "if(instrument_id = 'view', 'INR', 'USD') AS currency", "if(instrument_id = 'view', 'NSE', 'NYSE') AS calendar")


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return _yields(s, d).withColumnRenamed("close", "fx")


query("fx_convert", f"WITH b AS ({DAY}), {_FX} SELECT {KEYS}, round(CASE WHEN instrument_id = 'view' AND fx <> 0 THEN close / fx ELSE close END, 6) AS close FROM f")(
    lambda s, d: panel.to_base(panel.with_metadata(bars(s, d, "day"), _universe(s, d)), _quotes(s, d), "USD").select("instrument_id", "ts_utc", "close")
)
query(
    "panel_native",
    f"""WITH b AS ({DAY}), {_FX}, {_CASH} SELECT f.instrument_id, f.ts_utc, round(CASE WHEN instrument_id = 'view' AND fx <> 0 THEN close / fx ELSE close END, 6) AS close, instrument_id = 'view' OR (isodow(f.ts_utc) < 6 AND f.ts_utc::DATE NOT IN ({_HOL})) AS is_session,
round(daily_tbill, 6) AS daily_tbill FROM f JOIN cash USING (ts_utc) WHERE f.ts_utc IN (SELECT ts_utc FROM b GROUP BY 1 HAVING count(DISTINCT instrument_id) = 5)""",
)(
    lambda s, d: panel.native_panel(
        bars(s, d, "day"), _universe(s, d), 5, s.createDataFrame([(x,) for x in sorted(calendar.nyse_holidays(2024))], "session_date date"), _quotes(s, d), "USD", _yields(s, d)
    ).select("instrument_id", "ts_utc", "close", "is_session", "daily_tbill")
)

# --- winners, books and scorecards --------------------------------------------------------------------------------

_ENDS = f"t AS (SELECT DISTINCT ts_utc, date_trunc('quarter', {_IST}) AS q FROM b), nx AS (SELECT *, lead(q) OVER (ORDER BY ts_utc) AS nq FROM t), ends AS (SELECT ts_utc, q FROM nx WHERE nq <> q), sp AS (SELECT e.ts_utc AS e, a.ts_utc AS a FROM ends e JOIN ends a ON a.q = e.q - INTERVAL 1 YEAR)"
_RANK = f"""{_ENDS}, rt AS (SELECT sp.e AS ts_utc, z.instrument_id, z.close / x.close - 1 AS ret, (SELECT count(*) FROM b k WHERE k.instrument_id = z.instrument_id AND k.ts_utc BETWEEN sp.a AND sp.e) AS prints
FROM sp JOIN b z ON z.ts_utc = sp.e JOIN b x ON x.ts_utc = sp.a AND x.instrument_id = z.instrument_id WHERE x.close > 0)"""
_QUARTER = f"{_RANK}, rk AS (SELECT *, row_number() OVER (PARTITION BY ts_utc ORDER BY ret DESC, instrument_id) AS p FROM rt WHERE prints >= 50), won AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY ts_utc) AS weight FROM rk WHERE p <= 2)"
_WEIGHTS = "tw AS (SELECT b.instrument_id, b.ts_utc, b.close, CASE WHEN b.ts_utc IN (SELECT ts_utc FROM won) THEN coalesce(won.weight, 0) END::DOUBLE AS weight FROM b LEFT JOIN won ON won.instrument_id = b.instrument_id AND won.ts_utc = b.ts_utc)"
query("strat_quarter_winner", f"WITH b AS ({PX_DAILY_SQL}), {_QUARTER}, {_WEIGHTS} SELECT {KEYS}, round(weight, 6) AS weight FROM tw")(lambda s, d: strategies.quarter_winner(px_daily(s, d), 2, 50))
query(
    "strat_cap_mix",
    f"""WITH b AS ({PX_DAILY_SQL}), {_RANK}, sl(sleeve, instrument_id, n) AS (VALUES ('a', '1-URGENT', 1), ('a', '2-HIGH', 1), ('b', '2-HIGH', 2), ('b', '3-MEDIUM', 2), ('b', '5-LOW', 2)),
rk AS (SELECT rt.ts_utc, sl.*, row_number() OVER (PARTITION BY rt.ts_utc, sleeve ORDER BY ret DESC, rt.instrument_id) AS p FROM rt JOIN sl USING (instrument_id) WHERE prints >= 50),
pl AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY ts_utc) AS weight FROM rk WHERE p <= n), won AS (SELECT ts_utc, instrument_id, any_value(weight) AS weight FROM pl GROUP BY 1, 2), {_WEIGHTS} SELECT {KEYS}, round(weight, 6) AS weight FROM tw""",
)(
    lambda s, d: strategies.cap_mix(
        px_daily(s, d), s.createDataFrame([("a", "1-URGENT", 1), ("a", "2-HIGH", 1), ("b", "2-HIGH", 2), ("b", "3-MEDIUM", 2), ("b", "5-LOW", 2)], "sleeve string, instrument_id string, n int"), 50
    )
)
query(
    "strat_winner_stop",
    f"""WITH b AS ({PX_DAILY_SQL}), {_QUARTER}, {_WEIGHTS}, sm AS (SELECT {KEYS}, {over('avg(close)', 20, 'close')} AS m FROM b), rs AS (SELECT DISTINCT ts_utc AS r FROM won),
ck AS (SELECT tw.*, sm.m, rs.r FROM tw JOIN sm USING (instrument_id, ts_utc) ASOF LEFT JOIN rs ON tw.ts_utc >= rs.r), br AS (SELECT ck.instrument_id, ck.r, min(ck.ts_utc) AS ts_utc FROM ck JOIN won ON won.instrument_id = ck.instrument_id AND won.ts_utc = ck.r WHERE ck.ts_utc > ck.r AND ck.close < ck.m GROUP BY 1, 2)
SELECT {KEYS}, round(CASE WHEN br.r IS NOT NULL THEN 0 ELSE weight END, 6) AS weight FROM ck LEFT JOIN br USING (instrument_id, ts_utc)""",
)(lambda s, d: strategies.with_stop(px_daily(s, d), strategies.quarter_winner(px_daily(s, d), 2, 50), 20))
query("broker_desired", f"WITH {_BOOK} SELECT {KEYS}, round(desired, 6) AS desired FROM ds")(lambda s, d: broker.desired(px_smooth(s, d), strategies.buy_hold(px_smooth(s, d))).select("instrument_id", "ts_utc", "desired"))
query("broker_join_targets", f"WITH {_BOOK} SELECT {KEYS}, round(weight, 6) AS weight FROM tg")(lambda s, d: broker.desired(px_smooth(s, d), strategies.buy_hold(px_smooth(s, d))).select("instrument_id", "ts_utc", "weight"))


def _moving(s: SparkSession, d: str) -> DataFrame:
    """Targets that move with prices: each name's share of the stamp's closes."""
    return px_smooth(s, d).withColumn("weight", F.round(F.try_divide("close", F.sum("close").over(Window.partitionBy("ts_utc"))), 9)).select("instrument_id", "ts_utc", "weight")


query(
    "broker_banded",
    f"""WITH RECURSIVE b AS ({PX_SMOOTH_SQL}), t AS (SELECT *, round(close / sum(close) OVER (PARTITION BY ts_utc), 9) AS weight FROM b), ds AS (SELECT *, lag(weight) OVER ({W}) AS g, row_number() OVER ({W}) AS rn FROM t),
h AS (SELECT instrument_id, ts_utc, rn, 0.0::DOUBLE AS w FROM ds WHERE rn = 1 UNION ALL SELECT ds.instrument_id, ds.ts_utc, ds.rn, CASE WHEN g IS NULL OR open IS NULL THEN h.w WHEN abs(g) <= 1e-12 THEN 0 WHEN abs(g - h.w) < 0.05 - 1e-12 THEN h.w ELSE h.w + (g - h.w) / 2 END FROM h JOIN ds ON ds.instrument_id = h.instrument_id AND ds.rn = h.rn + 1)
SELECT {KEYS}, round(w, 6) AS w FROM h""",
)(lambda s, d: broker.banded(broker.desired(px_smooth(s, d), _moving(s, d)), flat=0.05, half=True).select("instrument_id", "ts_utc", "w"))


def _holed(s: SparkSession, d: str) -> DataFrame:
    """The smooth prices with opens and closes taken out, so that bars are half or wholly closed."""
    return px_smooth(s, d).withColumn("open", F.expr("if(day(ts_utc) % 7 = 3, null, open)")).withColumn("close", F.expr("if(day(ts_utc) % 5 = 2, null, close)"))


_HOLED = f"SELECT instrument_id, ts_utc, CASE WHEN day(ts_utc) % 7 <> 3 THEN open END AS open, CASE WHEN day(ts_utc) % 5 <> 2 THEN close END AS close FROM ({PX_SMOOTH_SQL})"
_CLOSED_BOOK = book_sql(px=_HOLED)


def _holed_book(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return broker.run_book(_holed(s, d), strategies.buy_hold(_holed(s, d)), 10.0)


query("broker_closed_bars", f"WITH {_CLOSED_BOOK} SELECT {KEYS}, {r6(w='w', dw='dw', gap_part='gp', bar_part='br', fee_part='fe')} FROM pt")(
    lambda s, d: _holed_book(s, d)[0].select("instrument_id", "ts_utc", "w", "dw", "gap_part", "bar_part", "fee_part")
)
query("equity_closed_bars", f"WITH {_CLOSED_BOOK} SELECT ts_utc, {r6(r='r', log_equity='ln(equity)', cash_weight='cash_weight')} FROM eq")(
    lambda s, d: _holed_book(s, d)[1].select("ts_utc", "r", F.log("equity").alias("log_equity"), "cash_weight")
)
# targets that fall to zero every few days: a zero exits at once, inside the band and with half moves
_PULSE = "CASE WHEN day(ts_utc) % 4 = 0 THEN 0 WHEN day(ts_utc) % 4 < 3 THEN 0.3 END"
query(
    "broker_zero_exit",
    f"""WITH RECURSIVE b AS ({_HOLED}), ds AS (SELECT *, lag({_PULSE}::DOUBLE) OVER ({W}) AS g, row_number() OVER ({W}) AS rn FROM b),
h AS (SELECT instrument_id, ts_utc, rn, 0.0::DOUBLE AS w FROM ds WHERE rn = 1 UNION ALL SELECT ds.instrument_id, ds.ts_utc, ds.rn, CASE WHEN g IS NULL OR open IS NULL THEN h.w WHEN g = 0 THEN 0 WHEN abs(g - h.w) < 0.2 - 1e-12 THEN h.w ELSE h.w + (g - h.w) / 2 END FROM h JOIN ds ON ds.instrument_id = h.instrument_id AND ds.rn = h.rn + 1)
SELECT {KEYS}, round(w, 6) AS w FROM h""",
)(lambda s, d: broker.banded(broker.desired(_holed(s, d), _holed(s, d).select("instrument_id", "ts_utc", F.expr(f"cast({_PULSE} as double)").alias("weight"))), flat=0.2, half=True).select("instrument_id", "ts_utc", "w"))
# state of the recursion: dollars by name, in the order of names, and cash
query(
    "broker_drift",
    f"""WITH RECURSIVE px AS ({PX_SMOOTH_SQL}), st AS (SELECT ts_utc, row_number() OVER (ORDER BY ts_utc) AS t, lead(date_trunc('week', {_LOCAL})) OVER (ORDER BY ts_utc) <> date_trunc('week', {_LOCAL}) OR row_number() OVER (ORDER BY ts_utc) = 1 AS reset FROM (SELECT DISTINCT ts_utc FROM px)),
tg AS (SELECT px.*, t, CASE WHEN reset THEN CASE instrument_id WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 ELSE 0 END END::DOUBLE AS weight FROM px JOIN st USING (ts_utc)),
ds AS (SELECT *, lag(weight) OVER ({W}) AS g, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM tg),
nm AS (SELECT DISTINCT instrument_id FROM px), gr AS (SELECT st.t, nm.instrument_id, ds.ts_utc IS NOT NULL AS here, g, open, coalesce(CASE WHEN open IS NOT NULL AND close IS NOT NULL AND abs(p) > 1e-12 THEN open / p END, 1) AS nf, coalesce(CASE WHEN close IS NOT NULL AND abs(open) > 1e-12 THEN close / open END, 1) AS df
FROM st CROSS JOIN nm LEFT JOIN ds ON ds.t = st.t AND ds.instrument_id = nm.instrument_id),
ls AS (SELECT t, list(here ORDER BY instrument_id) AS here, list(CASE WHEN open IS NOT NULL THEN g END ORDER BY instrument_id) AS g, list(nf ORDER BY instrument_id) AS nf, list(df ORDER BY instrument_id) AS df FROM gr GROUP BY t),
bk AS (SELECT 0::BIGINT AS t, [0.0::DOUBLE, 0, 0, 0, 0] AS e, [0.0::DOUBLE, 0, 0, 0, 0] AS h, [0.0::DOUBLE, 0, 0, 0, 0] AS x, 1.0::DOUBLE AS c UNION ALL
SELECT t, e, h, list_transform(range(1, 6), lambda i: h[i] * each * df[i]), greatest(0, 1 - gross) * each FROM (SELECT *, wealth * (1 - cost * 10 / 10000) / (gross + greatest(0, 1 - gross)) AS each FROM (
SELECT *, list_sum(h) AS gross, list_sum(list_transform(range(1, 6), lambda i: abs(h[i] - e[i]))) AS cost FROM (SELECT *, list_transform(range(1, 6), lambda i: CASE WHEN here[i] THEN coalesce(g[i], e[i]) ELSE 0 END) AS h FROM (
SELECT ls.t, ls.here, ls.g, ls.df, list_transform(range(1, 6), lambda i: CASE WHEN here[i] THEN bk.x[i] / (list_sum(bk.x) + bk.c) ELSE 0 END) AS e, list_sum(list_transform(range(1, 6), lambda i: bk.x[i] * ls.nf[i])) + bk.c AS wealth FROM bk JOIN ls ON ls.t = bk.t + 1)))))
SELECT gr.instrument_id, st.ts_utc, round(e[k], 6) AS w0, round(h[k], 6) AS w, round(h[k] - e[k], 6) AS dw FROM bk JOIN st USING (t) JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY instrument_id) AS k FROM gr) gr USING (t) WHERE gr.here""",
)(lambda s, d: broker.drifting(broker.desired(px_smooth(s, d), strategies.periodic(px_smooth(s, d), {"click": 0.5, "view": 0.3}, "week")), 10.0).select("instrument_id", "ts_utc", "w0", "w", "dw"))
query(
    "sip_drawdown",
    f"""WITH RECURSIVE {_BOOK}, o AS (SELECT ts_utc, r, row_number() OVER (ORDER BY ts_utc) AS rn, CASE WHEN coalesce(lag(date_trunc('month', ts_utc)) OVER (ORDER BY ts_utc) <> date_trunc('month', ts_utc), true) THEN 100.0 ELSE 0 END AS c FROM eq),
k AS (SELECT rn, ts_utc, c::DOUBLE AS w, c::DOUBLE AS hi FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.ts_utc, k.w * (1 + o.r) + o.c, greatest(k.hi, k.w * (1 + o.r) + o.c) FROM k JOIN o ON o.rn = k.rn + 1) SELECT ts_utc, round(w / hi - 1, 6) AS sip_drawdown FROM k""",
)(lambda s, d: metrics.sip(_book(s, d)[1]).select("ts_utc", "sip_drawdown"))
query(
    "sip_xirr",
    f"""WITH RECURSIVE {_BOOK}, o AS (SELECT ts_utc, r, row_number() OVER (ORDER BY ts_utc) AS rn, CASE WHEN coalesce(lag(date_trunc('month', ts_utc)) OVER (ORDER BY ts_utc) <> date_trunc('month', ts_utc), true) THEN 100.0 ELSE 0 END AS c FROM eq),
k AS (SELECT rn, c::DOUBLE AS w FROM o WHERE rn = 1 UNION ALL SELECT o.rn, k.w * (1 + o.r) + o.c FROM k JOIN o ON o.rn = k.rn + 1),
fl AS (SELECT ts_utc, -c::DOUBLE AS a FROM o WHERE c <> 0 UNION ALL SELECT (SELECT max(ts_utc) FROM o), (SELECT arg_max(w, rn) FROM k)),
lf AS (SELECT list({{'a': a::DOUBLE, 'd': date_diff('second', (SELECT min(ts_utc) FROM o), ts_utc) / 86400 / 365}}) AS f FROM fl),
bs AS (SELECT 0 AS i, -0.999999::DOUBLE AS lo, 1e9::DOUBLE AS hi UNION ALL SELECT i + 1, CASE WHEN v > 0 THEN mid ELSE lo END, CASE WHEN v > 0 THEN hi ELSE mid END FROM
(SELECT *, list_sum(list_transform(f, lambda x: x.a / pow(1 + mid, x.d))) AS v FROM (SELECT bs.*, (lo + hi) / 2 AS mid, lf.f FROM bs, lf WHERE i < 200)))
SELECT round((lo + hi) / 2, 6) AS xirr FROM bs WHERE i = 200""",
)(lambda s, d: metrics.sip_rate(metrics.sip(_book(s, d)[1])))
query("month_end_growth", f"WITH {_BOOK} SELECT date_trunc('month', ts_utc) AS month, max(ts_utc) AS ts_utc, round(ln(arg_max(equity, ts_utc)), 6) AS log_growth FROM eq GROUP BY 1")(
    lambda s, d: metrics.month_ends(_book(s, d)[1]).select("month", "ts_utc", F.log(F.col("growth") / 100).alias("log_growth"))
)
query(
    "month_end_allocation",
    f"""WITH b AS ({PX_DAILY_SQL}), {_QUARTER}, {_WEIGHTS}, m AS (SELECT date_trunc('month', ts_utc) AS month, max(ts_utc) AS ts_utc FROM tw GROUP BY 1), x AS (SELECT m.ts_utc, n.instrument_id, coalesce((SELECT arg_max(k.weight, k.ts_utc) FROM tw k WHERE k.instrument_id = n.instrument_id AND k.ts_utc <= m.ts_utc AND k.weight IS NOT NULL), 0) AS weight
FROM m, (SELECT DISTINCT instrument_id FROM b) n) SELECT ts_utc, instrument_id, round(weight, 6) AS weight, round(1 - sum(greatest(weight, 0)) OVER (PARTITION BY ts_utc), 6) AS cash FROM x""",
)(lambda s, d: metrics.month_end_allocation(strategies.quarter_winner(px_daily(s, d), 2, 50)))


def _runs(s: SparkSession, d: str) -> DataFrame:
    p = px_smooth(s, d)
    named = {"even": strategies.buy_hold(p), "static": strategies.static(p, {"click": 0.6, "view": 0.3})}
    curves = [broker.run_book(p, t, 10.0)[1].withColumn("run_id", F.lit(n)) for n, t in named.items()]
    return curves[0].unionByName(curves[1])


_STATIC = book_sql(weight="CASE instrument_id WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.3 ELSE 0 END::DOUBLE")
query(
    "metrics_aligned",
    " UNION ALL ".join(f"SELECT {n!r} AS run_id, ts_utc, round(r, 6) AS r FROM (WITH {book} SELECT *, row_number() OVER (ORDER BY ts_utc) AS n FROM eq) WHERE n > 5" for n, book in (("even", _BOOK), ("static", _STATIC))),
)(lambda s, d: metrics.aligned(_runs(s, d), {"even": 2, "static": 5}).select("run_id", "ts_utc", "r"))
query(
    "metrics_excess",
    f"WITH u AS ({' UNION ALL '.join(f'SELECT {n!r} AS run_id, (SELECT arg_max(equity, ts_utc) / arg_min(equity, ts_utc) - 1 FROM (WITH {book} SELECT * FROM eq)) AS t' for n, book in (('even', _BOOK), ('static', _STATIC)))}) SELECT run_id, round(t, 6) AS total_return, round(t - (SELECT t FROM u WHERE run_id = 'even'), 6) AS excess FROM u",
)(lambda s, d: metrics.run_returns(_runs(s, d), "even"))
_VENUE = "(CASE WHEN n.instrument_id = 'view' THEN ((b.ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata')::DATE ELSE " + _NY + " END)"
query(
    "panel_session",
    f"""WITH b AS ({DAY}), {_GRID}, n AS (SELECT DISTINCT instrument_id FROM b), l AS (SELECT n.instrument_id, b.close, {_VENUE} AS session_date FROM n JOIN b ON b.instrument_id = n.instrument_id),
p AS (SELECT n.instrument_id, g.c AS ts_utc, g.session_date, l.close FROM grid g CROSS JOIN n LEFT JOIN l ON l.instrument_id = n.instrument_id AND l.session_date = g.session_date),
q AS (SELECT ts_utc, close AS fx FROM b WHERE instrument_id = 'click' AND day(ts_utc) % 4 = 1), f AS (SELECT p.*, q.fx FROM p ASOF LEFT JOIN q ON p.ts_utc >= q.ts_utc)
SELECT {KEYS}, session_date, round(CASE WHEN instrument_id = 'view' AND fx <> 0 THEN close / fx ELSE close END, 6) AS close, TRUE AS is_session, 0.0::DOUBLE AS daily_tbill
FROM f WHERE ts_utc IN (SELECT ts_utc FROM p GROUP BY 1 HAVING count(close) > 0)""",
)(lambda s, d: panel.session_panel(bars(s, d, "day"), _universe(s, d), _grid(s), _quotes(s, d)).select("instrument_id", "ts_utc", "session_date", "close", "is_session", "daily_tbill"))
query(
    "metrics_cash",
    f"""WITH {_BOOK}, a AS (SELECT count(*) AS n, date_diff('microsecond', min(ts_utc), max(ts_utc)) / 86400000000 / 365.25 AS y, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS dn FROM eq), yr AS (SELECT year(ts_utc) AS y, product(1 + r) - 1 AS ret FROM eq GROUP BY 1)
SELECT {r6(sharpe_excess='m / sd * sqrt(n / a.y)', sortino_excess='m / dn * sqrt(n / a.y)')}, (SELECT arg_max(y, ret) FROM yr)::INT AS best_year, (SELECT arg_min(y, ret) FROM yr)::INT AS worst_year FROM a""",
)(lambda s, d: metrics.excess(_book(s, d)[1]).select("sharpe_excess", "sortino_excess", "best_year", "worst_year"))

# --- trend signals ------------------------------------------------------------------------------------------------



def _ewm(name: str, half_life: float) -> str:
    """Recursive step of mean, variance and squared weights under adjust=False, of returns from the second row on."""
    k = 0.5 ** (1 / half_life)
    step = f"{name}.m + {1 - k!r} * (x.ret - {name}.m), {k!r} * ({name}.v + {1 - k!r} * (x.ret - {name}.m) * (x.ret - {name}.m)), {k * k!r} * {name}.s2 + {(1 - k) ** 2!r}"
    return f"{name} AS (SELECT instrument_id, rn, ret AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS s2 FROM x WHERE rn = 2 UNION ALL SELECT x.instrument_id, x.rn, {step} FROM {name} JOIN x ON x.instrument_id = {name}.instrument_id AND x.rn = {name}.rn + 1)"


_PREPARED = f"""b AS ({PX_DAILY_SQL}), x AS (SELECT {KEYS}, close AS px, close / {lag('close')} - 1 AS ret, median(close * volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv, row_number() OVER ({W}) AS rn FROM b), {_ewm('ef', 10)}, {_ewm('es', 60)},
pr AS (SELECT x.*, CASE WHEN x.rn > 2 THEN sqrt(ef.v / (1 - ef.s2)) END AS vol_fast, CASE WHEN x.rn > 2 THEN sqrt(es.v / (1 - es.s2)) END AS vol_slow FROM x LEFT JOIN ef USING (instrument_id, rn) LEFT JOIN es USING (instrument_id, rn))"""
query("prism_prepare", f"WITH RECURSIVE {_PREPARED} SELECT {KEYS}, {r6(px='px', ret='ret', vol_fast='vol_fast', vol_slow='vol_slow', adv='adv')} FROM pr")(lambda s, d: trend.prepared(px_daily(s, d)).select("instrument_id", "ts_utc", "px", "ret", "vol_fast", "vol_slow", "adv"))
query(
    "prism_vol",
    f"""WITH RECURSIVE {_PREPARED}, dn AS (SELECT *, date_diff('day', DATE '1970-01-01', ((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE) AS dno FROM pr)
SELECT {KEYS}, round(greatest(vol_fast, vol_slow) * sqrt(greatest(count(px) OVER (PARTITION BY instrument_id ORDER BY dno RANGE BETWEEN 364 PRECEDING AND CURRENT ROW), 1)), 6) AS vol_ann FROM dn""",
)(lambda s, d: trend.with_yearly_vol(trend.prepared(px_daily(s, d))).select("instrument_id", "ts_utc", "vol_ann"))
query(
    "prism_tsmom",
    f"""WITH b AS ({PX_DAILY_SQL}), dd AS (SELECT DISTINCT ts_utc, ((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS y FROM b), lk AS (SELECT dd.ts_utc, m.m, max(e.ts_utc) AS f FROM dd, (VALUES (1), (3)) m(m), dd e WHERE e.y <= dd.y - to_months(m.m) GROUP BY 1, 2),
sc AS (SELECT b.instrument_id, b.ts_utc, greatest(-1, least(1, (b.close / x.close - 1) / (0.5 * sqrt(date_diff('day', lk.f, b.ts_utc) / 365.25)) / 2)) AS z FROM b JOIN lk USING (ts_utc) JOIN b x ON x.instrument_id = b.instrument_id AND x.ts_utc = lk.f),
rw AS (SELECT instrument_id, ts_utc, avg(z) AS raw FROM sc GROUP BY 1, 2 HAVING count(*) = 2) SELECT {KEYS}, round(raw, 6) AS raw FROM b LEFT JOIN rw USING (instrument_id, ts_utc)""",
)(lambda s, d: trend.momentum(px_daily(s, d).withColumn("px", F.col("close")).withColumn("vol_ann", F.lit(0.5)), (1, 3)).select("instrument_id", "ts_utc", "raw"))
query(
    "prism_hysteresis",
    f"""WITH RECURSIVE b AS ({DAY}), x AS (SELECT {KEYS}, row_number() OVER ({W}) AS rn, close / {lag('close')} - 1 AS raw FROM b), h AS (SELECT instrument_id, ts_utc, rn, 0.0::DOUBLE AS trend FROM x WHERE rn = 1
UNION ALL SELECT x.instrument_id, x.ts_utc, x.rn, CASE WHEN raw IS NULL THEN 0 WHEN raw > 0.3 THEN least(1, raw) WHEN raw < -0.3 THEN 0 ELSE h.trend END FROM h JOIN x ON x.instrument_id = h.instrument_id AND x.rn = h.rn + 1) SELECT {KEYS}, round(trend, 6) AS trend FROM h""",
)(lambda s, d: trend.latched(bars(s, d, "day").withColumn("raw", F.expr("try_divide(close, lag(close) OVER (PARTITION BY instrument_id ORDER BY ts_utc)) - 1")), 0.3).select("instrument_id", "ts_utc", "trend"))
_STALE = "CASE WHEN day(ts_utc) % 7 > 2 THEN 1.0 WHEN day(ts_utc) % 5 > 0 THEN close END"
query(
    "prism_healthy",
    f"""WITH RECURSIVE b AS ({DAY}), x AS (SELECT {KEYS}, row_number() OVER ({W}) AS rn, {_STALE} AS px FROM b), h AS (SELECT instrument_id, ts_utc, rn, CASE WHEN px IS NULL THEN 1 ELSE 0 END AS k, px AS l FROM x WHERE rn = 1
UNION ALL SELECT x.instrument_id, x.ts_utc, x.rn, CASE WHEN x.px IS NULL OR x.px = h.l THEN h.k + 1 ELSE 0 END, coalesce(x.px, h.l) FROM h JOIN x ON x.instrument_id = h.instrument_id AND x.rn = h.rn + 1) SELECT {KEYS}, k <= 2 AS healthy FROM h""",
)(lambda s, d: trend.with_health(bars(s, d, "day").withColumn("px", F.expr(_STALE)), 2).select("instrument_id", "ts_utc", "healthy"))
_PRINT = "CASE WHEN day(ts_utc) % 3 > 0 THEN close END"
query(
    "prism_ramp",
    f"""WITH RECURSIVE b AS ({PX_DAILY_SQL}), x AS (SELECT {KEYS}, row_number() OVER ({W}) AS rn, {_PRINT} AS px FROM b), k AS (SELECT instrument_id, ts_utc, rn, px, CASE WHEN px IS NULL THEN 1 ELSE 0 END AS k, px AS l, px IS NOT NULL AS live, CASE WHEN px IS NOT NULL THEN 1 / 21.0::DOUBLE ELSE 0 END AS ramp FROM x WHERE rn = 1
UNION ALL SELECT instrument_id, ts_utc, rn, px, k, l, px IS NOT NULL AND k <= 2, CASE WHEN px IS NOT NULL AND k <= 2 THEN least(1, ramp + 1 / 21.0::DOUBLE) WHEN was AND k > 2 AND px IS NULL THEN 0 ELSE greatest(0, ramp - 0.2::DOUBLE) END FROM
(SELECT x.*, CASE WHEN x.px IS NULL OR x.px = k.l THEN k.k + 1 ELSE 0 END AS k, coalesce(x.px, k.l) AS l, k.live AS was, k.ramp FROM k JOIN x ON x.instrument_id = k.instrument_id AND x.rn = k.rn + 1)) SELECT {KEYS}, live, round(ramp, 6) AS ramp FROM k""",
)(
    lambda s, d: trend.with_ramp(trend.with_health(px_daily(s, d).withColumn("px", F.expr("if(day(ts_utc) % 3 > 0, close, null)")), 2).withColumn("live", F.expr("healthy AND px IS NOT NULL"))).select("instrument_id", "ts_utc", "live", "ramp")
)
query(
    "prism_corr",
    f"""WITH b AS ({PX_DAILY_SQL}), x AS (SELECT {KEYS}, close / {lag('close')} - 1 AS ret FROM b) SELECT p.instrument_id AS a, q.instrument_id AS b, round(CASE WHEN count(*) >= 20 THEN corr(p.ret, q.ret) ELSE 0 END, 6) AS rho
FROM x p JOIN x q ON p.ts_utc = q.ts_utc AND p.instrument_id < q.instrument_id WHERE p.ret IS NOT NULL AND q.ret IS NOT NULL GROUP BY 1, 2""",
)(lambda s, d: trend.correlations(px_daily(s, d).withColumn("ret", F.expr("close / lag(close) OVER (PARTITION BY instrument_id ORDER BY ts_utc) - 1"))))


def _grid_panel(s: SparkSession, d: str) -> DataFrame:
    """Every name at every stamp, with null prices where it did not print, and enough volume to be live."""
    b = px_daily(s, d).withColumn("volume", F.col("volume") * 1000)
    # names are few, and every name at every stamp is the panel
    grid = b.select("ts_utc").distinct().crossJoin(F.broadcast(b.select("instrument_id").distinct()))
    return grid.join(b, ["instrument_id", "ts_utc"], "left")


query("prism_live")(lambda s, d: trend.signals(_grid_panel(s, d)).select("instrument_id", "ts_utc", "trend", "live", "ramp", "liq_cap"))
query("prism_clusters")(lambda s, d: trend.monthly_clusters(trend.prepared(px_daily(s, d))))
# these names seldom print on the same day, so the window is longer than the strategy's
query("prism_lw")(lambda s, d: trend.latest_covariance(trend.prepared(px_daily(s, d)), window=2520))
query("prism_allocate")(lambda s, d: trend.clustered_trend(_grid_panel(s, d)).select("instrument_id", "ts_utc", "weight"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    names = bars(s, d, "day").select("instrument_id").distinct().selectExpr("instrument_id", "if(instrument_id = 'click', 'crypto', 'equity') AS asset_class", "if(instrument_id = 'view', 'XNSE', 'XNAS') AS venue")
    days = calendar.sessions(s, date(2024, 1, 1), date(2024, 1, 31))
    grids = [g(days).select("session_date", "open_utc", F.col("decision_ts").alias("close_utc"), F.lit(x).alias("exchange")) for g, x in ((calendar.nyse_grid, "XNYS"), (calendar.nse_grid, "XNSE"))]
    return calendar.session_windows(names, grids[0].unionByName(grids[1]), datetime(2024, 1, 8, 15), datetime(2024, 1, 20), "1h")


query(
    "session_windows",
    f"""WITH n AS (SELECT DISTINCT event_type AS instrument_id FROM events), {_GRID}, x AS (SELECT instrument_id, CASE WHEN instrument_id = 'view' THEN session_date + INTERVAL '3 hours 45 minutes' ELSE o END AS o, CASE WHEN instrument_id = 'view' THEN session_date + INTERVAL 10 HOUR ELSE c END AS c FROM n, grid WHERE instrument_id <> 'click')
SELECT instrument_id, greatest(o, TIMESTAMP '2024-01-08 15:00') AS start_utc, least(c, TIMESTAMP '2024-01-20') AS end_utc FROM x WHERE o < TIMESTAMP '2024-01-20' AND c > TIMESTAMP '2024-01-08 15:00'
UNION ALL SELECT 'click', TIMESTAMP '2024-01-08 15:00', TIMESTAMP '2024-01-20'""",
)(lambda s, d: _windows(s, d))


@query("normalize_bars", f"WITH b AS ({PX_SMOOTH_SQL}) SELECT {KEYS}, round(close, 6) AS close, round(close, 6) AS adj_close FROM b WHERE ts_utc <= TIMESTAMP '2024-01-21' AND open IS NOT NULL AND close IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = px_smooth(s, d).select("instrument_id", "ts_utc", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", F.lit(1.0).alias("volume"))
    rows = rows.withColumn("adj_close", F.lit(None).cast("double")).withColumn("timeframe", F.lit("1d"))
    pages = rows.withColumn("close", F.col("low")).withColumn("page_seq", F.lit(1)).unionByName(rows.withColumn("page_seq", F.lit(2)))
    return normalize.normalize(pages, "1d", "2024-01-20").select("instrument_id", "ts_utc", "close", "adj_close")
