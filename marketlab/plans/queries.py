"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlab.functions import indicators as ta
from marketlab.functions import recurrences as rec
from marketlab.functions import windows as wf
from marketlab.operators import broker, calendar, inspect, intervals, joins, metrics, normalize, resample, strategies
from marketlab.sources.series import BARS_SQL, PX_DAILY_SQL, PX_SMOOTH_SQL, bars, px_daily, px_smooth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR, DAY = BARS_SQL.format(unit="hour"), BARS_SQL.format(unit="day")
W = "PARTITION BY instrument_id ORDER BY ts_utc"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places and times without a zone, so that both engines' rows compare."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c) for c in df.columns))


def query(name: str, sql: str | None = None):
    """Register a builder under a name, with its SQL."""

    def put(build):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return put


def indicator(name: str, add: Callable[[DataFrame], DataFrame], columns: list[str], sql: str) -> None:
    """An indicator over hourly bars; sql: the body over the view ``bars``."""
    query(name, f"WITH RECURSIVE bars AS ({HOUR}) {sql}")(lambda spark, sf_dir: add(bars(spark, sf_dir)).select("instrument_id", "ts_utc", *columns))


def over(expr: str, n: int | None = None, x: str | None = None) -> str:
    """A window aggregate of the last n rows, null unless all n of x are known; without n, of all rows so far."""
    if n is None:
        return f"{expr} OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n} THEN {expr} {frame} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def r6(**columns: str) -> str:
    return ", ".join(f"round({e}, 6) AS {c}" for c, e in columns.items())


KEYS = "instrument_id, ts_utc"

# --- series, store and reader -------------------------------------------------------------------------------------

query("bars_1h", f"WITH b AS ({HOUR}) SELECT {KEYS}, {r6(open='open', high='high', low='low', close='close', volume='volume')} FROM b")(lambda s, d: bars(s, d))
query("scan_bars", f"WITH b AS ({HOUR}) SELECT ts_utc, round(close, 6) AS close FROM b WHERE instrument_id = 'click' AND ts_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ")(
    lambda s, d: bars(s, d).where("instrument_id = 'click' AND ts_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'").select("ts_utc", "close")
)


@query("upsert_latest", "SELECT event_type AS instrument_id, date_trunc('hour', ts) AS ts_utc, round(arg_max(value, event_id), 6) AS value, max(event_id) AS ingest_seq FROM events GROUP BY 1, 2")
def _(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("instrument_id"), F.date_trunc("hour", "ts").alias("ts_utc"), "value", F.col("event_id").alias("ingest_seq"))
    return joins.keep_latest(rows, ["instrument_id", "ts_utc"], "ingest_seq")


@query("dedup_last_write", "SELECT event_type AS instrument_id, date_trunc('day', ts) AS ts_utc, round(arg_max(value, row(user_id % 3, event_id)), 6) AS value, max(user_id % 3) AS source FROM events GROUP BY 1, 2")
def _(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("instrument_id"), F.date_trunc("day", "ts").alias("ts_utc"), "value", (F.col("user_id") % 3).alias("source"), "event_id")
    return joins.keep_latest(rows, ["instrument_id", "ts_utc"], "source", "event_id").drop("event_id")


query("adj_close_default", f"WITH b AS ({HOUR}) SELECT {KEYS}, round(coalesce(CASE WHEN volume > 2 THEN open END, close), 6) AS adj_close FROM b")(
    lambda s, d: normalize.with_adj_close(bars(s, d).withColumn("adj_close", F.expr("CASE WHEN volume > 2 THEN open END"))).select("instrument_id", "ts_utc", "adj_close")
)
query(
    "total_return_scale",
    f"WITH b AS ({HOUR}), k AS (SELECT *, CASE WHEN abs(close) > 1e-12 AND volume > 2 THEN open / close ELSE 1 END AS k FROM b) SELECT {KEYS}, {r6(open='open * k', high='high * k', low='low * k', close='close * k')} FROM k",
)(lambda s, d: normalize.total_return(bars(s, d).withColumn("adj_close", F.expr("CASE WHEN volume > 2 THEN open END"))).select("instrument_id", "ts_utc", "open", "high", "low", "close"))
query("filter_ohlc_valid", f"WITH b AS ({HOUR}) SELECT {KEYS} FROM b WHERE high - 20 >= greatest(open, close) AND low <= least(open, close)")(
    lambda s, d: bars(s, d).withColumn("high", F.col("high") - 20).where(normalize.ohlc_valid()).select("instrument_id", "ts_utc")
)
query("typical_price", f"WITH b AS ({HOUR}) SELECT {KEYS}, round((high + low + close) / 3, 6) AS tp FROM b")(lambda s, d: bars(s, d).select("instrument_id", "ts_utc", ta.typical().alias("tp")))
query("is_partial", f"WITH b AS ({HOUR}) SELECT {KEYS}, ts_utc + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20 10:30' AS is_partial FROM b")(
    lambda s, d: bars(s, d).select("instrument_id", "ts_utc", (F.col("ts_utc") + F.expr("INTERVAL 1 HOUR") > F.expr("TIMESTAMP '2024-01-20 10:30'")).alias("is_partial"))
)
query(
    "vendor_ts_to_utc",
    f"""WITH b AS ({DAY}) SELECT {KEYS}, CASE WHEN instrument_id = 'click' THEN ts_utc WHEN instrument_id = 'view'
  THEN (ts_utc AT TIME ZONE 'Asia/Kolkata') AT TIME ZONE 'UTC' ELSE ((date_trunc('day', ts_utc) + INTERVAL '9 hours 30 minutes') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS utc FROM b""",
)(
    lambda s, d: bars(s, d, "day")
    .withColumn("kind", F.expr("CASE instrument_id WHEN 'click' THEN 'utc' WHEN 'view' THEN 'naive_session' ELSE 'session_date' END"))
    .withColumn("zone", F.expr("CASE instrument_id WHEN 'view' THEN 'Asia/Kolkata' ELSE 'America/New_York' END"))
    .withColumn("cls", F.lit("equity"))
    .select("instrument_id", "ts_utc", normalize.to_utc("ts_utc", "kind", "zone", "cls").alias("utc"))
)


@query(
    "repair_level_glitch",
    f"""WITH b AS ({DAY}), s AS (SELECT {KEYS}, day(ts_utc) AS n, 100 + close / 100 AS px, volume FROM b),
g AS (SELECT *, px * CASE WHEN n % 13 = 7 THEN 0.1 ELSE 1 END AS c FROM s),
m AS (SELECT *, median(c) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p, median(c) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS q FROM g),
k AS (SELECT *, CASE WHEN c / p BETWEEN 0.07 AND 0.13 AND c / q BETWEEN 0.07 AND 0.13 THEN 10.0 WHEN c / p BETWEEN 1 / 0.13 AND 1 / 0.07 AND c / q BETWEEN 1 / 0.13 AND 1 / 0.07 THEN 0.1 ELSE 1.0 END AS k FROM m)
SELECT {KEYS}, {r6(close='c * k', volume='volume / k')} FROM k""",
)
def _(s, d):
    rows = bars(s, d, "day").withColumn("close", (F.lit(100) + F.col("close") / 100) * F.when(F.dayofmonth("ts_utc") % 13 == 7, 0.1).otherwise(1.0))
    for c in ("open", "high", "low"):
        rows = rows.withColumn(c, F.col("close"))
    return normalize.repair_levels(rows).select("instrument_id", "ts_utc", "close", "volume")


query(
    "resample_ohlcv",
    f"WITH b AS ({HOUR}) SELECT instrument_id, min(ts_utc) AS ts_utc, {r6(open='arg_min(open, ts_utc)', high='max(high)', low='min(low)', close='arg_max(close, ts_utc)', volume='sum(volume)')}, '4h' AS timeframe FROM b GROUP BY instrument_id, time_bucket(INTERVAL 4 HOUR, ts_utc)",
)(lambda s, d: resample.resample(bars(s, d), "4h"))
query(
    "resample_ohlcv_tz",
    f"""WITH b AS (SELECT *, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS l FROM ({HOUR})) SELECT instrument_id, min(ts_utc) AS ts_utc,
  {r6(open='arg_min(open, ts_utc)', high='max(high)', low='min(low)', close='arg_max(close, ts_utc)', volume='sum(volume)')}, '1d' AS timeframe, date_trunc('day', l)::TIMESTAMP AS ts_local, 330::INT AS utc_offset FROM b GROUP BY instrument_id, date_trunc('day', l)""",
)(lambda s, d: resample.resample(bars(s, d), "1d", "Asia/Kolkata"))
query(
    "tz_projection",
    f"WITH b AS ({HOUR}) SELECT {KEYS}, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ts_local, date_diff('minute', ts_utc, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::INT AS utc_offset FROM b",
)(lambda s, d: resample.with_local(bars(s, d), "America/New_York").select("instrument_id", "ts_utc", "ts_local", "utc_offset"))

# --- windows ------------------------------------------------------------------------------------------------------

indicator("win_group_idx", lambda b: b.withColumn("idx", wf.row()), ["idx"], f"SELECT {KEYS}, (row_number() OVER ({W}) - 1)::INT AS idx FROM bars")
indicator("win_shift", lambda b: b.withColumn("prior", wf.shift("close", 3)), ["prior"], f"SELECT {KEYS}, round({lag('close', 3)}, 6) AS prior FROM bars")
indicator(
    "win_rolling",
    lambda b: b.withColumn("m", wf.mean("close", 10)).withColumn("s", wf.total("volume", 10)).withColumn("lo", wf.lowest("low", 10)).withColumn("hi", wf.highest("high", 10)),
    ["m", "s", "lo", "hi"],
    f"SELECT {KEYS}, {r6(m=over('avg(close)', 10, 'close'), s=over('sum(volume)', 10, 'volume'), lo=over('min(low)', 10, 'low'), hi=over('max(high)', 10, 'high'))} FROM bars",
)
indicator(
    "win_rolling_std",
    lambda b: b.withColumn("p", wf.deviation("close", 10)).withColumn("q", wf.deviation("close", 10, 1)),
    ["p", "q"],
    f"SELECT {KEYS}, {r6(p=over('stddev_pop(close)', 10, 'close'), q=over('stddev_samp(close)', 10, 'close'))} FROM bars",
)
indicator(
    "win_rolling_median",
    lambda b: b.withColumn("med", wf.median("close", 21, 5)),
    ["med"],
    f"SELECT {KEYS}, round(CASE WHEN count(close) OVER f >= 5 THEN median(close) OVER f END, 6) AS med FROM bars WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)",
)
indicator(
    "win_ffill",
    lambda b: b.withColumn("x", F.when(F.col("volume") > 2, F.col("close"))).withColumn("x", wf.filled("x")),
    ["x"],
    f"SELECT {KEYS}, round({over('last_value(CASE WHEN volume > 2 THEN close END IGNORE NULLS)')}, 6) AS x FROM bars",
)
indicator("bars_per_year", lambda b: b.withColumn("n", F.count("close").over(Window.partitionBy("instrument_id").orderBy(F.datediff("ts_utc", F.lit("2020-01-01"))).rangeBetween(-6, 0))), ["n"],
    f"SELECT {KEYS}, count(close) OVER (PARTITION BY instrument_id ORDER BY date_diff('day', DATE '2020-01-01', ts_utc::DATE) RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS n FROM bars")

# --- indicators ---------------------------------------------------------------------------------------------------

TP = "(high + low + close) / 3"
TR = f"CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
HH, LL = over("max(high)", 14, "high"), over("min(low)", 14, "low")
indicator("ta_sma", ta.sma, ["sma"], f"SELECT {KEYS}, round({over('avg(close)', 20, 'close')}, 6) AS sma FROM bars")
indicator("ta_wma", lambda b: ta.wma(b, 5), ["wma"], f"SELECT {KEYS}, round((close * 5 + {lag('close', 1)} * 4 + {lag('close', 2)} * 3 + {lag('close', 3)} * 2 + {lag('close', 4)}) / 15, 6) AS wma FROM bars")
indicator("ta_true_range", lambda b: b.withColumn("tr", ta.true_range()), ["tr"], f"SELECT {KEYS}, round({TR}, 6) AS tr FROM bars")
indicator(
    "ta_aroon",
    ta.aroon,
    ["aroon_up", "aroon_down"],
    f"""SELECT {KEYS}, round(CASE WHEN len(h) = 25 THEN 100.0 * (26 - list_position(list_reverse(h), list_max(h))) / 25 END, 6) AS aroon_up, round(CASE WHEN len(h) = 25 THEN 100.0 * (26 - list_position(list_reverse(l), list_min(l))) / 25 END, 6) AS aroon_down
FROM (SELECT {KEYS}, list(high) OVER f AS h, list(low) OVER f AS l FROM bars WINDOW f AS ({W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))""",
)
indicator(
    "ta_stoch",
    ta.stoch,
    ["stoch_k", "stoch_d"],
    f"SELECT {KEYS}, round(k, 6) AS stoch_k, round({over('avg(k)', 3, 'k')}, 6) AS stoch_d FROM (SELECT {KEYS}, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM (SELECT *, {HH} AS hi, {LL} AS lo FROM bars))",
)
indicator(
    "ta_cci",
    ta.cci,
    ["cci"],
    f"""SELECT {KEYS}, round((tp - m) / nullif(0.015 * list_sum(list_transform(w, lambda v: abs(v - m))) / 20, 0), 6) AS cci FROM
(SELECT {KEYS}, tp, {over('avg(tp)', 20, 'tp')} AS m, list(tp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS w FROM (SELECT *, {TP} AS tp FROM bars))""",
)
indicator("ta_willr", ta.willr, ["willr"], f"SELECT {KEYS}, round(-100 * (hi - close) / nullif(hi - lo, 0), 6) AS willr FROM (SELECT *, {HH} AS hi, {LL} AS lo FROM bars)")
indicator("ta_roc", ta.roc, ["roc"], f"SELECT {KEYS}, round(100 * (close - {lag('close', 10)}) / nullif({lag('close', 10)}, 0), 6) AS roc FROM bars")
indicator("ta_mom", ta.mom, ["mom"], f"SELECT {KEYS}, round(close - {lag('close', 10)}, 6) AS mom FROM bars")
indicator(
    "ta_bbands",
    ta.bbands,
    ["bb_mid", "bb_upper", "bb_lower", "percent_b", "bb_width"],
    f"""SELECT {KEYS}, {r6(bb_mid='m', bb_upper='m + s', bb_lower='m - s', percent_b='(close - (m - s)) / nullif(2 * s, 0)', bb_width='2 * s / nullif(m, 0)')} FROM
(SELECT {KEYS}, close, {over('avg(close)', 20, 'close')} AS m, 2 * {over('stddev_pop(close)', 20, 'close').replace('CASE', '(CASE', 1)}) AS s FROM bars)""",
)
indicator("ta_donchian", ta.donchian, ["dc_upper", "dc_lower", "dc_mid"], f"SELECT {KEYS}, {r6(dc_upper='hi', dc_lower='lo', dc_mid='(hi + lo) / 2')} FROM (SELECT {KEYS}, {over('max(high)', 20, 'high')} AS hi, {over('min(low)', 20, 'low')} AS lo FROM bars)")
indicator("ta_stdev", ta.stdev, ["stdev"], f"SELECT {KEYS}, round({over('stddev_pop(close)', 20, 'close')}, 6) AS stdev FROM bars")
indicator("ta_obv", ta.obv, ["obv"], f"SELECT {KEYS}, round({over('sum(v)')}, 6) AS obv FROM (SELECT {KEYS}, CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END AS v FROM bars)")
indicator(
    "ta_mfi",
    ta.mfi,
    ["mfi"],
    f"""SELECT {KEYS}, round(CASE WHEN p = 0 AND n = 0 THEN NULL WHEN n = 0 THEN 100 ELSE 100 - 100 / (1 + p / n) END, 6) AS mfi FROM (SELECT {KEYS}, {over('sum(p)', 14, 'p')} AS p, {over('sum(n)', 14, 'n')} AS n FROM
(SELECT {KEYS}, CASE WHEN d > 0 THEN tp * volume WHEN d <= 0 THEN 0 END AS p, CASE WHEN d < 0 THEN tp * volume WHEN d >= 0 THEN 0 END AS n FROM (SELECT *, tp - lag(tp) OVER ({W}) AS d FROM (SELECT *, {TP} AS tp FROM bars))))""",
)
indicator(
    "ta_cmf",
    ta.cmf,
    ["cmf"],
    f"SELECT {KEYS}, round({over('sum(f)', 20, 'f').replace('CASE', '(CASE', 1)}) / nullif(({over('sum(volume)', 20, 'volume')}), 0), 6) AS cmf FROM (SELECT *, CASE WHEN high = low THEN 0 ELSE (2 * close - low - high) / (high - low) END * volume AS f FROM bars)",
)
for _name, _zone in (("ta_vwap", None), ("ta_vwap_session", "America/New_York")):
    _day = "ts_utc::DATE" if _zone is None else f"((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE '{_zone}')::DATE"
    _f = f"OVER (PARTITION BY instrument_id, {_day} ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    indicator(_name, lambda b, z=_zone: ta.vwap(b, z), ["vwap"], f"SELECT {KEYS}, round(sum({TP} * volume) {_f} / nullif(sum(volume) {_f}, 0), 6) AS vwap FROM bars")


def _pivot_sql(x: str, sign: str) -> str:
    tests = " AND ".join(f"{lag(x, 2)} {sign} {lag(x, k) if k else x}" for k in (0, 1, 3, 4))
    return f"CASE WHEN row_number() OVER ({W}) > 4 THEN {tests} END"


indicator("ta_swing_high", ta.swing_high, ["swing_high"], f"SELECT {KEYS}, {_pivot_sql('high', '>')} AS swing_high FROM bars")
indicator("ta_swing_low", ta.swing_low, ["swing_low"], f"SELECT {KEYS}, {_pivot_sql('low', '<')} AS swing_low FROM bars")
_SWINGS = f"""flags AS (SELECT *, {_pivot_sql('high', '>')} AS a, {_pivot_sql('low', '<')} AS b, {lag('high', 2)} AS ph, {lag('low', 2)} AS pl FROM bars),
clean AS (SELECT *, a AND NOT (a AND b) AS sh, b AND NOT (a AND b) AS sl FROM flags),
prior AS (SELECT *, last_value(CASE WHEN sh THEN ph END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS oh, last_value(CASE WHEN sl THEN pl END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ol FROM clean)
SELECT {KEYS}, sh AS swing_high, sl AS swing_low, CASE WHEN sh THEN CASE WHEN oh IS NULL THEN 'H' WHEN ph > oh THEN 'HH' WHEN ph < oh THEN 'LH' ELSE 'EH' END
  WHEN sl THEN CASE WHEN ol IS NULL THEN 'L' WHEN pl > ol THEN 'HL' WHEN pl < ol THEN 'LL' ELSE 'EL' END END AS swing_label FROM prior"""
query("ta_swings", f"WITH bars AS ({HOUR}), {_SWINGS}")(lambda s, d: ta.swings(bars(s, d)).select("instrument_id", "ts_utc", "swing_high", "swing_low", "swing_label"))
query("ta_swing_labels", f"WITH bars AS ({HOUR}), {_SWINGS}".replace("sh AS swing_high, sl AS swing_low, ", ""))(lambda s, d: ta.swings(bars(s, d)).select("instrument_id", "ts_utc", "swing_label"))


def ewm(name: str, source: str, x: str, skip: int, n: int, alpha: float) -> str:
    """CTEs: ``name`` has (instrument_id, rn, y), the exponential mean of x from ``source`` (with rn), whose first ``skip`` rows are null."""
    return f"""{name} AS (SELECT instrument_id, {skip + n}::BIGINT AS rn, avg({x}) AS y FROM {source} WHERE rn BETWEEN {skip + 1} AND {skip + n} GROUP BY 1 HAVING count(*) = {n}
UNION ALL SELECT s.instrument_id, s.rn, {alpha!r} * s.{x} + {1 - alpha!r} * e.y FROM {name} e JOIN {source} s ON s.instrument_id = e.instrument_id AND s.rn = e.rn + 1)"""


_RN = f"r AS (SELECT *, row_number() OVER ({W}) AS rn, {TR} AS tr, close - {lag('close')} AS dc, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM bars)"


def recurrence(name: str, add, columns: list[str], ctes: list[str], select: str, on: list[str]) -> None:
    joined = " ".join(f"LEFT JOIN {t} ON {t}.instrument_id = r.instrument_id AND {t}.rn = r.rn" for t in on)
    query(name, f"WITH RECURSIVE bars AS ({HOUR}), {_RN}, {', '.join(ctes)} SELECT r.instrument_id, r.ts_utc, {select} FROM r {joined}")(lambda s, d: add(bars(s, d)).select("instrument_id", "ts_utc", *columns))


recurrence("ta_ema", rec.with_ema, ["ema"], [ewm("e", "r", "close", 0, 20, 2 / 21)], "round(e.y, 6) AS ema", ["e"])
recurrence("ta_rma", rec.with_rma, ["rma"], [ewm("e", "r", "close", 0, 14, 1 / 14)], "round(e.y, 6) AS rma", ["e"])
recurrence("ta_atr", rec.with_atr, ["atr"], [ewm("e", "r", "tr", 0, 14, 1 / 14)], "round(e.y, 6) AS atr", ["e"])
recurrence(
    "ta_macd",
    rec.with_macd,
    ["macd", "macd_signal", "macd_hist"],
    [ewm("f", "r", "close", 0, 12, 2 / 13), ewm("w", "r", "close", 0, 26, 2 / 27), "m AS (SELECT f.instrument_id, f.rn, f.y - w.y AS x FROM f JOIN w ON f.instrument_id = w.instrument_id AND f.rn = w.rn)", ewm("g", "m", "x", 25, 9, 2 / 10)],
    r6(macd="m.x", macd_signal="g.y", macd_hist="m.x - g.y"),
    ["m", "g"],
)
_RSI = ["d AS (SELECT instrument_id, rn, greatest(dc, 0) AS up, greatest(-dc, 0) AS dn FROM r WHERE rn > 1)", ewm("g", "d", "up", 1, 14, 1 / 14), ewm("l", "d", "dn", 1, 14, 1 / 14),
    "v AS (SELECT g.instrument_id, g.rn, CASE WHEN l.y = 0 THEN CASE WHEN g.y = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g.y / l.y) END AS x FROM g JOIN l ON g.instrument_id = l.instrument_id AND g.rn = l.rn)"]
recurrence("ta_rsi", rec.with_rsi, ["rsi"], _RSI, "round(v.x, 6) AS rsi", ["v"])
_F = "OVER (PARTITION BY instrument_id ORDER BY rn ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
recurrence(
    "ta_stoch_rsi",
    rec.with_stoch_rsi,
    ["stoch_rsi_k", "stoch_rsi_d"],
    [*_RSI, f"k AS (SELECT instrument_id, rn, CASE WHEN count(x) {_F.format(13)} = 14 THEN 100 * (x - min(x) {_F.format(13)}) / nullif(max(x) {_F.format(13)} - min(x) {_F.format(13)}, 0) END AS k FROM v)",
     f"sd AS (SELECT instrument_id, rn, k, CASE WHEN count(k) {_F.format(2)} = 3 THEN avg(k) {_F.format(2)} END AS d FROM k)"],
    r6(stoch_rsi_k="sd.k", stoch_rsi_d="sd.d"),
    ["sd"],
)
recurrence(
    "ta_adx",
    rec.with_adx,
    ["adx", "plus_di", "minus_di"],
    ["d AS (SELECT instrument_id, rn, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM r WHERE rn > 1)",
     ewm("a", "r", "tr", 0, 14, 1 / 14), ewm("p", "d", "p", 1, 14, 1 / 14), ewm("m", "d", "m", 1, 14, 1 / 14),
     "di AS (SELECT a.instrument_id, a.rn, 100 * p.y / nullif(a.y, 0) AS p, 100 * m.y / nullif(a.y, 0) AS m FROM a JOIN p ON a.instrument_id = p.instrument_id AND a.rn = p.rn JOIN m ON a.instrument_id = m.instrument_id AND a.rn = m.rn)",
     "dx AS (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS x FROM di)", ewm("x", "dx", "x", 14, 14, 1 / 14)],
    r6(adx="x.y", plus_di="di.p", minus_di="di.m"),
    ["di", "x"],
)
recurrence("ta_keltner", rec.with_keltner, ["kc_mid", "kc_upper", "kc_lower"], [ewm("e", "r", "close", 0, 20, 2 / 21), ewm("a", "r", "tr", 0, 20, 1 / 20)], r6(kc_mid="e.y", kc_upper="e.y + 2 * a.y", kc_lower="e.y - 2 * a.y"), ["e", "a"])
recurrence(
    "ta_supertrend",
    rec.with_supertrend,
    ["supertrend", "st_direction"],
    [ewm("a", "r", "tr", 0, 10, 1 / 10), "b AS (SELECT r.instrument_id, r.rn, r.close AS c, (high + low) / 2 + 3 * a.y AS u, (high + low) / 2 - 3 * a.y AS d FROM r JOIN a ON a.instrument_id = r.instrument_id AND a.rn = r.rn)",
     """s AS (SELECT instrument_id, rn, c, u, d, CASE WHEN c <= u THEN -1 ELSE 1 END AS t FROM b WHERE rn = 10
UNION ALL SELECT instrument_id, rn, c, u, d, CASE WHEN t < 0 THEN CASE WHEN c > u THEN 1 ELSE -1 END ELSE CASE WHEN c < d THEN -1 ELSE 1 END END FROM
(SELECT b.instrument_id, b.rn, b.c, CASE WHEN b.u < s.u OR s.c > s.u THEN b.u ELSE s.u END AS u, CASE WHEN b.d > s.d OR s.c < s.d THEN b.d ELSE s.d END AS d, s.t FROM s JOIN b ON b.instrument_id = s.instrument_id AND b.rn = s.rn + 1))"""],
    "round(CASE WHEN s.t > 0 THEN s.d ELSE s.u END, 6) AS supertrend, s.t::DOUBLE AS st_direction",
    ["s"],
)
recurrence(
    "ta_ewm_std",
    rec.with_ewm_std,
    ["ewm_std"],
    [f"""w AS (SELECT instrument_id, rn, close AS x, close AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS s2 FROM r WHERE rn = 1
UNION ALL SELECT r.instrument_id, r.rn, r.close, w.m + {1 - 0.5 ** 0.1!r} * (r.close - w.m), {0.5 ** 0.1!r} * (w.v + {1 - 0.5 ** 0.1!r} * (r.close - w.m) * (r.close - w.m)), {(0.5 ** 0.1) ** 2!r} * w.s2 + {(1 - 0.5 ** 0.1) ** 2!r}
FROM w JOIN r ON r.instrument_id = w.instrument_id AND r.rn = w.rn + 1)"""],
    "round(CASE WHEN r.rn > 1 THEN sqrt(w.v / (1 - w.s2)) END, 6) AS ewm_std",
    ["w"],
)

# --- joins and intervals ------------------------------------------------------------------------------------------

query("align_native", f"WITH b AS ({HOUR}) SELECT {KEYS}, round(close, 6) AS close FROM b WHERE ts_utc IN (SELECT ts_utc FROM b GROUP BY 1 HAVING count(DISTINCT instrument_id) = 5)")(
    lambda s, d: joins.align(bars(s, d), 5).select("instrument_id", "ts_utc", "close")
)
query("drop_dead_stamps", f"WITH b AS ({PX_SMOOTH_SQL}), c AS (SELECT {KEYS}, CASE WHEN day(ts_utc) % 3 > 0 THEN close END AS close FROM b) SELECT {KEYS}, round(close, 6) AS close FROM c WHERE ts_utc IN (SELECT ts_utc FROM c GROUP BY 1 HAVING count(close) > 0)")(
    lambda s, d: joins.drop_dead_stamps(px_smooth(s, d).select("instrument_id", "ts_utc", F.when(F.dayofmonth("ts_utc") % 3 > 0, F.col("close")).alias("close")))
)
_QUOTES = "q AS (SELECT ts_utc, avg(close) AS fx FROM b WHERE instrument_id = 'click' AND volume > 2 GROUP BY 1)"
query(
    "asof_fx",
    f"WITH b AS ({HOUR}), {_QUOTES} SELECT b.instrument_id, b.ts_utc, round(q.fx, 6) AS fx, round(CASE WHEN q.fx <> 0 THEN b.close / q.fx ELSE b.close END, 6) AS close FROM b ASOF LEFT JOIN q ON b.ts_utc >= q.ts_utc WHERE b.instrument_id <> 'click'",
)(lambda s, d: _asof(bars(s, d)).withColumn("close", F.when(F.col("fx").isNotNull() & (F.col("fx") != 0), F.col("close") / F.col("fx")).otherwise(F.col("close"))).select("instrument_id", "ts_utc", "fx", "close"))


def _asof(b: DataFrame) -> DataFrame:
    quotes = b.where("instrument_id = 'click' AND volume > 2").groupBy("ts_utc").agg(F.avg("close").alias("fx"))
    return joins.asof_backward(b.where("instrument_id <> 'click'"), quotes, "ts_utc", "fx")


_COVER = """cov AS (SELECT event_type AS instrument_id, date_trunc('minute', ts) AS start_utc, date_trunc('minute', ts) + INTERVAL 20 MINUTE AS end_utc FROM events GROUP BY ALL)"""


def _cover(s: SparkSession, d: str) -> DataFrame:
    """Twenty minutes from the minute of each event."""
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("instrument_id"), F.date_trunc("minute", "ts").alias("start_utc")).distinct()
    return rows.withColumn("end_utc", F.col("start_utc") + F.expr("INTERVAL 20 MINUTE"))


_MERGED = f"""{_COVER}, n AS (SELECT *, CASE WHEN start_utc <= max(end_utc) OVER (PARTITION BY instrument_id ORDER BY start_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 MICROSECOND THEN 0 ELSE 1 END AS fresh FROM cov),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument_id ORDER BY start_utc) AS island FROM n), merged AS (SELECT instrument_id, min(start_utc) AS start_utc, max(end_utc) AS end_utc FROM g GROUP BY instrument_id, island)"""
query("coverage_merge", f"WITH {_MERGED} SELECT * FROM merged")(lambda s, d: intervals.merge(_cover(s, d), "instrument_id"))
query("coverage_span", f"WITH {_COVER} SELECT instrument_id, min(start_utc) AS start_utc, max(end_utc) AS end_utc FROM cov GROUP BY 1")(lambda s, d: _cover(s, d).groupBy("instrument_id").agg(F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc")))
query(
    "coverage_subtract",
    f"""WITH {_MERGED}, c AS (SELECT *, TIMESTAMP '2024-01-10' AS a, TIMESTAMP '2024-01-12' AS b FROM merged) SELECT instrument_id, start_utc, end_utc FROM c WHERE NOT (start_utc <= b AND end_utc >= a)
UNION ALL SELECT instrument_id, start_utc, a - INTERVAL 1 MICROSECOND FROM c WHERE start_utc <= b AND end_utc >= a AND start_utc < a UNION ALL SELECT instrument_id, b + INTERVAL 1 MICROSECOND, end_utc FROM c WHERE start_utc <= b AND end_utc >= a AND end_utc > b""",
)(
    lambda s, d: intervals.subtract(
        intervals.merge(_cover(s, d), "instrument_id"), _cover(s, d).select("instrument_id").distinct().selectExpr("instrument_id", "TIMESTAMP '2024-01-10' AS cut_start", "TIMESTAMP '2024-01-12' AS cut_end"), "instrument_id"
    )
)
_HOLES = f"""{_MERGED}, m AS (SELECT *, lead(start_utc) OVER (PARTITION BY instrument_id ORDER BY start_utc) AS nxt, row_number() OVER (PARTITION BY instrument_id ORDER BY start_utc) AS rn FROM merged WHERE start_utc < TIMESTAMP '2024-01-20' AND end_utc >= TIMESTAMP '2024-01-05'),
h AS (SELECT instrument_id, TIMESTAMP '2024-01-05' AS s, start_utc AS e FROM m WHERE rn = 1 UNION ALL SELECT instrument_id, end_utc + INTERVAL 1 MICROSECOND, coalesce(nxt, TIMESTAMP '2024-01-20') FROM m),
holes AS (SELECT instrument_id, s AS start_utc, e AS end_utc FROM h WHERE s < e)"""
query("coverage_holes", f"WITH {_HOLES} SELECT * FROM holes")(lambda s, d: _holes(s, d))


def _holes(s: SparkSession, d: str) -> DataFrame:
    cover = _cover(s, d)
    wanted = cover.select("instrument_id").distinct().selectExpr("instrument_id", "TIMESTAMP '2024-01-05' AS want_start", "TIMESTAMP '2024-01-20' AS want_end")
    return intervals.holes(cover, wanted, "instrument_id")


_SESS = "sess AS (SELECT t + INTERVAL '14 hours 30 minutes' AS o, t + INTERVAL 21 HOUR AS c FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS t) WHERE isodow(t) < 6)"
query("interval_overlap", f"WITH {_HOLES}, {_SESS} SELECT instrument_id, greatest(start_utc, o) AS start_utc, least(end_utc, c) AS end_utc FROM holes, sess WHERE start_utc < c AND o < end_utc")(lambda s, d: _overlap(s, d))


def _overlap(s: SparkSession, d: str) -> DataFrame:
    days = calendar.sessions(s, date(2024, 1, 1), date(2024, 1, 31), set()).withColumn("t", F.col("session_date").cast("timestamp"))
    windows = days.select((F.col("t") + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("b_start"), (F.col("t") + F.expr("INTERVAL 21 HOUR")).alias("b_end"))
    return intervals.overlap(_holes(s, d).withColumnsRenamed({"start_utc": "a_start", "end_utc": "a_end"}), windows).select("instrument_id", "start_utc", "end_utc")


query("needed_ranges", f"WITH {_HOLES}, {_SESS}, x AS (SELECT instrument_id, greatest(start_utc, o) AS s, least(end_utc, c) AS e FROM holes, sess WHERE start_utc < c AND o < end_utc) SELECT instrument_id, s AS start_utc, e AS end_utc FROM x")(
    lambda s, d: intervals.merge(_overlap(s, d), "instrument_id", touch_micro=False)
)
query("missing_coverage", f"WITH {_COVER} SELECT DISTINCT event_type AS instrument_id FROM events WHERE event_type NOT IN (SELECT instrument_id FROM cov WHERE instrument_id <> 'view')")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("instrument_id")).distinct().join(_cover(s, d).where("instrument_id <> 'view'"), "instrument_id", "left_anti")
)
query("coalesce_holes", f"WITH {_HOLES} SELECT instrument_id, min(start_utc) AS start_utc, max(end_utc) AS end_utc FROM holes GROUP BY 1")(
    lambda s, d: _holes(s, d).groupBy("instrument_id").agg(F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"))
)
_MISS = "w AS (SELECT instrument_id, unnest(generate_series(min(ts_utc), max(ts_utc), INTERVAL 1 HOUR)) AS ts_utc FROM b GROUP BY 1), miss AS (SELECT * FROM w ANTI JOIN b USING (instrument_id, ts_utc))"
query("gap_detect", f"WITH b AS ({HOUR}), {_MISS} SELECT * FROM miss")(lambda s, d: inspect.missing_opens(bars(s, d), _span(bars(s, d)), 60))
query("expected_opens", f"WITH b AS ({HOUR}), {_MISS} SELECT * FROM w")(lambda s, d: inspect.expected_opens(_span(bars(s, d)), 60))


def _span(b: DataFrame) -> DataFrame:
    """From each name's first bar to its last."""
    return b.groupBy("instrument_id").agg(F.min("ts_utc").alias("start_utc"), (F.max("ts_utc") + F.expr("INTERVAL 1 HOUR")).alias("end_utc"))


_SPANS = f"{_MISS}, sp AS (SELECT *, ts_utc - (row_number() OVER ({W})) * INTERVAL 1 HOUR AS g FROM miss), spans AS (SELECT instrument_id, min(ts_utc) AS ts_utc, max(ts_utc) + INTERVAL 1 HOUR AS end_utc, count(*) AS n_missing FROM sp GROUP BY instrument_id, g)"
query("gap_spans", f"WITH b AS ({HOUR}), {_SPANS} SELECT * FROM spans")(lambda s, d: inspect.gap_spans(inspect.missing_opens(bars(s, d), _span(bars(s, d)), 60), 60))
_FLAGS = "CASE WHEN high > 480 THEN 'suspect' ELSE 'ok' END AS quality, ts_utc >= TIMESTAMP '2024-01-30 22:00' AS is_partial, volume - 1 AS v0"
_POINTS = "pts AS (SELECT instrument_id, 'suspect' AS kind, ts_utc FROM fl WHERE quality = 'suspect' UNION ALL SELECT instrument_id, 'partial', ts_utc FROM fl WHERE is_partial UNION ALL SELECT instrument_id, 'zero_volume', ts_utc FROM fl WHERE v0 <= 0)"
query("point_flags", f"WITH b AS ({HOUR}), fl AS (SELECT *, {_FLAGS} FROM b), {_POINTS} SELECT * FROM pts")(lambda s, d: inspect.point_flags(_flagged(bars(s, d))))


def _flagged(b: DataFrame) -> DataFrame:
    return b.selectExpr("instrument_id", "ts_utc", "open", "high", "low", "close", "CASE WHEN high > 480 THEN 'suspect' ELSE 'ok' END AS quality", "ts_utc >= TIMESTAMP '2024-01-30 22:00' AS is_partial", "volume - 1 AS volume")


_SPIKES = f"""rg AS (SELECT {KEYS}, high - low AS r, count(*) OVER (PARTITION BY instrument_id) AS n, count(*) OVER f AS k, median(high - low) OVER f AS m FROM b WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
spk AS (SELECT instrument_id, ts_utc, 'spike' AS kind FROM rg WHERE n >= 21 AND k >= 5 AND m > 0 AND r > 8 * m)"""
query("spike_flags", f"WITH b AS ({HOUR}), {_SPIKES} SELECT * FROM spk")(lambda s, d: inspect.spikes(bars(s, d)))
query(
    "find_problems",
    f"WITH b AS ({HOUR}), {_SPANS}, fl AS (SELECT *, {_FLAGS} FROM b), {_POINTS}, {_SPIKES} SELECT instrument_id, 'gap' AS kind, ts_utc, end_utc FROM spans UNION ALL SELECT instrument_id, kind, ts_utc, NULL FROM pts UNION ALL SELECT instrument_id, kind, ts_utc, NULL FROM spk",
)(lambda s, d: inspect.find_problems(_flagged(bars(s, d)), _span(bars(s, d)), 60))

# --- calendars ----------------------------------------------------------------------------------------------------

#: Full-day holidays of 2024, as the exchanges published them; the first list also tests the rules in ``calendar``.
NYSE_2024 = ("2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25")
NSE_2024 = (
    "2024-01-22", "2024-01-26", "2024-03-08", "2024-03-25", "2024-03-29", "2024-04-11", "2024-04-17", "2024-05-01", "2024-05-20", "2024-06-17", "2024-07-17", "2024-08-15", "2024-10-02", "2024-11-01", "2024-11-15", "2024-11-20", "2024-12-25",
)
_HOL, _NSE_HOL = (", ".join(f"DATE '{x}'" for x in days) for days in (NYSE_2024, NSE_2024))
query("session_dates", f"SELECT t::DATE AS session_date FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS t) WHERE isodow(t) < 6 AND t::DATE NOT IN ({_HOL})")(
    lambda s, d: calendar.sessions(s, date(2024, 1, 1), date(2024, 12, 31))
)
for _name, _grid, _zone, _o, _c, _off, _days in (
    ("decision_grid_nyse", calendar.nyse_grid, "America/New_York", "09:30:00", "16:00:00", _HOL, None),
    ("decision_grid_nse", calendar.nse_grid, "Asia/Kolkata", "09:15:00", "15:30:00", _NSE_HOL, {date.fromisoformat(x) for x in NSE_2024}),
):
    query(
        _name,
        f"SELECT d AS session_date, ((d + TIME '{_o}') AT TIME ZONE '{_zone}') AT TIME ZONE 'UTC' AS open_utc, ((d + TIME '{_c}') AT TIME ZONE '{_zone}') AT TIME ZONE 'UTC' AS decision_ts FROM (SELECT t::DATE AS d FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS t) WHERE isodow(t) < 6 AND t::DATE NOT IN ({_off}))",
    )(lambda s, d, g=_grid, off=_days: g(calendar.sessions(s, date(2024, 1, 1), date(2024, 12, 31), off)))
query("session_flags", f"WITH b AS ({DAY}) SELECT {KEYS}, instrument_id <> 'click' OR (isodow(ts_utc) < 6 AND ts_utc::DATE NOT IN ({_HOL})) AS is_session FROM b")(
    lambda s, d: calendar.session_flags(
        bars(s, d, "day").withColumn("calendar", F.expr("CASE instrument_id WHEN 'click' THEN 'NYSE' ELSE 'native_24_7' END")), s.createDataFrame([(x,) for x in sorted(calendar.nyse_holidays(2024))], "session_date date")
    ).select("instrument_id", "ts_utc", "is_session")
)
_LOCAL = "(ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"
query(
    "period_ends",
    f"WITH b AS (SELECT DISTINCT ts_utc FROM ({PX_DAILY_SQL})), p AS (SELECT ts_utc, date_trunc('quarter', {_LOCAL})::DATE AS period FROM b), n AS (SELECT *, lead(period) OVER (ORDER BY ts_utc) AS nxt FROM p) SELECT ts_utc, period FROM n WHERE nxt <> period",
)(lambda s, d: calendar.period_ends(px_daily(s, d), "quarter"))

# --- strategies, broker and metrics -------------------------------------------------------------------------------

query("names_per_stamp", f"WITH b AS ({HOUR}) SELECT {KEYS}, count(*) OVER (PARTITION BY ts_utc) AS n_names FROM b")(lambda s, d: strategies.names_per_stamp(bars(s, d)).select("instrument_id", "ts_utc", "n_names"))
query("strat_buy_hold", f"WITH b AS ({HOUR}) SELECT {KEYS}, round(1.0 / count(*) OVER (PARTITION BY ts_utc), 6) AS weight FROM b")(lambda s, d: strategies.buy_hold(bars(s, d)))
query("strat_static", f"WITH b AS ({HOUR}) SELECT {KEYS}, CASE instrument_id WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.4 ELSE 0 END::DOUBLE AS weight FROM b")(lambda s, d: strategies.static(bars(s, d), {"click": 0.6, "view": 0.4}))
query(
    "strat_sma_cross",
    f"WITH b AS ({HOUR}), m AS (SELECT {KEYS}, {over('avg(close)', 5, 'close')} AS f, {over('avg(close)', 20, 'close')} AS s, count(*) OVER (PARTITION BY ts_utc) AS n FROM b) SELECT {KEYS}, round(CASE WHEN f > s THEN 1.0 WHEN f < s THEN -1.0 WHEN f = s THEN 0.0 END / n, 6) AS weight FROM m",
)(lambda s, d: strategies.sma_cross(bars(s, d), 5, 20))
query(
    "strat_periodic",
    f"""WITH b AS ({PX_DAILY_SQL}), t AS (SELECT DISTINCT ts_utc FROM b), p AS (SELECT ts_utc, date_trunc('quarter', {_LOCAL}) AS q, lead(date_trunc('quarter', {_LOCAL})) OVER (ORDER BY ts_utc) AS nq FROM t),
x AS (SELECT ts_utc FROM p WHERE q <> nq UNION SELECT min(ts_utc) FROM t) SELECT {KEYS}, CASE WHEN ts_utc IN (SELECT ts_utc FROM x) THEN CASE instrument_id WHEN '1-URGENT' THEN 0.7 ELSE 0 END END::DOUBLE AS weight FROM b""",
)(lambda s, d: strategies.periodic(px_daily(s, d), {"1-URGENT": 0.7}))
query(
    "strat_guard",
    f"""WITH RECURSIVE b AS ({DAY}), g AS (SELECT ts_utc, close, row_number() OVER (ORDER BY ts_utc) AS rn, CASE WHEN row_number() OVER (ORDER BY ts_utc) >= 4 THEN avg(close) OVER (ORDER BY ts_utc ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS x,
CASE WHEN row_number() OVER (ORDER BY ts_utc) >= 2 THEN avg(close) OVER (ORDER BY ts_utc ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS e FROM b WHERE instrument_id = 'click'),
st AS (SELECT rn, ts_utc, CASE WHEN coalesce(close < x, false) THEN false ELSE true END AS state FROM g WHERE rn = 1
UNION ALL SELECT g.rn, g.ts_utc, CASE WHEN st.state THEN NOT coalesce(g.close < g.x, false) ELSE coalesce(g.close > g.e, false) END FROM st JOIN g ON g.rn = st.rn + 1)
SELECT {KEYS}, round(CASE WHEN st.state THEN CASE instrument_id WHEN 'click' THEN 0.7 ELSE 0 END ELSE CASE instrument_id WHEN 'view' THEN 0.5 ELSE 0 END END, 6)::DOUBLE AS weight FROM b JOIN st USING (ts_utc)""",
)(lambda s, d: strategies.guard(bars(s, d, "day"), "click", 4, 2, {"click": 0.7}, {"view": 0.5}))
_IST = "(ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata'"
query(
    "strat_year_winner",
    f"""WITH b AS ({PX_DAILY_SQL}), t AS (SELECT DISTINCT ts_utc, date_trunc('year', {_IST}) AS y FROM b), n AS (SELECT *, lead(y) OVER (ORDER BY ts_utc) AS ny FROM t), ends AS (SELECT ts_utc AS end_ts, y FROM n WHERE ny <> y),
yr AS (SELECT instrument_id, date_trunc('year', {_IST}) AS y, arg_min(close, ts_utc) AS a, arg_max(close, ts_utc) AS z, count(*) AS k, min({_IST}) AS f, max(ts_utc) AS l FROM b GROUP BY 1, 2),
ok AS (SELECT instrument_id, end_ts AS ts_utc, z / a - 1 AS ret FROM yr JOIN ends USING (y) WHERE k >= 50 AND month(f) = 1 AND l = end_ts), rk AS (SELECT *, row_number() OVER (PARTITION BY ts_utc ORDER BY ret DESC, instrument_id) AS p FROM ok),
won AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY ts_utc) AS weight FROM rk WHERE p <= 2)
SELECT b.instrument_id, b.ts_utc, CASE WHEN b.ts_utc IN (SELECT ts_utc FROM won) THEN coalesce(won.weight, 0) END::DOUBLE AS weight FROM b LEFT JOIN won ON won.instrument_id = b.instrument_id AND won.ts_utc = b.ts_utc""",
)(lambda s, d: strategies.year_winner(px_daily(s, d), 2, 50))
query(
    "top_n_per_period",
    f"WITH b AS ({DAY}) SELECT instrument_id, ts_utc, round(close, 6) AS close FROM b QUALIFY row_number() OVER (PARTITION BY ts_utc ORDER BY close DESC, instrument_id) <= 2",
)(lambda s, d: bars(s, d, "day").withColumn("k", F.row_number().over(Window.partitionBy("ts_utc").orderBy(F.col("close").desc(), "instrument_id"))).where("k <= 2").select("instrument_id", "ts_utc", "close"))


def book_sql(px: str = PX_SMOOTH_SQL, weight: str = "1.0 / count(*) OVER (PARTITION BY ts_utc)") -> str:
    """A constant mix at 10 basis points over prices, from targets (tg) to the equity curve (eq)."""
    return f"""px AS ({px}), tg AS (SELECT *, {weight} AS weight FROM px), ds AS (SELECT *, lag(weight) OVER ({W}) AS desired FROM tg),
hw AS (SELECT *, coalesce(last_value(CASE WHEN open IS NOT NULL THEN desired END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ds),
pv AS (SELECT *, lag(c) OVER ({W}) AS p, coalesce(lag(w) OVER ({W}), 0) AS w0 FROM hw),
tr AS (SELECT *, open IS NOT NULL AND close IS NOT NULL AS traded FROM pv),
pt AS (SELECT *, CASE WHEN traded THEN w - w0 ELSE 0 END AS dw, CASE WHEN traded AND abs(p) >= 1e-12 THEN w0 * (open / p - 1) ELSE 0 END AS gp, CASE WHEN traded AND abs(open) >= 1e-12 THEN w * (close / open - 1) ELSE 0 END AS br, CASE WHEN traded THEN abs(w - w0) * 10 / 10000 ELSE 0 END AS fe FROM tr),
bk AS (SELECT ts_utc, sum(gp) AS gap, sum(br) AS bar, sum(fe) AS fee, sum(abs(dw)) AS turnover, sum(abs(w)) AS gross FROM pt GROUP BY 1),
rr AS (SELECT *, (1 + gap) * (1 + bar - fee) - 1 AS r FROM bk), eq AS (SELECT *, product(1 + r) OVER (ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity, greatest(0, 1 - gross) AS cash_weight FROM rr)"""


_BOOK = book_sql()


def _book(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    panel = px_smooth(s, d)
    return broker.run_book(panel, strategies.buy_hold(panel), 10.0)


query("broker_const_mix", f"WITH {_BOOK} SELECT {KEYS}, {r6(w='w', dw='dw')} FROM pt")(lambda s, d: _book(s, d)[0].select("instrument_id", "ts_utc", "w", "dw"))
query("broker_returns", f"WITH {_BOOK} SELECT {KEYS}, {r6(gap_part='gp', bar_part='br', fee_part='fe')} FROM pt")(lambda s, d: _book(s, d)[0].select("instrument_id", "ts_utc", "gap_part", "bar_part", "fee_part"))
query("portfolio_agg", f"WITH {_BOOK} SELECT ts_utc, {r6(gap='gap', bar='bar', fee='fee', turnover='turnover', gross='gross')} FROM bk")(lambda s, d: broker.portfolio(_book(s, d)[0]))
query("equity_curve", f"WITH {_BOOK} SELECT ts_utc, {r6(r='r', log_equity='ln(equity)', cash_weight='cash_weight')} FROM eq")(lambda s, d: equity_curve(s, d))
query("drawdown", f"WITH {_BOOK} SELECT ts_utc, round(equity / max(equity) OVER (ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS drawdown FROM eq")(lambda s, d: metrics.drawdown(_book(s, d)[1]).select("ts_utc", "drawdown"))
query("broker_fills", f"WITH {_BOOK}, nv AS (SELECT ts_utc, coalesce(lag(equity) OVER (ORDER BY ts_utc), 1) * (1 + gap) AS nav FROM eq) SELECT ts_utc, instrument_id, round(dw * nav / open, 6) AS size, round(open, 6) AS price, round(abs(dw * nav) * 10 / 10000, 6) AS fee FROM pt JOIN nv USING (ts_utc) WHERE abs(dw) > 1e-12 AND open <> 0")(
    lambda s, d: broker.fills(*_book(s, d), 10.0)
)
query("calendar_year_returns", f"WITH {_BOOK} SELECT year(ts_utc)::INT AS year, round(product(1 + r) - 1, 6) AS ret FROM rr GROUP BY 1")(lambda s, d: metrics.calendar_years(_book(s, d)[1]))
query(
    "metrics",
    f"""WITH {_BOOK}, dd AS (SELECT *, equity / max(equity) OVER (ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM eq), a AS (SELECT count(*) AS n, arg_min(equity, ts_utc) AS e0, arg_max(equity, ts_utc) AS e1, min(dd) AS mdd,
date_diff('microsecond', min(ts_utc), max(ts_utc)) / 86400000000 / 365.25 AS y, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS dn, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS wr, sum(turnover) AS tv, avg(gross) AS g, avg(cash_weight) AS cw FROM dd)
SELECT n, {r6(max_drawdown='mdd', win_rate='wr', turnover='tv', mean_gross='g', mean_cash='cw', total_return='e1 / e0 - 1', ann_vol='sd * sqrt(n / y)', sharpe='m / sd * sqrt(n / y)', sortino='m / dn * sqrt(n / y)')} FROM a""",
)(lambda s, d: metrics.metrics(_book(s, d)[1]).select("n", "max_drawdown", "win_rate", "turnover", "mean_gross", "mean_cash", "total_return", "ann_vol", "sharpe", "sortino"))
query(
    "sip_wealth",
    f"""WITH RECURSIVE {_BOOK}, o AS (SELECT ts_utc, r, row_number() OVER (ORDER BY ts_utc) AS rn, CASE WHEN coalesce(lag(date_trunc('month', ts_utc)) OVER (ORDER BY ts_utc) <> date_trunc('month', ts_utc), true) THEN 100.0 ELSE 0 END AS c FROM eq),
k AS (SELECT rn, ts_utc, c::DOUBLE AS w, c::DOUBLE AS t FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.ts_utc, k.w * (1 + o.r) + o.c, k.t + o.c FROM k JOIN o ON o.rn = k.rn + 1) SELECT ts_utc, round(t, 6) AS contributed, round(w, 6) AS wealth FROM k""",
)(lambda s, d: metrics.sip(_book(s, d)[1]).select("ts_utc", "contributed", "wealth"))
#: Event types, which name the columns.
NAMES = ("click", "error", "purchase", "signup", "view")
query(
    "pivot_wide",
    f"WITH b AS ({DAY}) SELECT ts_utc, {', '.join(f'round(max(close) FILTER (WHERE instrument_id = {n!r}), 6) AS {n}' for n in NAMES)} FROM b GROUP BY 1",
)(lambda s, d: bars(s, d, "day").groupBy("ts_utc").pivot("instrument_id", list(NAMES)).agg(F.first("close")))


def equity_curve(s: SparkSession, d: str) -> DataFrame:
    return _book(s, d)[1].select("ts_utc", "r", F.log("equity").alias("log_equity"), "cash_weight")
