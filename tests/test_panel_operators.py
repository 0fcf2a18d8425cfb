"""Hand-computed values of the store, payloads, panels, winners, drifting books, trend signals and streams."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from marketlab.operators import broker, catalog, metrics, panel, store, strategies, trend
from marketlab.sources import vendors
from marketlab.streaming.bars import tick_bars, upsert_bars
from pyspark.sql import functions as F

BAR = "instrument_id string, source string, timeframe string, ts_utc timestamp, open double, high double, low double, close double, volume double, is_partial boolean, quality string"


def stored_bars(spark, *rows):
    """(source, timeframe, time, close) of instrument A."""
    return spark.createDataFrame([("A", s, tf, t, c, c, c, c, 1.0, False, "ok") for s, tf, t, c in rows], BAR)


def payloads(spark, *objects):
    return spark.createDataFrame([("X", json.dumps(o)) for o in objects], "vendor_symbol string, payload string")


def test_store_keeps_latest_and_scans_both_ends(spark, tmp_path):
    t = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(3)]
    s = store.Store(spark, str(tmp_path))
    assert s.scan("A", "1d", t[0], t[2]).columns[:2] == ["instrument_id", "source"]
    s.write_bars(stored_bars(spark, ("x", "1d", t[0], 1.0), ("y", "1d", t[0], 2.0), ("x", "1d", t[1], 3.0)))
    s.write_bars(stored_bars(spark, ("y", "1d", t[0], 5.0), ("y", "1d", t[2], 6.0)))
    assert [tuple(r) for r in s.scan("A", "1d", t[0], t[2], ["close", "adj_close", "nothing"]).collect()] == [(t[0], 5.0, 5.0), (t[1], 3.0, 3.0), (t[2], 6.0, 6.0)]
    with pytest.raises(ValueError, match="volume"):
        s.write_bars(stored_bars(spark).drop("volume"))


def test_store_prunes_months_with_coarse_coverage(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    minute = [datetime(2020, 1, 5), datetime(2020, 1, 20), datetime(2020, 3, 1)]
    s.write_bars(stored_bars(spark, *(("x", "1m", m, 1.0) for m in minute)))
    ranges = [("A", "1m", "x", minute[0], minute[2]), ("A", "1d", "x", minute[0], minute[2])]
    spans = spark.createDataFrame(ranges, "instrument_id string, timeframe string, source string, start_utc timestamp, end_utc timestamp")
    assert s.prune_hot(30, datetime(2020, 2, 10)) == 0
    s.add_coverage(spans)
    assert s.prune_hot(30, datetime(2020, 2, 10)) == 1
    assert [r.ts_utc for r in s.scan("A", "1m", minute[0], minute[2]).collect()] == [minute[2]]
    assert [(r.start_utc, r.end_utc) for r in s.coverage("A", "1m").collect()] == [(datetime(2020, 2, 1), minute[2])]
    s.write_bars(stored_bars(spark, ("x", "1m", minute[0], 7.0)))
    assert s.scan("A", "1m", minute[0], minute[0]).first().close == 7.0


def test_payloads(spark):
    av = {"Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "3", "3. low": "0.5", "4. close": "2", "5. adjusted close": "1.9", "6. volume": "7"}}}
    assert vendors.alphavantage_bars(payloads(spark, av)).first()[1:] == (datetime(2024, 1, 2), 1.0, 3.0, 0.5, 2.0, 7.0, 1.9)
    status = vendors.alphavantage_status(payloads(spark, av, {"Note": "x"}, {"Information": "x"}, {"Error Message": "x"}))
    assert [r.status for r in status.collect()] == ["ok", "quota", "quota", "permanent"]
    assert vendors.alphavantage_bars(payloads(spark, {"Note": "x"})).count() == 0
    got = vendors.yahoo_bars(payloads(spark, {"bars": [{"ts": "2024-01-02T14:30:00Z", "open": 1, "high": 1, "low": 1, "close": 1, "volume": None}, {"ts": 1704205800000, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 2}]})).collect()
    assert [(r.ts, r.volume) for r in got] == [(datetime(2024, 1, 2, 14, 30), 0.0), (datetime(2024, 1, 2, 14, 30), 2.0)]
    assert vendors.kline_bars(payloads(spark, [[0, 1, 1, 1, 1, 1], [1000, 1, 1, 1, 1], [2000, 1, 1, 1, 1, 1]]), end=datetime(1970, 1, 1, 0, 0, 2)).count() == 1
    assert vendors.kline_bars(spark.createDataFrame([("X", None), ("X", "not json")], "vendor_symbol string, payload string")).count() == 0
    pair = {"pairs": [{"pairAddress": "a", "liquidity": {"usd": 12000}, "priceUsd": "2"}, {"pairAddress": "b", "liquidity": {"usd": 5000000}, "priceUsd": "x"}]}
    shots = vendors.snapshots(payloads(spark, pair), F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r.pair_address, r.quality) for r in shots] == [("a", "ok"), ("b", "suspect")]
    best = vendors.ranked_pairs(vendors.pairs(payloads(spark, pair)).select("vendor_symbol", F.col("pairAddress").alias("pair_address"), F.col("liquidity.usd").alias("liquidity_usd"))).first()
    assert (best.best, best.alternatives) == ("b", ["a"])


def test_bhavcopy_headers(spark):
    day = F.lit("2024-01-02").cast("date").alias("session_date")
    old = spark.createDataFrame([("ABC", "EQ", "1", "2", "1", "2", "9"), ("ABC", "BE", "1", "2", "1", "2", "9")], "SYMBOL string, SERIES string, OPEN string, HIGH string, LOW string, CLOSE string, TOTTRDQTY string")
    assert [r.ts for r in vendors.bhavcopy_bars(old.select("*", day)).collect()] == [datetime(2024, 1, 2, 3, 45)]
    with pytest.raises(ValueError, match="missing volume"):
        vendors.bhavcopy_bars(old.drop("TOTTRDQTY").select("*", day))


def test_catalog(spark):
    ids = spark.createDataFrame([("crypto:Binance:BTC/USDT:USDT",), ("eq:xnas:aapl",), ("AAPL",), (None,)], "i string")
    assert [None if r.p is None else tuple(r.p) for r in ids.select(catalog.parsed_id(F.col("i")).alias("p")).collect()] == [("crypto", "binance", "BTC/USDT:USDT"), ("equity", "XNAS", "AAPL"), None, None]


def test_cash_over_a_weekend(spark):
    stamps = spark.createDataFrame([(datetime(2024, 1, 5), 0.01), (datetime(2024, 1, 8), 0.01)], "ts_utc timestamp, tbill_per_day double")
    assert [r.daily_tbill for r in panel.period_cash(stamps).orderBy("ts_utc").collect()] == pytest.approx([0, 0.03])


def daily(spark, series, start=date(2024, 1, 1)):
    rows = [(n, datetime.combine(start, datetime.min.time()) + timedelta(days=i), float(x)) for n, xs in series.items() for i, x in enumerate(xs) if x is not None]
    return spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, close double")


def test_quarter_winner_needs_both_ends(spark):
    n = 700
    p = daily(spark, {"FAST": [100 * 1.002**i for i in range(n)], "SLOW": [100 * 1.0001**i for i in range(n)], "LATE": [None] * 200 + [100 * 1.01**i for i in range(n - 200)]})
    got = strategies.trailing_winners(p, 1, 300).orderBy("ts_utc").collect()
    assert [r.instrument_id for r in got][0] == "FAST" and got[0].ts_utc.date() == date(2025, 3, 31)
    sleeves = spark.createDataFrame([("a", "FAST", 1), ("b", "FAST", 2), ("b", "SLOW", 2)], "sleeve string, instrument_id string, n int")
    w = strategies.cap_mix(p, sleeves, 300).where(F.col("ts_utc") == got[0].ts_utc).collect()
    assert {r.instrument_id: r.weight for r in w} == pytest.approx({"FAST": 1 / 3, "SLOW": 1 / 3, "LATE": 0})


def test_stop_exits_once_until_the_next_reset(spark):
    p = daily(spark, {"A": [10.0, 10, 9, 8, 7]})
    t0 = datetime(2024, 1, 1)
    targets = spark.createDataFrame([("A", t0 + timedelta(days=i), 1.0 if i in (0, 4) else None) for i in range(5)], "instrument_id string, ts_utc timestamp, weight double")
    assert [r.weight for r in strategies.with_stop(p, targets, 2).orderBy("ts_utc").collect()] == [1.0, None, 0.0, None, 1.0]


def test_drift_lets_weights_follow_prices(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(days=i), "A", o, c, d) for i, (o, c, d) in enumerate([(10.0, 10.0, None), (10.0, 11.0, 0.5), (11.0, 12.1, None)])]
    df = spark.createDataFrame(rows, "ts_utc timestamp, instrument_id string, open double, close double, desired double")
    out = broker.drifting(df)
    assert [(r.w0, r.w) for r in out.orderBy("ts_utc").collect()] == [(0, 0), (0, 0.5), (pytest.approx(0.55 / 1.05), pytest.approx(0.55 / 1.05))]
    curve = broker.equity(broker.portfolio(broker.with_returns(out))).orderBy("ts_utc").collect()
    assert [r.equity for r in curve] == pytest.approx([1, 1.05, 1.05 * (1 + 0.55 / 1.05 * 0.1)])


def test_cash_earns_on_a_flat_book(spark):
    book = spark.createDataFrame([(datetime(2024, 1, i), 0.0, 0.0, 0.0, 0.0, 0.0, 0.01) for i in (1, 2, 3)], "ts_utc timestamp, gap double, bar double, fee double, turnover double, gross double, daily_tbill double")
    assert broker.equity(book).orderBy(F.desc("ts_utc")).first().equity == pytest.approx(1.01**3)


def test_aligned_needs_stamps(spark):
    curves = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0)], "run_id string, ts_utc timestamp, equity double")
    with pytest.raises(ValueError):
        metrics.aligned(curves, {"a": 1})


def test_trend_kernels(spark):
    rho = np.array([[1, 0.95, 0.05], [0.95, 1, 0.04], [0.05, 0.04, 1]])
    assert trend.clusters(rho, 0.6).tolist() == [0, 0, 1]
    x = np.random.default_rng(1).normal(size=(100, 2))
    cov = trend.shrunk_covariance(np.c_[x[:, 0], x[:, 0]])
    assert cov[0, 1] / cov[0, 0] == pytest.approx(1)
    brute = np.mean([((np.outer(r, r) - (s := (z.T @ z) / 100)) ** 2).sum() for z in [x - x.mean(0)] for r in z])
    z = x - x.mean(0)
    assert brute == pytest.approx(((z**2).sum(1) ** 2).mean() - ((z.T @ z / 100) ** 2).sum())
    raw = [0.15, 0.05, -0.05, 0.09, -0.09, -0.15, -0.05, 0.05, 0.15]
    df = daily(spark, {"A": raw}).withColumn("raw", F.col("close"))
    assert [r.trend for r in trend.latched(df, 0.10).orderBy("ts_utc").collect()] == [0.15] * 5 + [0, 0, 0, 0.15]
    up = trend.ramp(np.array([True, True, False, False]), np.array([1, 1, 1, 0], bool), np.array([1, 1, 1, 0], bool), 2, 5)
    assert up.tolist() == pytest.approx([0.5, 1.0, 0.8, 0.6])


def test_caps_pass_the_excess_on():
    w = trend.filled_to_caps(np.array([0.7, 0.2, 0.1]), np.array([0.3, 0.3, 0.9]), np.array([0, 1, 2]), 0.5)
    assert w.max() <= 0.5 + 1e-9 and w[0] == pytest.approx(0.3) and w.sum() == pytest.approx(1.0)


def test_clustered_trend_is_causal_and_within_limits(spark):
    rng = np.random.default_rng(7)
    series = {n: list(100 * np.cumprod(1 + rng.normal(m, 0.01, 420))) for n, m in (("UP", 0.002), ("TWIN", 0.0021), ("FLAT", 0.0), ("DOWN", -0.002))}
    p = daily(spark, series, date(2022, 1, 1)).withColumn("ts_utc", F.col("ts_utc") + F.expr("INTERVAL 21 HOUR")).withColumn("volume", F.lit(1e6))
    rules = trend.Rules(months=(1, 3))
    whole = {(r.instrument_id, r.ts_utc): r.weight for r in trend.clustered_trend(p, rules).collect()}
    cut = datetime(2023, 1, 15)
    part = {(r.instrument_id, r.ts_utc): r.weight for r in trend.clustered_trend(p.where(F.col("ts_utc") < cut), rules).collect()}
    assert part and all(whole[k] == pytest.approx(v) for k, v in part.items())
    last = max(t for _, t in whole)
    end = {n: whole[n, last] for n in series}
    assert end["UP"] > 0 and end["DOWN"] == 0 and sum(end.values()) <= 1 + 1e-9
    full = trend.clustered_trend(p, trend.Rules(months=(1, 3), allow_cash=False)).where(F.col("ts_utc") == last).agg(F.sum("weight")).first()[0]
    assert full == pytest.approx(1)


def test_diagnostics_explain_the_weights(spark):
    rng = np.random.default_rng(3)
    series = {n: list(100 * np.cumprod(1 + rng.normal(m, 0.01, 200))) for n, m in (("UP", 0.003), ("DOWN", -0.002))}
    p = daily(spark, series, date(2022, 1, 1)).withColumn("ts_utc", F.col("ts_utc") + F.expr("INTERVAL 21 HOUR")).withColumn("volume", F.lit(1e6))
    rules = trend.Rules(months=(1, 3))
    told = {(r.instrument_id, r.ts_utc): r for r in trend.diagnostics(p, rules).collect()}
    weights = {(r.instrument_id, r.ts_utc): r.weight for r in trend.clustered_trend(p, rules).collect()}
    assert {k: r.weight for k, r in told.items()} == weights
    held = [r for r in told.values() if r.weight > 0]
    assert held and all(r.live and r.trend > 0 and r.cluster_id is not None and r.weight <= r.asset_cap + 1e-9 and 0 < r.gross_scale <= 1 and 0 <= r.shrinkage <= 1 for r in held)
    assert all(r.cluster_id is None for r in told.values() if not r.live)


def test_caps_against_filling_in_rounds():
    """The total is what filling round by round gives, within all caps, and nothing moves that need not."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        w, caps, group = rng.dirichlet(np.ones(n)), rng.uniform(0, 0.6, n), rng.integers(0, 3, n)
        got = trend.filled_to_caps(w, caps, group, 0.45)
        sums = np.bincount(group, weights=got, minlength=3)
        assert (got <= caps + 1e-9).all() and (sums <= 0.45 + 1e-9).all() and got.sum() <= w.sum() + 1e-9
        most = sum(min(0.45, caps[group == g].sum()) for g in range(3))
        first = np.minimum(w, caps)
        shut = [g for g in range(3) if first[group == g].sum() > 0.45]
        assert got.sum() == pytest.approx(min(w.sum(), most)) or shut
        if (w <= caps).all() and not shut:
            assert got == pytest.approx(w)


def test_streamed_bars_equal_batch_and_upsert(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("A", t0 + timedelta(minutes=7 * i), i, float(i % 5)) for i in range(60)], "instrument_id string, ts timestamp, seq long, price double")
    ticks.repartition(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = tick_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("bars_out")) == key(tick_bars(ticks))
    s = store.Store(spark, str(tmp_path / "store"))
    stored_bars(spark, ("x", "1d", t0, 1.0), ("x", "1d", t0 + timedelta(days=1), 2.0)).write.parquet(str(tmp_path / "in"))
    upsert_bars(spark.readStream.schema(BAR).parquet(str(tmp_path / "in")), s, str(tmp_path / "c2")).awaitTermination(120)
    assert [r.close for r in s.scan("A", "1d", t0, t0 + timedelta(days=1)).collect()] == [1.0, 2.0]


def test_clusters_by_month_and_covariance(spark):
    rule = np.random.default_rng(5)
    common = rule.normal(size=90)
    made = {"A": common, "B": common + rule.normal(scale=0.1, size=90), "C": rule.normal(size=90)}
    rows = spark.createDataFrame([(n, datetime(2024, 1, 1, 21) + timedelta(days=i), float(v)) for n, x in made.items() for i, v in enumerate(x)], "instrument_id string, ts_utc timestamp, ret double")
    got = {(r.month, r.instrument_id): r.cluster for r in trend.monthly_clusters(rows).collect()}
    assert [got["202401", n] for n in "ABC"] == [0, 1, 2]  # one stamp is too short a history
    assert [got["202403", n] for n in "ABC"] == [0, 0, 1]
    cov = {(r.a, r.b): r["cov"] for r in trend.latest_covariance(rows).collect()}
    assert cov["A", "B"] == cov["B", "A"] and abs(cov["A", "A"] - common.var()) < 1e-9 and len(cov) == 9
    assert trend.latest_covariance(rows.limit(30)).collect() == [] == trend.latest_covariance(rows.limit(0)).collect()
