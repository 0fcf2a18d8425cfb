"""Hand-computed values, causality and isolation of the market-data operators."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from marketlab.functions import indicators as ta
from marketlab.functions import recurrences as rec
from marketlab.functions import windows as wf
from marketlab.operators import broker, calendar, inspect, intervals, metrics, normalize, resample, strategies
from marketlab.schema import downsample_target
from pyspark.sql import functions as F


def panel(spark, closes, name="A", volume=100.0, start=datetime(2024, 1, 2, 14, 30)):
    rows = [(name, start + timedelta(days=i), *((None,) * 4 if c is None else (float(c), c + 1.0, c - 1.0, float(c))), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, open double, high double, low double, close double, volume double")


def values(df, column):
    return [r[column] for r in df.orderBy("instrument_id", "ts_utc").collect()]


def test_sma_wma_values(spark):
    assert values(ta.sma(panel(spark, [1.0, 2, 3, 4, 5]), 3), "sma") == [None, None, 2, 3, 4]
    assert values(ta.wma(panel(spark, [1.0, 2, 3]), 3), "wma")[-1] == pytest.approx(14 / 6)


def test_recurrence_values():
    assert rec.ema(np.array([1.0, 2, 3, 4]), 3)[2:].tolist() == [2, 3]
    assert rec.rsi(np.array([10.0, 12, 11, 13]), 2)[2:] == pytest.approx([100 - 100 / 3, 100 - 100 / 7])
    assert rec.ewm_std(np.array([5.0, 5, 5]), 2.0)[1:].tolist() == [0, 0]
    with pytest.raises(ValueError):
        rec.macd(np.ones(3), 5, 5)


def test_null_in_window_gives_null(spark):
    assert values(ta.sma(panel(spark, [1.0, None, 3, 4, 5]), 2), "sma") == [None, None, None, 3.5, 4.5]


def test_mfi_without_flow_is_null(spark):
    assert values(ta.mfi(panel(spark, [5.0] * 5), 2), "mfi") == [None] * 5


def test_group_isolation_and_causality(spark):
    a, b = panel(spark, [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]), panel(spark, [float(x) for x in (2, 7, 1, 8, 2, 8, 1, 8)], "B")
    both = ta.bbands(a.unionByName(b), 3).where("instrument_id = 'A'")
    alone = ta.bbands(a, 3)
    assert values(both, "bb_upper") == values(alone, "bb_upper")
    cut = ta.bbands(a.where(F.col("ts_utc") < datetime(2024, 1, 9)), 3)
    assert values(cut, "percent_b") == values(alone, "percent_b")[:-1]


def test_swing_flags_on_confirmation(spark):
    df = panel(spark, [10.0, 15, 11, 13]).withColumn("high", F.col("close"))
    assert values(ta.swing_high(df, 1, 1), "swing_high") == [None, None, True, False]


def test_rolling_median_and_safe_div(spark):
    assert values(panel(spark, [3.0, 1, 2]).withColumn("m", wf.median("close", 3, 1)), "m") == [3, 2, 2]
    assert spark.range(1).select(wf.safe_div(F.lit(1.0), F.lit(0.0)).alias("x")).first().x is None


def test_guard_latch(spark):
    df = panel(spark, [10.0, 10, 10, 7, 8, 12])
    assert values(strategies.guard(df, "A", 3, 2, {"A": 0.7}, {"A": 0.0}), "weight") == [0.7, 0.7, 0.7, 0, 0.7, 0.7]


def test_band_steps():
    held, out = 0.0, []
    for t in (float("nan"), 0.50, 0.52, 0.53, 0.54):
        held = broker.band_step(held, t, 1.0, 0.05, 0, 0, False)
        out.append(held)
    assert out == [0, 0.5, 0.5, 0.5, 0.5]


def test_zero_exits_at_once():
    held, out = 0.0, []
    for t in (1.0, 1.0, 0.0, 0.01):
        held = broker.band_step(held, t, 1.0, 0.05, 0, 0, True)
        out.append(float(held))
    assert out == [0.5, 0.75, 0, 0]


def test_closed_bars_return_and_pay_nothing(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("A", t0 + timedelta(days=i), o, c, w) for i, (o, c, w) in enumerate([(10.0, 10.0, 1.0), (None, 12.0, 0.5), (11.0, None, 0.2), (11.0, 11.0, 0.2)])]
    df = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, open double, close double, weight double")
    got = broker.run_book(df.drop("weight"), df.select("instrument_id", "ts_utc", "weight"), 50.0)[0].orderBy("ts_utc").collect()
    assert [(r.w, r.dw, r.gap_part, r.bar_part, r.fee_part) for r in got[:3]] == [(0, 0, 0, 0, 0)] * 2 + [(0.5, 0, 0, 0, 0)]
    assert got[3].dw == pytest.approx(-0.3) and got[3].gap_part == pytest.approx(0.5 * (11 / 12 - 1)) and got[3].fee_part == pytest.approx(0.3 * 50 / 1e4)


def test_books_run_side_by_side(spark):
    df = panel(spark, [1.0, 2, 4])
    target = df.select("instrument_id", "ts_utc", F.lit(0.5).alias("weight"))
    both = [df.withColumn("run_id", F.lit(r)) for r in "ab"]
    aims = [target.withColumn("weight", F.lit(w)).withColumn("run_id", F.lit(r)) for r, w in (("a", 0.5), ("b", 1.0))]
    rows, curve = broker.run_book(both[0].unionByName(both[1]), aims[0].unionByName(aims[1]), 10.0)
    for r, w in (("a", 0.5), ("b", 1.0)):
        alone = broker.run_book(df, target.withColumn("weight", F.lit(w)), 10.0)[1].orderBy("ts_utc").collect()
        mine = curve.where(F.col("run_id") == r).orderBy("ts_utc").collect()
        assert [(x.ts_utc, x.equity, x.gross) for x in mine] == [(x.ts_utc, x.equity, x.gross) for x in alone]
    assert broker.fills(rows, curve, 10.0).groupBy("run_id").count().count() == 2
    banded = broker.banded(broker.desired(both[0].unionByName(both[1]), aims[0].unionByName(aims[1])))
    assert {(r.run_id, r.w) for r in banded.collect()} == {("a", 0.0), ("a", 0.5), ("b", 0.0), ("b", 1.0)}


def test_last_short_bar_of_a_session_is_expected(spark):
    window = spark.createDataFrame([("A", datetime(2024, 1, 3, 14, 30), datetime(2024, 1, 3, 21)), ("B", datetime(2024, 1, 3), datetime(2024, 1, 3))], "instrument_id string, start_utc timestamp, end_utc timestamp")
    assert [r.ts_utc.hour for r in inspect.expected_opens(window, 60).orderBy("ts_utc").collect()] == [14, 15, 16, 17, 18, 19, 20]


def test_spikes_need_a_median_above_zero(spark):
    flat = panel(spark, [1.0] * 30).withColumn("high", F.col("close")).withColumn("low", F.col("close"))
    moved = flat.withColumn("high", F.when(F.dayofmonth("ts_utc") > 25, F.col("close") + 1).otherwise(F.col("high")))
    assert inspect.spikes(moved).count() == 0
    wide = flat.withColumn("high", F.col("close") + F.when(F.dayofmonth("ts_utc") == 15, 9.0).otherwise(1.0))
    assert [r.ts_utc.day for r in inspect.spikes(wide).collect()] == [15]


def test_signals_follow_the_adjusted_close(spark):
    df = panel(spark, [100.0, 100, 100, 70, 80, 120]).withColumn("adj_close", F.col("close"))
    same = strategies.guard(df, "A", 3, 2, {"A": 0.7}, {"A": 0.0})
    split = df.withColumn("close", F.when(F.dayofmonth("ts_utc") < 3, F.col("close") * 10).otherwise(F.col("close")))
    assert values(strategies.guard(split, "A", 3, 2, {"A": 0.7}, {"A": 0.0}), "weight") == values(same, "weight") == [0.7, 0.7, 0.7, 0, 0.7, 0.7]
    # a missing price leaves the means over it unknown
    holed = df.withColumn("close", F.when(F.dayofmonth("ts_utc") != 3, F.col("close"))).withColumn("adj_close", F.col("close"))
    assert values(strategies.guard(holed, "A", 3, 2, {"A": 0.7}, {"A": 0.0}), "weight") == [0.7, 0.7, 0.7, 0.7, 0, 0.7]


def test_fee_and_drawdown(spark):
    df = panel(spark, [1.0, 1, 1])
    target = df.select("instrument_id", "ts_utc", F.lit(0.5).alias("weight"))
    _, curve = broker.run_book(df, target, 1000.0)
    got = [r.equity for r in curve.orderBy("ts_utc").collect()]
    assert got == pytest.approx([1, 0.95, 0.95])
    assert [round(r.drawdown, 6) for r in metrics.drawdown(curve).orderBy("ts_utc").collect()] == [0, -0.05, -0.05]


def test_sip_and_xirr(spark):
    rows = [(datetime(2024, 1, 1), 0.0), (datetime(2024, 1, 15), 0.1), (datetime(2024, 2, 1), 0.0), (datetime(2024, 2, 15), -0.05)]
    got = metrics.sip(spark.createDataFrame(rows, "ts_utc timestamp, r double")).orderBy("ts_utc").collect()
    assert got[-1].contributed == 200
    assert got[-1].wealth == pytest.approx((100 * 1.1 + 100) * 0.95)
    assert metrics.xirr([(0, -100), (365, 110)]) == pytest.approx(0.10)
    assert metrics.xirr([(0, -100)]) is None


def test_coverage_algebra(spark):
    t = lambda d: datetime(2024, 1, d)
    cover = spark.createDataFrame([("A", t(1), t(10)), ("A", t(10), t(20)), ("A", t(25), t(26))], "instrument_id string, start_utc timestamp, end_utc timestamp")
    merged = intervals.merge(cover, "instrument_id").orderBy("start_utc").collect()
    assert [(r.start_utc, r.end_utc) for r in merged] == [(t(1), t(20)), (t(25), t(26))]
    wanted = spark.createDataFrame([("A", t(5), t(30)), ("B", t(1), t(2))], "instrument_id string, want_start timestamp, want_end timestamp")
    got = {(r.instrument_id, r.start_utc, r.end_utc) for r in intervals.holes(cover, wanted, "instrument_id").collect()}
    us = timedelta(microseconds=1)
    assert got == {("A", t(20) + us, t(25)), ("A", t(26) + us, t(30)), ("B", t(1), t(2))}
    cut = spark.createDataFrame([("A", t(5), t(6))], "instrument_id string, cut_start timestamp, cut_end timestamp")
    left = intervals.subtract(intervals.merge(cover, "instrument_id"), cut, "instrument_id").orderBy("start_utc").collect()
    assert [(r.start_utc, r.end_utc) for r in left] == [(t(1), t(5) - us), (t(6) + us, t(20)), (t(25), t(26))]


def test_glitch_repair(spark):
    df = normalize.repair_levels(panel(spark, [130.0] * 8 + [13.0, 13.1] + [129.0] * 8))
    got = df.orderBy("ts_utc").collect()
    assert [round(r.close, 6) for r in got][8:10] == [130, 131]
    assert got[8].volume == pytest.approx(10)
    adjusted = normalize.repair_levels(panel(spark, [130.0] * 8 + [13.0] + [129.0] * 8).withColumn("adj_close", F.col("close") / 2))
    assert [round(r.adj_close, 6) for r in adjusted.orderBy("ts_utc").collect()][8] == 65
    split = values(normalize.repair_levels(panel(spark, [130.0] * 9 + [13.0] * 9)), "close")
    assert split == [130.0] * 9 + [13.0] * 9


def test_resample_keeps_the_repeated_hour_apart(spark):
    rows = [("A", datetime(2024, 11, 3, h), 1.0, 1.0, 1.0, float(h), 1.0) for h in (5, 6)]
    df = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, open double, high double, low double, close double, volume double")
    assert resample.resample(df, "1h", "America/New_York").count() == 2
    assert resample.resample(df, "1d", "America/New_York").count() == 1


def test_calendar():
    assert calendar.easter(2024) == date(2024, 3, 31)
    assert calendar.nyse_holidays(2024) == {date(2024, m, d) for m, d in ((1, 1), (1, 15), (2, 19), (3, 29), (5, 27), (6, 19), (7, 4), (9, 2), (11, 28), (12, 25))}
    assert date(2022, 1, 1) not in calendar.nyse_holidays(2022)
    assert downsample_target("1m", 30_000) == "5m"
