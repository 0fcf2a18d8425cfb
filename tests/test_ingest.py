"""The ingest loop over recorded pages, zones, early closes, comparison and resampled columns."""

from datetime import date, datetime, timedelta

import pytest
from marketlab import api, ingest
from marketlab.errors import MarketError, NotCovered, Quota, ZoneError
from marketlab.operators import calendar, metrics
from marketlab.operators.resample import resample
from marketlab.operators.store import Store
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
NOW = lambda: datetime(2025, 1, 1)


def recorded(spark, days=10, **more):
    rows = [(T0 + timedelta(days=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 5.0, None) for i in range(days)]
    return ingest.Recorded("vendor", spark.createDataFrame(rows, ingest.ROWS), **more)


def covered(store):
    return [(r.start_utc, r.end_utc) for r in store.coverage("A", "1d").collect()]


def test_holes_are_filled_once(spark, tmp_path):
    store, source = Store(spark, str(tmp_path)), recorded(spark, size=4)
    ask = lambda a, b: ingest.ingest(store, source, "A", "1d", T0 + timedelta(days=a), T0 + timedelta(days=b), NOW)
    first = ask(2, 4)
    assert (first.rows, first.holes, first.noop) == (3, 1, False)
    assert ask(2, 4).noop and len(source.calls) == 1
    wide = ask(0, 10)
    # what is covered splits the span; a hole's end is asked for, as coverage holds it
    assert (wide.rows, wide.holes) == (8, 2)
    assert ask(0, 10).noop
    got = store.scan("A", "1d", T0, T0 + timedelta(days=30)).collect()
    assert [r.close for r in got] == [11.0 + i for i in range(10)] and {r.source for r in got} == {"vendor"}
    assert len(covered(store)) == 1


def test_truncated_history_covers_what_came(spark, tmp_path):
    store, source = Store(spark, str(tmp_path)), recorded(spark, since=T0 + timedelta(days=6))
    got = ingest.ingest(store, source, "A", "1d", T0, T0 + timedelta(days=10), NOW)
    assert got.rows == 4 and got.warnings
    assert covered(store) == [(T0 + timedelta(days=6), T0 + timedelta(days=9))]


def test_quota_leaves_the_rest_open(spark, tmp_path):
    class Stops(ingest.Recorded):
        def pages(self, *args):
            for k, page in enumerate(super().pages(*args)):
                if k:
                    raise Quota("later")
                yield page

    store = Store(spark, str(tmp_path))
    rows = recorded(spark).rows
    got = ingest.ingest(store, Stops("vendor", rows, 3), "A", "1d", T0, T0 + timedelta(days=10), NOW)
    assert got.rows == 3 and got.warnings == ["later"] and covered(store) == []
    again = ingest.ingest(store, ingest.Recorded("vendor", rows, 3), "A", "1d", T0, T0 + timedelta(days=10), NOW)
    assert again.rows == 10 and store.scan("A", "1d", T0, T0 + timedelta(days=30)).count() == 10


def test_sessions_and_range_vendors(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    windows = spark.createDataFrame([("A", T0 + timedelta(days=i), T0 + timedelta(days=i + 1)) for i in (0, 4)], "instrument_id string, start_utc timestamp, end_utc timestamp")
    spans = lambda source: ingest.open_ranges(store, "A", "1d", source, T0, T0 + timedelta(days=10), windows)
    assert spans("vendor") == [(T0, T0 + timedelta(days=1)), (T0 + timedelta(days=4), T0 + timedelta(days=5))]
    assert spans("yahoo") == [(T0, T0 + timedelta(days=5))]
    with pytest.raises(NotCovered, match="ingest A 1d"):
        ingest.preflight(store, ["A"], "1d", T0, T0 + timedelta(days=2))


def test_zones():
    assert api.display_zone(None) is None and api.display_zone("Asia/Kolkata").key == "Asia/Kolkata"
    for name in ("EST", "gmt", "+05:30", "UTC+5", "Mars/Base"):
        with pytest.raises(ZoneError):
            api.display_zone(name)


def test_early_closes_and_closures(spark):
    assert calendar.nyse_early_closes(2024) == {date(2024, 7, 3), date(2024, 11, 29), date(2024, 12, 24)}
    assert calendar.nyse_early_closes(2020) == {date(2020, 11, 27), date(2020, 12, 24)}
    days = calendar.sessions(spark, date(2024, 11, 25), date(2025, 1, 10))
    got = {r.session_date: r.close_utc.hour for r in calendar.nyse_hours(days, 2024, 2025).collect()}
    assert got[date(2024, 11, 29)] == 18 and got[date(2024, 11, 27)] == 21 and date(2024, 11, 28) not in got and date(2025, 1, 9) not in got


def test_comparison_starts_when_the_slowest_is_ready(spark):
    rows = [(n, T0 + timedelta(days=i), p, p, p, p, 1.0) for n, step in (("A", 1.0), ("B", 0.5)) for i in range(12) for p in [10 + step * i]]
    panel = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, open double, high double, low double, close double, volume double")
    raw = {"name": "x", "timeframe": "1d", "from": "2024-01-01", "to": "2024-02-01", "universe": ["A", "B"], "runs": [{"id": "hold", "strategy": "buy_hold"}, {"id": "cross", "strategy": "sma_cross", "params": {"fast": 2, "slow": 5}}]}
    hold, cross = api.compare(panel, api.Spec.parse(raw))
    assert hold["start_ts"] == cross["start_ts"] == T0 + timedelta(days=5) and hold["n"] == 7 and (hold["ready_bars"], cross["ready_bars"]) == (0, 5)
    assert hold["excess_return"] == 0 and cross["excess_return"] == pytest.approx(cross["total_return"] - hold["total_return"]) and cross["trades"] == 2
    assert "cross" in api.score_table([hold, cross])
    raw["runs"][1]["params"]["slow"] = 50
    with pytest.raises(MarketError):
        api.compare(panel, api.Spec.parse(raw))


def test_scores_without_risk_are_zero(spark):
    rows = [(T0 + timedelta(days=i), 1.0, 0.0, 0.0, 0.0, 1.0) for i in range(4)]
    curve = spark.createDataFrame(rows, "ts_utc timestamp, equity double, r double, turnover double, gross double, cash_weight double")
    got = metrics.metrics(curve).first()
    assert (got.ann_vol, got.sharpe, got.sortino, got.calmar, got.max_drawdown) == (0, 0, 0, 0, 0)
    assert metrics.excess(curve).first().sharpe_excess == 0


def test_resampled_rows_keep_what_the_last_bar_says(spark):
    rows = [("A", T0 + timedelta(hours=h), 1.0, 2.0, 0.5, 1.0 + h, 1.0, "x" if h < 3 else "y", h == 3, "ok") for h in range(4)]
    bars = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, open double, high double, low double, close double, volume double, source string, is_partial boolean, quality string")
    got = resample(bars, "1d").first()
    assert (got.source, got.is_partial, got.quality, got.close) == ("y", True, "ok", 4.0)
    local = resample(bars, "1h", "Asia/Kolkata").orderBy("ts_utc").first()
    assert local.utc_offset == 330 and local.ts_local == datetime(2024, 1, 1, 5, 0)
    assert resample(bars, "1d", "America/New_York").select(F.min("utc_offset")).first()[0] == -300
