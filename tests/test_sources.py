"""Bulk loads, archives, settings, the catalogue, snapshots and streams with state."""

import io
import zipfile
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from marketlab import api, functions
from marketlab.functions import recurrences
from marketlab.operators import broker, catalog
from marketlab.operators.store import Store
from marketlab.settings import Settings
from marketlab.sources import files
from marketlab.streaming.recurrent import stream_banded, stream_ema
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
BAR = "instrument_id string, source string, timeframe string, ts_utc timestamp, open double, high double, low double, close double, volume double, is_partial boolean, quality string"


def bars(spark, n, timeframe="1d", name="A", step=timedelta(days=1)):
    return spark.createDataFrame([(name, "x", timeframe, T0 + step * i, 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 1.0, False, "ok") for i in range(n)], BAR)


def test_archives(spark, tmp_path):
    old, new = date(2024, 7, 5), date(2024, 7, 8)
    assert files.archive_name(old) == "cm05JUL2024bhav.csv.zip" and files.archive_name(new) == "BhavCopy_NSE_CM_0_0_0_20240708_F_0000.csv.zip"
    assert [files.archive_day(files.archive_name(d)) for d in (old, new)] == [old, new] and files.archive_day("x.csv") is None
    texts = {
        old: "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY\nABC,EQ,1,2,0.5,1.5,10\nABC,BE,9,9,9,9,9\n",
        new: "TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\nABC,EQ,2,3,1.5,2.5,20\n",
    }
    for day, text in texts.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("x.csv", text)
        (tmp_path / files.archive_name(day)).write_bytes(data.getvalue())
    got = files.bhavcopies(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.vendor_symbol, r.ts, r.open, r.close, r.volume) for r in got] == [("ABC", datetime(2024, 7, 5, 3, 45), 1, 1.5, 10), ("ABC", datetime(2024, 7, 8, 3, 45), 2, 2.5, 20)]


def test_bulk_load_takes_files_of_unlike_columns(spark, tmp_path):
    bars(spark, 3).write.parquet(str(tmp_path / "in/a"))
    bars(spark, 2, name="B").withColumn("adj_close", F.lit(7.0)).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "in/b/c"))
    store = Store(spark, str(tmp_path / "s"))
    files.bulk_load(store, str(tmp_path / "in"))
    assert {(r.instrument_id, r.adj_close) for r in store.bars().collect()} == {("A", 1.5), ("A", 2.5), ("A", 3.5), ("B", 7.0)}
    assert files.migrated([bars(spark, 1), bars(spark, 1).drop("quality")]).count() == 2
    store.truncate()
    assert store.bars().count() == 0


def test_snapshots_and_instruments(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("dexscreener", "eth", "0x1", T0, 1.0), ("dexscreener", "eth", "0x1", T0 + timedelta(hours=1), 2.0)]
    store.write_snapshots(spark.createDataFrame(rows, "source string, chain_id string, pair_address string, polled_at_utc timestamp, price_usd double"))
    assert [(r.instrument_id, r.polled_at) for r in store.polls().collect()] == [("DEX:eth:0x1", T0 + timedelta(hours=1))]
    with pytest.raises(ValueError):
        store.write_snapshots(spark.createDataFrame([(1,)], "odd int"))
    one = lambda symbol, aliases: spark.createDataFrame([("EQ:XNAS:AAPL", "equity", "XNAS", symbol, "America/New_York", aliases, [], None, None, None)], store.instruments().schema)
    store.put_instruments(one("AAPL", ["apple"]))
    store.put_instruments(one("AAPL", ["apple", "fruit"]))
    assert [r.aliases for r in store.instruments().collect()] == [["apple", "fruit"]]
    asked = spark.createDataFrame([(" eq:xnas:aapl",), ("Fruit ",), ("CRYPTO:binance:BTCUSDT",), ("msft",), ("?? no",), (None,)], "query string")
    got = {r.query: (r.instrument_id, r.how) for r in catalog.resolve(asked, store.instruments()).collect()}
    assert got == {" eq:xnas:aapl": ("EQ:XNAS:AAPL", "stored"), "Fruit ": ("EQ:XNAS:AAPL", "alias"), "CRYPTO:binance:BTCUSDT": ("CRYPTO:binance:BTCUSDT", "parsed"), "msft": ("EQ:XNAS:MSFT", "made"), "?? no": (None, None), None: (None, None)}


def test_chart_of_many_bars_is_coarser(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_bars(bars(spark, 120, "1m", step=timedelta(minutes=1)))
    got = api.chart_answer(store, "A", "1m", T0, T0 + timedelta(days=1), most=30)
    assert got["native_bars"] == 120 and len(got["bars"]) == 24 and "5m" in got["note"]
    assert api.chart_answer(store, "A", "1m", T0, T0 + timedelta(days=1))["note"] == ""


def test_settings_and_catalogue_of_indicators():
    got = Settings.read({"MARKETLAB_HOT_DAYS": "7", "MARKETLAB_API_KEY": "abc", "MARKETLAB_VENDOR_PREMIUM": "yes", "MARKETLAB_ZONE": " "})
    assert (got.hot_days, got.vendor_premium, got.zone, got.api_key.value) == (7, True, "UTC", "abc") and "abc" not in repr(got)
    assert {"sma", "aroon", "ewm_std", "vwap"} <= set(functions.available())


def test_stream_recurrences_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    closes = rng.normal(10, 1, 30)
    rows = [(n, T0 + timedelta(days=i), float(closes[i]), float(rng.uniform()) if i % 3 else None, 1.0) for n in "AB" for i in range(30)]
    frame = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp, close double, desired double, open double")
    for k in range(3):
        part = frame.where((F.col("ts_utc") >= F.lit(T0 + timedelta(days=10 * k))) & (F.col("ts_utc") < F.lit(T0 + timedelta(days=10 * k + 10))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # each batch continues from the state that the last one left
        for name, build in (("ema", lambda s: stream_ema(s, 5)), ("banded", lambda s: stream_banded(s, flat=0.2))):
            stream = build(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    got = [r.ema for r in spark.read.parquet(str(tmp_path / "ema")).where("instrument_id = 'A'").orderBy("ts_utc").collect()]
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx(recurrences.ema(closes, 5)[4:].tolist())
    want = {(r.instrument_id, r.ts_utc): (r.w, r.dw) for r in broker.banded(frame, flat=0.2).collect()}
    assert {(r.instrument_id, r.ts_utc): (r.w, r.dw) for r in spark.read.parquet(str(tmp_path / "banded")).collect()} == want
