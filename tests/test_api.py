"""Specs, runs, the read API's answers and the command line."""

import json
from datetime import datetime, timedelta

import pytest
from marketlab import api
from marketlab.operators.store import Store

BAR = "instrument_id string, source string, timeframe string, ts_utc timestamp, open double, high double, low double, close double, volume double, is_partial boolean, quality string"
RAW = {"name": "x", "timeframe": "1d", "from": "2024-01-01", "to": "2024-01-05", "universe": ["A", "B"], "runs": [{"id": "hold", "strategy": "buy_hold"}, {"id": "free", "strategy": "static", "params": {"weights": {"A": 0.5}}, "drift": True}]}


@pytest.fixture
def root(spark, tmp_path):
    rows = [(n, "x", "1d", datetime(2024, 1, 1) + timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0, False, "ok") for n in "AB" for i in range(4)]
    Store(spark, str(tmp_path / "s")).write_bars(spark.createDataFrame(rows, BAR))
    return str(tmp_path / "s")


def test_spec_errors():
    assert api.Spec.parse(RAW).end == datetime(2024, 1, 6)
    for change in ({"odd": 1}, {"timeframe": "2h"}, {"runs": []}, {"runs": [{"id": "a", "strategy": "none"}]}, {"from": "soon"}):
        with pytest.raises(api.UserError):
            api.Spec.parse({**RAW, **change})
    with pytest.raises(api.UserError, match="registered"):
        api.register("static")(lambda p: p)


def test_times():
    assert api.instant("2024-01-01", "Asia/Kolkata") == datetime(2023, 12, 31, 18, 30)
    assert api.instant("2024-01-01T00:00:00Z", "Asia/Kolkata", end=True) == datetime(2024, 1, 1)


def test_answers_and_runs(spark, root, tmp_path, capsys):
    store = Store(spark, root)
    got = api.bars_answer(store, "A", "1d", datetime(2024, 1, 1), datetime(2024, 1, 9), limit=3)
    assert got["truncated"] and [b["close"] for b in got["bars"]] == [10.5, 11.5, 12.5] and got["bars"][0]["ts_utc"] == "2024-01-01T00:00:00.000000Z"
    curves = api.run_spec(api.stored_panel(store, api.Spec.parse(RAW)), api.Spec.parse(RAW))
    assert {(r.run_id, r["count"]) for r in curves.groupBy("run_id").count().collect()} == {("hold", 4), ("free", 4)}
    (tmp_path / "spec.json").write_text(json.dumps({**RAW, "universe": ["A", "C"]}))
    assert api.main(["--store", root, "run", str(tmp_path / "spec.json")]) == 2 and "C" in capsys.readouterr().err
    (tmp_path / "spec.json").write_text(json.dumps(RAW))
    assert api.main(["--store", root, "run", str(tmp_path / "spec.json")]) == 0
    assert set(json.loads(capsys.readouterr().out)) == {"hold", "free"}


def test_plugins_and_the_rest_of_a_spec(tmp_path):
    (tmp_path / "mine.py").write_text("from marketlab import api\n\n\n@api.register('mine')\ndef mine(panel):\n    return panel\n")
    spec = api.Spec.parse({**RAW, "plugins": [str(tmp_path / "mine.py")], "runs": [{"id": "a", "strategy": "mine"}], "band_frac": 0.1, "half_move": True, "initial_equity": 5})
    assert spec.band_rule == {"flat": 0.0, "floor": 0.0, "fraction": 0.1, "half": True} and spec.initial_equity == 5.0 and spec.runs[0].drift is None
    api.STRATEGIES.pop("mine")
    with pytest.raises(api.UserError):
        api.Spec.parse({**RAW, "plugins": [str(tmp_path / "none.py")]})
