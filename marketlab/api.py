"""Specs, the strategy registry, the read API's answers and the command line: driver-side glue over the operators."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.errors import BadSpec, MarketError, NotCovered, ZoneError
from marketlab.operators import broker, metrics, strategies, trend
from marketlab.operators.normalize import total_return, with_adj_close
from marketlab.operators.resample import resample
from marketlab.operators.store import Store
from marketlab.schema import TIMEFRAMES, downsample_target

MOST_ROWS = 100_000


#: What the caller can put right; the command line answers it with exit code 2.
UserError = MarketError


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "buy_hold": strategies.buy_hold,
    "static": strategies.static,
    "sma_cross": strategies.sma_cross,
    "periodic": strategies.periodic,
    "guard": strategies.guard,
    "year_winner": strategies.year_winner,
    "quarter_winner": strategies.quarter_winner,
    "cap_mix": strategies.cap_mix,
    "clustered_trend": lambda panel, **rules: trend.clustered_trend(panel, trend.Rules(**rules)),
}


#: Stamps that a strategy needs before its signals count, from its parameters; 0 where none is named.
READY: dict[str, Callable[[dict], int]] = {
    "sma_cross": lambda p: int(p["slow"]),
    "clustered_trend": lambda p: max(int(p.get("window", 252)), 21 * max(p.get("months") or (12,))),
}


def ready_bars(run: Run, sessions: int = 0) -> int:
    """Stamps to leave out before a run is scored; ``sessions`` is the number of sessions in the history that winners rank on."""
    if run.strategy in ("year_winner", "quarter_winner", "cap_mix"):
        return sessions
    return READY.get(run.strategy, lambda _: 0)(run.params)


#: Zone abbreviations that name several zones or none, and so are no display zones.
ABBREVIATIONS = frozenset(
    "IST EST EDT PST PDT CST CDT MST MDT GMT BST CET CEST EET EEST WET WEST JST KST HKT SGT AEST AEDT AKST AKDT HST AST ADT NST NDT IDT NZST NZDT MSK WIB WITA WIT".split()
)


def display_zone(name: str | None) -> ZoneInfo | None:
    """The zone of an IANA name, None for no name; abbreviations, fixed offsets and unknown names are errors."""
    text = (name or "").strip()
    if not text:
        return None
    if text.upper() in ABBREVIATIONS:
        raise ZoneError(f"{text} stands for several zones or for none: give an IANA name")
    if re.fullmatch(r"(?i)(utc|gmt)?[+-][0-9]{1,2}(:?[0-9]{2})?", text.replace(" ", "")):
        raise ZoneError(f"{text} is an offset: give an IANA name")
    try:
        return ZoneInfo(text)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ZoneError(f"no zone is called {text}") from e


def register(name: str):
    """Decorator that adds a strategy: panel and parameters to (instrument_id, ts_utc, weight)."""

    def put(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in STRATEGIES:
            raise UserError(f"strategy {name} is registered already")
        STRATEGIES[name] = build
        return build

    return put


def load_plugin(where: str) -> None:
    """Import a module by name, or a .py file by path, whose import registers strategies."""
    if not where.endswith(".py"):
        importlib.import_module(where)
        return
    spec = importlib.util.spec_from_file_location(os.path.basename(where)[:-3], where)
    if spec is None or not os.path.isfile(where):
        raise BadSpec(f"no plugin file {where}")
    spec.loader.exec_module(importlib.util.module_from_spec(spec))


def instant(text: str, zone: str = "UTC", end: bool = False) -> datetime:
    """UTC time of a date or ISO time (naive: in the zone); as an end, a bare date means the midnight after it."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise UserError(f"no date or time: {text!r}") from e
    if end and len(text) == 10:
        at += timedelta(days=1)
    return (at if at.tzinfo else at.replace(tzinfo=display_zone(zone) or ZoneInfo("UTC"))).astimezone(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Run:
    id: str
    strategy: str
    params: dict = field(default_factory=dict)
    drift: bool | None = None  # None: as the spec has it


@dataclass(frozen=True)
class Spec:
    """What to run: names, span, timeframe, runs, the no-trade band (flat, or floor and fraction; half moves), shorts, drift, the first equity and total-return prices."""

    name: str
    timeframe: str
    start: datetime
    end: datetime
    universe: tuple[str, ...]
    runs: tuple[Run, ...]
    fee_bps: float = 0.0
    band: float = 0.0
    band_floor: float = 0.0
    band_frac: float = 0.0
    half_move: bool = False
    allow_short: bool = True
    drift: bool = False
    initial_equity: float = 1.0
    total_return: bool = False

    @property
    def band_rule(self) -> dict:
        return {"flat": self.band, "floor": self.band_floor, "fraction": self.band_frac, "half": self.half_move}

    @staticmethod
    def parse(raw: dict) -> Spec:
        numbers, flags = ("fee_bps", "band", "band_floor", "band_frac", "initial_equity"), ("half_move", "allow_short", "drift", "total_return")
        extra = set(raw) - {"name", "timeframe", "from", "to", "universe", "runs", "plugins", *numbers, *flags}
        if extra:
            raise UserError(f"unknown keys: {', '.join(sorted(extra))}")
        lacking = {"name", "timeframe", "from", "to", "universe", "runs"} - set(raw)
        if lacking:
            raise UserError(f"missing keys: {', '.join(sorted(lacking))}")
        if raw["timeframe"] not in TIMEFRAMES:
            raise UserError(f"unknown timeframe {raw['timeframe']!r}")
        for where in raw.get("plugins", ()):
            load_plugin(where)
        runs = tuple(Run(**r) for r in raw["runs"])
        unknown = [r.strategy for r in runs if r.strategy not in STRATEGIES]
        if unknown or not runs or len({r.id for r in runs}) < len(runs):
            raise UserError(f"unknown strategy {unknown[0]!r}" if unknown else "runs need an id each, and one run at least")
        return Spec(raw["name"], raw["timeframe"], instant(str(raw["from"])), instant(str(raw["to"]), end=True), tuple(raw["universe"]), runs, **{k: float(raw[k]) for k in numbers if k in raw}, **{k: bool(raw[k]) for k in flags if k in raw})


def book_of(panel: DataFrame, spec: Spec, run: Run) -> tuple[DataFrame, DataFrame]:
    """(fills, equity curve) of one run, with run_id.  Rows' own fee_bps counts where the panel has it."""
    panel = total_return(with_adj_close(panel)) if spec.total_return else panel
    rows = broker.desired(panel, STRATEGIES[run.strategy](panel, **run.params), spec.allow_short)
    drifts = spec.drift if run.drift is None else run.drift
    fee = F.col("fee_bps") if "fee_bps" in panel.columns else spec.fee_bps
    banded = any(spec.band_rule.values())
    rows = broker.drifting(rows, spec.fee_bps, **spec.band_rule) if drifts else broker.banded(rows, **spec.band_rule) if banded else broker.constant_mix(rows)
    rows = broker.with_returns(rows, fee)
    curve = broker.equity(broker.portfolio(rows), spec.initial_equity)
    return broker.fills(rows, curve, fee).withColumn("run_id", F.lit(run.id)), curve.withColumn("run_id", F.lit(run.id))


def run_spec(panel: DataFrame, spec: Spec) -> DataFrame:
    """Equity curves of all runs, with run_id: one lazy plan, no loop over rows."""
    return reduce(DataFrame.unionByName, (book_of(panel, spec, run)[1] for run in spec.runs))


def compare(panel: DataFrame, spec: Spec, sessions: int = 0) -> list[dict]:
    """Scores of all runs over the stamps at which the slowest is ready, in the order of the runs; with trades, and where a run is buy_hold its return as the others' baseline."""
    ready = {run.id: ready_bars(run, sessions) for run in spec.runs}
    most = max(ready.values())
    stamps = panel.select("ts_utc").distinct().orderBy("ts_utc").limit(most + 1).agg(F.max("ts_utc").alias("at"), F.count("*").alias("n")).first()
    if stamps.n <= most:
        raise MarketError(f"the panel has {stamps.n} stamps, and {most} go by before the runs are ready")
    out = []
    for run in spec.runs:
        fills, curve = (x.where(F.col("ts_utc") >= F.lit(stamps.at)) for x in book_of(panel, spec, run))
        plan = metrics.sip(curve).agg(F.max_by("contributed", "ts_utc").alias("sip_contributed"), F.max_by("wealth", "ts_utc").alias("sip_value"), F.min("sip_drawdown").alias("sip_max_drawdown"))
        row = {"run_id": run.id, "strategy": run.strategy, "ready_bars": ready[run.id], "start_ts": stamps.at, "trades": fills.count()}
        out.append(row | metrics.metrics(curve).first().asDict() | metrics.excess(curve).first().asDict() | plan.first().asDict())
        out[-1]["sip_cagr"] = metrics.sip_rate(metrics.sip(curve)).first()[0]
    base = next((r["total_return"] for r in out if r["strategy"] == "buy_hold"), None)
    for r in out:
        r["baseline_return"], r["excess_return"] = base, None if base is None else r["total_return"] - base
    return out


#: Columns of the text table: heading, key, width, decimals.
SCORES = (("return", "total_return", 10, 4), ("cagr", "cagr", 10, 4), ("maxdd", "max_drawdown", 10, 4), ("trades", "trades", 7, 0), ("win", "win_rate", 8, 4), ("turnover", "turnover", 9, 4), ("sip", "sip_value", 12, 2), ("paid", "sip_contributed", 10, 2), ("sipirr", "sip_cagr", 10, 4), ("excess", "excess_return", 10, 4))


def score_table(scores: list[dict]) -> str:
    """Scores as lines of text; what is not known stands as n/a."""
    lines = [f"{'run':<12} {'strategy':<14}" + "".join(f" {h:>{w}}" for h, _, w, _ in SCORES)]
    for r in scores:
        lines.append(f"{r['run_id']:<12} {r['strategy']:<14}" + "".join(f" {'n/a':>{w}}" if r.get(k) is None else f" {r[k]:>{w}.{d}f}" for _, k, w, d in SCORES))
    return "\n".join(lines)


def stored_panel(store: Store, spec: Spec) -> DataFrame:
    """Bars of the spec's names; names without any are an error."""
    rows = store.bars().where(F.col("instrument_id").isin(*spec.universe) & (F.col("timeframe") == spec.timeframe) & F.col("ts_utc").between(F.lit(spec.start), F.lit(spec.end)))
    have = {r[0] for r in rows.select("instrument_id").distinct().collect()}
    lacking = [x for x in spec.universe if x not in have]
    if lacking:
        raise NotCovered(f"no {spec.timeframe} bars of {', '.join(lacking)}")
    return rows


def bars_answer(store: Store, instrument_id: str, timeframe: str, start: datetime, end: datetime, limit: int = 10_000, to: str | None = None, zone: str = "UTC") -> dict:
    """The first ``limit`` bars as plain values with ISO times in UTC, and whether there are more; optionally resampled."""
    if not 1 <= limit <= MOST_ROWS:
        raise UserError(f"limit must be from 1 to {MOST_ROWS}")
    rows = store.scan(instrument_id, timeframe, start, end)
    rows = resample(rows, to, zone) if to else rows
    iso = F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_utc")
    got = rows.orderBy("ts_utc").select(iso, "open", "high", "low", "close", "volume").limit(limit + 1).collect()
    return {"instrument_id": instrument_id, "timeframe": to or timeframe, "truncated": len(got) > limit, "bars": [r.asDict() for r in got[:limit]]}


def chart_answer(store: Store, instrument_id: str, timeframe: str, start: datetime, end: datetime, most: int = 20_000, zone: str = "UTC") -> dict:
    """Bars for a chart: above ``most`` of them, of the finest timeframe that has no more."""
    n = store.scan(instrument_id, timeframe, start, end).count()
    target = downsample_target(timeframe, n, most)
    answer = bars_answer(store, instrument_id, timeframe, start, end, MOST_ROWS, None if target == timeframe else target, zone)
    return answer | {"native_bars": n, "note": "" if target == timeframe else f"{timeframe} shown as {target} ({n} bars)"}


def coverage_answer(store: Store, instrument_id: str | None = None) -> list[dict]:
    return [{k: v.isoformat() + "Z" if isinstance(v, datetime) else v for k, v in r.asDict().items()} for r in store.coverage(instrument_id).collect()]


def main(argv: list[str] | None = None) -> int:
    """read, coverage, strategies and run; errors of the caller give exit code 2."""
    parser = argparse.ArgumentParser(prog="marketlab")
    parser.add_argument("--store", default="bars")
    commands = parser.add_subparsers(dest="command", required=True)
    read = commands.add_parser("read")
    for name in ("instrument_id", "timeframe", "start", "end"):
        read.add_argument(name)
    read.add_argument("--limit", type=int, default=10_000)
    read.add_argument("--to", choices=list(TIMEFRAMES))
    read.add_argument("--zone", default="UTC")
    commands.add_parser("coverage").add_argument("instrument_id", nargs="?")
    commands.add_parser("strategies")
    run = commands.add_parser("run")
    run.add_argument("spec")
    run.add_argument("--table", action="store_true")
    args = parser.parse_args(argv)
    try:
        if args.command == "strategies":
            answer = sorted(STRATEGIES)
        else:
            spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
            store = Store(spark, args.store)
            if args.command == "read":
                answer = bars_answer(store, args.instrument_id, args.timeframe, instant(args.start, args.zone), instant(args.end, args.zone, True), args.limit, args.to, args.zone)
            elif args.command == "coverage":
                answer = coverage_answer(store, args.instrument_id)
            else:
                with open(args.spec) as f:
                    spec = Spec.parse(json.load(f))
                answer = {r["run_id"]: r for r in compare(stored_panel(store, spec), spec)}
                if args.table:
                    print(score_table(list(answer.values())))
                    return 0
    except UserError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(answer, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
