"""Scorecards of an equity curve (ts_utc, equity, r, turnover, gross, cash_weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.windows import safe_div


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 where b is 0 or unknown."""
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def drawdown(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def calendar_years(curve: DataFrame) -> DataFrame:
    """Compounded return of each UTC year."""
    return curve.groupBy(F.year("ts_utc").alias("year")).agg((F.product(F.col("r") + 1) - 1).alias("ret"))


def metrics(curve: DataFrame) -> DataFrame:
    """One row.  The first row's equity is the base of the total return, while its r counts in means, risk and win rate.  Ratios without risk, and risk of one row, are 0."""
    rows = drawdown(curve)
    out = rows.agg(
        F.count("*").alias("n"), F.min_by("equity", "ts_utc").alias("e0"), F.max_by("equity", "ts_utc").alias("e1"), F.min("drawdown").alias("max_drawdown"),
        ((F.max(F.unix_micros("ts_utc")) - F.min(F.unix_micros("ts_utc"))) / 86_400_000_000).alias("days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), F.lit(2)))).alias("down"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum("turnover").alias("turnover"), F.avg("gross").alias("mean_gross"), F.avg("cash_weight").alias("mean_cash"),
    )
    years = F.when(F.col("days") > 0, F.col("days")).otherwise(1.0) / 365.25
    out = out.withColumn("years", years).withColumn("total_return", F.col("e1") / F.col("e0") - 1)
    out = out.withColumn("sd", F.coalesce("sd", F.lit(0.0)))
    out = out.withColumn("cagr", F.pow(F.col("total_return") + 1, F.lit(1.0) / F.col("years")) - 1).withColumn("per_year", F.col("n") / F.col("years"))
    out = out.withColumn("ann_vol", F.col("sd") * F.sqrt("per_year")).withColumn("sharpe", ratio(F.col("mean"), F.col("sd")) * F.sqrt("per_year"))
    out = out.withColumn("sortino", ratio(F.col("mean"), F.col("down")) * F.sqrt("per_year")).withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown")))
    return out.withColumn("annual_turnover", F.col("turnover") / F.col("years")).drop("e0", "e1", "mean", "sd", "down", "days")


def sip(curve: DataFrame, amount: float = 100.0) -> DataFrame:
    """Wealth of a plan that adds an amount on the first stamp of each UTC month after that stamp's return.

    w = w (1 + r) + c has the closed form P_t * sum(c / P_s) with P the running product, while no 1 + r is 0.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("ts_utc")
    month = F.date_trunc("month", "ts_utc")
    rows = curve.withColumn("__m", month).withColumn("__new", F.coalesce(F.lag("__m").over(w) != F.col("__m"), F.lit(True)))
    rows = rows.withColumn("contribution", F.when(F.col("__new"), float(amount)).otherwise(0.0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__p", F.product(F.col("r") + 1).over(run))
    rows = rows.withColumn("wealth", F.col("__p") * F.sum(F.col("contribution") / F.col("__p")).over(run)).withColumn("contributed", F.sum("contribution").over(run))
    return rows.withColumn("sip_drawdown", F.col("wealth") / F.max("wealth").over(run) - 1).select("ts_utc", "contribution", "contributed", "wealth", "sip_drawdown")


def xirr(flows: list[tuple[float, float]]) -> float | None:
    """Yearly rate (365 days) at which flows (days, amount) are worth nothing: bisection between -0.999999 and a doubled bound."""

    def value(rate: float) -> float:
        return sum(a / (1 + rate) ** (d / 365) for d, a in flows)

    low, high = -0.999999, 1.0
    if not flows or not any(a > 0 for _, a in flows) or not any(a < 0 for _, a in flows):
        return None
    while value(low) * value(high) > 0 and high < 1e9:
        high *= 2
    if value(low) * value(high) > 0:
        return None
    for _ in range(128):
        mid = (low + high) / 2
        low, high = (mid, high) if value(low) * value(mid) > 0 else (low, mid)
    return (low + high) / 2


def excess(curve: DataFrame) -> DataFrame:
    """One row: Sharpe and Sortino of returns above the cash rate (daily_tbill), the risk of Sharpe that of raw returns, and the best and worst UTC year."""
    span = (F.max(F.unix_micros("ts_utc")) - F.min(F.unix_micros("ts_utc"))) / 86_400_000_000
    over = F.col("r") - (F.coalesce("daily_tbill", F.lit(0.0)) if "daily_tbill" in curve.columns else F.lit(0.0))
    out = curve.agg(F.count("*").alias("n"), span.alias("days"), F.avg(over).alias("mean"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.pow(F.least(over, F.lit(0.0)), F.lit(2)))).alias("down"))
    scale = F.sqrt(F.col("n") / (F.when(F.col("days") > 0, F.col("days")).otherwise(1.0) / 365.25))
    out = out.select((ratio(F.col("mean"), F.col("sd")) * scale).alias("sharpe_excess"), (ratio(F.col("mean"), F.col("down")) * scale).alias("sortino_excess"))
    years = calendar_years(curve).agg(F.max(F.struct("ret", -F.col("year"))).alias("b"), F.min(F.struct("ret", "year")).alias("w"))
    years = years.select((-F.col("b.col2")).alias("best_year"), F.col("b.ret").alias("best_year_return"), F.col("w.year").alias("worst_year"), F.col("w.ret").alias("worst_year_return"))
    return out.join(years, F.lit(True))


def aligned(curves: DataFrame, ready: dict[str, int]) -> DataFrame:
    """Curves of several runs (run_id) without the first stamps, as many as the slowest run needs to be ready; an error if none is left."""
    most = max(ready.values(), default=0)
    w = Window.partitionBy("run_id").orderBy("ts_utc")
    out = curves.withColumn("__k", F.row_number().over(w)).where(F.col("__k") > most).drop("__k")
    if out.isEmpty():
        raise ValueError(f"no stamps are left after {most} to get ready")
    return out


def run_returns(curves: DataFrame, baseline: str) -> DataFrame:
    """Total return of each run and its excess over the baseline run's."""
    each = curves.groupBy("run_id").agg((F.max_by("equity", "ts_utc") / F.min_by("equity", "ts_utc") - 1).alias("total_return"))
    base = each.where(F.col("run_id") == baseline).select(F.col("total_return").alias("__b"))
    return each.join(base, F.lit(True), "left").withColumn("excess", F.col("total_return") - F.col("__b")).drop("__b")


def month_ends(curve: DataFrame) -> DataFrame:
    """The last equity of each UTC month, from a start of 100."""
    return curve.groupBy(F.date_trunc("month", "ts_utc").alias("month")).agg(F.max("ts_utc").alias("ts_utc"), (F.max_by("equity", "ts_utc") * 100).alias("growth"))


def month_end_allocation(targets: DataFrame) -> DataFrame:
    """Weights in force at each month's end: a name's last known target; cash is what positive weights leave."""
    stamps = targets.groupBy(F.date_trunc("month", "ts_utc").alias("month")).agg(F.max("ts_utc").alias("ts_utc"))
    known = targets.where("weight is not null").select("instrument_id", F.date_trunc("month", "ts_utc").alias("month"), "ts_utc", "weight")
    known = known.groupBy("instrument_id", "month").agg(F.max_by("weight", "ts_utc").alias("weight"))
    # every name at every month's end is the result; months are few, and go to the names
    grid = targets.select("instrument_id").distinct().crossJoin(F.broadcast(stamps))
    w = Window.partitionBy("instrument_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(known, ["instrument_id", "month"], "left").withColumn("weight", F.coalesce(F.last("weight", ignorenulls=True).over(w), F.lit(0.0)))
    cash = F.lit(1.0) - F.sum(F.greatest("weight", F.lit(0.0))).over(Window.partitionBy("month"))
    return rows.withColumn("cash", cash).select("ts_utc", "instrument_id", "weight", "cash")


def sip_rate(plan: DataFrame) -> DataFrame:
    """One row: the yearly rate of a plan (ts_utc, contribution, wealth).  Only its contributions and last wealth, a row a month, go to one task."""
    import pandas as pd

    from marketlab.workers import importable

    importable(plan.sparkSession)
    last = plan.agg(F.max("ts_utc").alias("ts_utc"), F.max_by("wealth", "ts_utc").alias("amount"))
    flows = plan.where("contribution <> 0").select("ts_utc", (-F.col("contribution")).alias("amount")).unionByName(last)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        days = (pdf["ts_utc"] - pdf["ts_utc"].min()).dt.total_seconds() / 86_400
        return pd.DataFrame({"xirr": [xirr(list(zip(days, pdf["amount"], strict=True)))]})

    return flows.groupBy().applyInPandas(run, "xirr double")
