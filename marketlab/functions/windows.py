"""Causal windows per instrument and the guarded expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "instrument_id", "ts_utc"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_time(*key: str) -> WindowSpec:
    return Window.partitionBy(*(key or (KEY,))).orderBy(TIME)


def last_rows(n: int) -> WindowSpec:
    if n < 1:
        raise ValueError("a window holds one row at least")
    return by_time().rowsBetween(1 - n, 0)


def so_far(*key: str) -> WindowSpec:
    return by_time(*key).rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, x: Column, n: int) -> Column:
    """``value`` over the last n rows where all n of x are known; null in warm-up and around holes."""
    return F.when(F.count(x).over(last_rows(n)) >= n, value.over(last_rows(n)))


def mean(x: Column | str, n: int) -> Column:
    return guarded(F.avg(col(x)), col(x), n)


def total(x: Column | str, n: int) -> Column:
    return guarded(F.sum(col(x)), col(x), n)


def highest(x: Column | str, n: int) -> Column:
    return guarded(F.max(col(x)), col(x), n)


def lowest(x: Column | str, n: int) -> Column:
    return guarded(F.min(col(x)), col(x), n)


def deviation(x: Column | str, n: int, ddof: int = 0) -> Column:
    """Rolling standard deviation; null where n does not exceed ddof."""
    if n <= ddof:
        return F.lit(None).cast("double")
    scaled = F.stddev_pop(col(x)) if ddof == 0 else F.stddev_samp(col(x)) if ddof == 1 else None
    if scaled is not None:
        return guarded(scaled, col(x), n)
    return F.sqrt(guarded(F.var_pop(col(x)), col(x), n) * n / (n - ddof))


def median(x: Column | str, n: int, least: int) -> Column:
    """Rolling median of what is known in the last n rows, given ``least`` values."""
    got = F.sort_array(F.collect_list(col(x)).over(last_rows(n)))
    size = F.size(got)
    middle = (F.get(got, ((size - 1) / 2).cast("int")) + F.get(got, (size / 2).cast("int"))) / 2
    return F.when(size >= least, middle)


def shift(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_time())


def change(x: Column | str, n: int = 1) -> Column:
    return col(x) - shift(x, n)


def filled(x: Column | str) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far())


def row(first: int = 0) -> Column:
    return F.row_number().over(by_time()) - 1 + first


def safe_div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, F.when(b != 0, b))
