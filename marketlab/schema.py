"""Table schemas: the one place that names stored columns and their order."""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(ddl: str) -> T.StructType:
    """A schema from its text, without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


BAR = _struct(
    "instrument_id string, source string, timeframe string, ts_utc timestamp, open double, high double, low double, close double, volume double, is_partial boolean, quality string, adj_close double"
)
COVERAGE = _struct("instrument_id string, timeframe string, source string, start_utc timestamp, end_utc timestamp")
INSTRUMENT = _struct(
    "instrument_id string, asset_class string, venue string, symbol string, session_tz string, aliases array<string>, alternatives array<string>, pair_created_at timestamp, base_token string, quote_token string"
)
#: Columns of a polled pair.
SNAPSHOT = (
    "source string, chain_id string, dex_id string, pair_address string, base_symbol string, quote_symbol string, base_address string, quote_address string, price_usd double, "
    "price_native double, liquidity_usd double, volume_m5 double, volume_h1 double, volume_h6 double, volume_h24 double, price_change_h24 double, fdv double, market_cap double, "
    "pair_created_at timestamp, polled_at_utc timestamp, quality string, url string"
)
#: Stored timeframes, finest first, with their minutes.
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}


def missing(schema: T.StructType, columns: list[str], optional: tuple[str, ...] = ("adj_close",)) -> list[str]:
    """Required columns of a schema that a frame lacks."""
    return [f.name for f in schema if f.name not in columns and f.name not in optional]


def coarser(timeframe: str) -> str | None:
    """The next coarser timeframe."""
    names = list(TIMEFRAMES)
    at = names.index(timeframe) + 1
    return names[at] if at < len(names) else None


def downsample_target(timeframe: str, bars: int, most: int = 20_000) -> str:
    """The finest timeframe, from this one up, in which so many bars become ``most`` or fewer."""
    target = timeframe
    while bars * TIMEFRAMES[timeframe] / TIMEFRAMES[target] > most and coarser(target):
        target = coarser(target)
    return target
