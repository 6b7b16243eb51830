"""Time helpers: look-back windows relative to an explicit ``as_of``.

Every reference query is relative to ``now()``; here ``as_of`` is a parameter
so results are reproducible.  A literal ``as_of`` gives literal bounds on ``ts`` and,
for the stored flow table, on its month partition.  ``as_of=None`` means "latest ts
of the input", a scalar subquery; over the stored table it reads the newest month
only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: UI window names and their look-back; anything else is 24 hours
WINDOWS = {"15m": "15 MINUTES", "1h": "1 HOUR", "6h": "6 HOURS", "7d": "7 DAYS",
           "30d": "30 DAYS"}
DEFAULT_WINDOW = "24 HOURS"
# the dashboards variant falls back to 1 hour instead
DASHBOARD_WINDOWS = {"15m": "15 MINUTES", "1h": "1 HOUR", "6h": "6 HOURS",
                     "24h": "24 HOURS", "7d": "7 DAYS"}
DASHBOARD_DEFAULT = "1 HOUR"


def window_interval(window: str, dashboard: bool = False) -> str:
    if dashboard:
        return DASHBOARD_WINDOWS.get(window, DASHBOARD_DEFAULT)
    return WINDOWS.get(window, DEFAULT_WINDOW)


def interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


#: Partition column of the stored flow table.
MONTH = "yyyymm"


def month_of(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def as_of_col(df: DataFrame, as_of=None, ts: str = "ts") -> Column:
    """Column holding the reference instant."""
    if as_of is None:
        if MONTH in df.columns:
            df = df.filter(F.col(MONTH) == df.select(F.max(MONTH)).scalar())
        return df.select(F.max(ts)).scalar()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (dt.datetime, dt.date)):
        return F.lit(as_of).cast("timestamp")
    return F.to_timestamp(F.lit(str(as_of)))


def bounded(df: DataFrame, lo: Column, hi: Column | None = None, ts: str = "ts") -> DataFrame:
    """Rows with ``ts >= lo`` (and ``ts <= hi``), with the month bounds where the
    table has months, so other partitions aren't listed."""
    out = df.filter(F.col(ts) >= lo)
    if MONTH in df.columns:
        out = out.filter(F.col(MONTH) >= month_of(lo))
    if hi is not None:
        out = out.filter(F.col(ts) <= hi)
        if MONTH in df.columns:
            out = out.filter(F.col(MONTH) <= month_of(hi))
    return out


def since(df: DataFrame, window: str = "24h", as_of=None, ts: str = "ts",
          dashboard: bool = False, upper: bool = False) -> DataFrame:
    """Rows with ``ts >= as_of - window`` (and ``ts <= as_of`` when ``upper``)."""
    now = as_of_col(df, as_of, ts)
    return bounded(df, now - interval(window_interval(window, dashboard)), now if upper else None, ts)


def duck_since(window: str = "24h", table: str = "flows", ts: str = "ts",
               dashboard: bool = False, as_of: str | None = None) -> str:
    """The matching DuckDB predicate text for oracle SQL."""
    now = f"TIMESTAMP '{as_of}'" if as_of else f"(SELECT max({ts}) FROM {table})"
    return f"{ts} >= {now} - INTERVAL {window_interval(window, dashboard)}"


def hour_of_week(ts: Column) -> Column:
    """Monday 00h = 0 ... Sunday 23h = 167 (ClickHouse toDayOfWeek is Monday=1)."""
    return F.weekday(ts) * 24 + F.hour(ts)
