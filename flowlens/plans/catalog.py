"""Registered queries: each name maps to a Spark plan over the test tables and,
when SQL can express it, the equivalent DuckDB text used as the oracle.

Conventions shared by both sides: doubles rounded to 6 digits, arrays sorted
and joined with ',' into a string, every top-k ordered with a full tie-break.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(fn, sql)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, flatten arrays of scalars to sorted ','-joined strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
                f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.array_join(F.array_sort(c.cast("array<string>")), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)
