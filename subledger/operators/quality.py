"""Data-quality checks: duplicate keys, NULL keys, layer row counts, dedupe.

All are aggregations with map-side partial aggregation, so a key that holds
a third of the rows still reaches the reducer as one partial count per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str, out_key: str | None = None, count_col: str = "cnt") -> DataFrame:
    """(key, cnt) for every key value -- NULL included -- seen more than once."""
    return (
        df.groupBy(F.col(key).alias(out_key or key))
        .agg(F.count(F.lit(1)).alias(count_col))
        .where(F.col(count_col) > 1)
    )


def null_key_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is NULL."""
    return df.where(F.col(key).isNull())


def null_key_count(df: DataFrame, key: str, count_col: str = "cnt") -> DataFrame:
    """One row: how many rows have a NULL key."""
    return df.where(F.col(key).isNull()).agg(F.count(F.lit(1)).alias(count_col))


def count_compare(
    frames: Mapping[str, DataFrame],
    label_col: str = "layer",
    count_col: str = "cnt",
    known: Mapping[str, int | None] | None = None,
) -> DataFrame:
    """One (label, row count) row per frame, e.g. L2 vs L1 of the same table.

    A count in ``known`` (by label) is taken as it is and its frame not read.
    """
    out = None
    for label, df in frames.items():
        n = (known or {}).get(label)
        if n is None:
            one = df.agg(F.count(F.lit(1)).alias(count_col))
        else:
            one = constant_row(df, n, count_col)
        one = one.select(F.lit(label).alias(label_col), count_col)
        out = one if out is None else out.unionAll(one)
    return out


def constant_row(df: DataFrame, n: int, name: str) -> DataFrame:
    """One row with a number already known, in the session of ``df``."""
    return df.sparkSession.range(1).select(F.lit(n).cast("long").alias(name))


def row_metrics(key: str | None = None) -> list[Column]:
    """Metrics to observe while a frame is written: its rows and, with a key, those whose key is NULL."""
    rows = F.count(F.lit(1)).alias("rows")
    return [rows] if key is None else [rows, F.count_if(F.col(key).isNull()).alias("null_keys")]


def dedupe_by_key(df: DataFrame, key: str) -> DataFrame:
    """Keep one row per key value (NULL is one key).

    The kept row is the smallest by the remaining columns in order (NULLs
    first), so the choice is deterministic and survives recomputation.  It is
    a ``min`` aggregation, not a window: hot keys are combined map-side.
    """
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(key).agg(F.min(packed).alias("__kept")).select(key, *[F.col(f"__kept.{c}").alias(c) for c in rest]).select(*df.columns)
