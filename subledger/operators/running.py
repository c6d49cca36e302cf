"""Running sums and row positions within groups that survive skewed groups.

A plain ``Window.partitionBy(g).orderBy(o)`` sends every row of a group to
one task.  If one contract holds a third of all invoices that task holds a
third of the data.  Here the groups are split in two:

* **cold** groups (at most ``hot_rows`` rows) use the ordinary window: one
  hash exchange on the group key, and none at all if the input is already
  partitioned by it (e.g. straight after a sort-merge join on that key);
* **hot** groups are range-partitioned on (group, order), so one of them spans
  many partitions.  Each partition computes its local running sum per group.
  In a range-partitioned frame only the first group of a partition can have
  rows in earlier partitions, so the offsets table that adds what those hold
  has at most one row per partition; only that table is broadcast.

The list of hot keys has at most ``rows / hot_rows`` entries.  It is joined
without a hint: the planner broadcasts it by its measured size or shuffles.

The result is exact either way: the split only decides *where* a group's
positions are computed, never *which* rows take part.

The range-partitioned rows are written once with ``checkpoint()`` (to the
session's checkpoint folder, shared storage on a cluster) before the local
sums and the per-partition totals read them.  Both then see the same
partition ids even if an executor is lost: range bounds come from a sample,
and a recomputed sample need not equal the first one.

Whether any group is hot is decided by a probe (one aggregation over the
group keys, usually of a slimmer ``key_source``); without hot groups the
operator is exactly one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups larger than this many rows take the range-partitioned path.
# Configurable per session with ``subledger.skew.hotGroupRows``.
DEFAULT_HOT_ROWS = 2_000_000
HOT_ROWS_CONF = "subledger.skew.hotGroupRows"

_V = "__rs_v"
_PID = "__rs_pid"
_RUN = "__rs_run"
_TOT = "__rs_tot"
_OFF = "__rs_off"


def hot_rows_setting(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def _renamed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Give the key columns fresh names so a join back to the same lineage is unambiguous."""
    return df.select(*[F.col(c).alias(prefix + c) if c in cols else F.col(c) for c in df.columns])


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str], prefix: str) -> Column:
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[prefix + c])
        cond = e if cond is None else cond & e
    return cond


def _ranged_running(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    out_col: str,
    num_partitions: int | None,
) -> DataFrame:
    """Running sum of ``_V`` over range partitions plus offsets of earlier partitions.

    Without an explicit partition count the range exchange is left to AQE,
    which merges adjacent (still ordered) partitions of small inputs; the
    checkpoint then fixes whichever partition ids result.
    """
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = ranged.withColumn(_PID, F.spark_partition_id())
    # Pin rows to their partition id in shared storage (see module notes).
    ranged = ranged.checkpoint(eager=True)
    local_w = (
        Window.partitionBy(_PID, *group_cols)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumn(_RUN, F.sum(_V).over(local_w))
    totals = ranged.groupBy(_PID, *group_cols).agg(F.sum(_V).alias(_TOT))
    prev_w = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # Only a group that goes on from an earlier partition has an offset: at most one per partition.
    offsets = totals.select(
        _PID, *group_cols, F.sum(_TOT).over(prev_w).alias(_OFF), F.count(F.lit(1)).over(prev_w).alias("__rs_before")
    )
    offsets = offsets.where(F.col("__rs_before") > 0).drop("__rs_before")
    offsets = F.broadcast(_renamed(offsets, [_PID, *group_cols], "__o_"))
    joined = local.join(offsets, _null_safe_on(local, offsets, [_PID, *group_cols], "__o_"), "left")
    return joined.select(
        *[local[c] for c in df.columns if c != _V],
        (local[_RUN] + F.coalesce(offsets[_OFF], F.lit(0))).alias(out_col),
    )


def find_hot_keys(src: DataFrame, key_cols: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows in ``src``, or None if there are none.

    One aggregation (partial counts per task) and an emptiness probe.  At
    most ``rows / hot_rows`` keys can qualify.
    """
    hot_rows = hot_rows if hot_rows is not None else hot_rows_setting(src)
    hot = (
        src.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("__rs_n")).where(F.col("__rs_n") > hot_rows).select(*key_cols)
    )
    return None if hot.isEmpty() else hot


_PROBE = object()


def running_sum(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    value: Column,
    out_col: str,
    *,
    hot_rows: int | None = None,
    key_source: DataFrame | None = None,
    hot_keys=_PROBE,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = inclusive running sum of ``value`` within each group.

    ``order_cols`` should give a total order (add tie-breaks), otherwise rows
    that tie are numbered in an arbitrary order, as with any ROWS frame.
    Hot groups are found by probing ``key_source`` (default: ``df``), e.g.
    the fact table before a join, or passed in as ``hot_keys`` (a frame over
    a prefix of ``group_cols`` -- coarser keys are fine, every group still
    lands wholly on one side -- or None for "no hot groups").
    With no ``group_cols`` the whole frame is one group and is always
    range-partitioned.
    """
    group_cols = list(group_cols)
    base = df.withColumn(_V, value)
    nparts = num_partitions
    if not group_cols:
        return _ranged_running(base, [], order_cols, out_col, nparts)

    if hot_keys is _PROBE:
        src = key_source if key_source is not None else df
        hot_keys = find_hot_keys(src, group_cols, hot_rows)
    w = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if hot_keys is None:
        return base.withColumn(out_col, F.sum(_V).over(w)).drop(_V)

    key_cols = list(hot_keys.columns)
    if key_cols != group_cols[: len(key_cols)]:
        raise ValueError("hot_keys must be keyed by a prefix of group_cols")
    hk = _renamed(hot_keys, key_cols, "__h_").withColumn("__rs_hot", F.lit(True))
    marked = base.join(hk, _null_safe_on(base, hk, key_cols, "__h_"), "left").select(
        *[base[c] for c in base.columns], hk["__rs_hot"]
    )
    cold = marked.where(F.col("__rs_hot").isNull()).drop("__rs_hot")
    cold = cold.withColumn(out_col, F.sum(_V).over(w)).drop(_V)
    hot = marked.where(F.col("__rs_hot")).drop("__rs_hot")
    hot = _ranged_running(hot, group_cols, order_cols, out_col, nparts)
    return cold.unionByName(hot)


def row_position(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    out_col: str,
    **kw,
) -> DataFrame:
    """1-based ``row_number()`` within each group (ties numbered consecutively), as a long."""
    out = running_sum(df, group_cols, order_cols, F.lit(1), out_col, **kw)
    return out.withColumn(out_col, F.col(out_col).cast("long"))
