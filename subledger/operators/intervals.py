"""Point-in-interval tests within a group, without forming pairs.

"Which products of a contract were active on a day another product of the
same contract ended" is a self-join whose pairs grow with the square of the
contract's size.  Here it is a sweep: point and interval-boundary events are
ordered by day inside each group, a running count of points gives, for every
interval, how many points fall in ``[lo, hi]``, and a second running count
per (group, id) removes the points that carry the interval's own id.  Both
running counts use :func:`subledger.operators.running.running_sum`, which
splits oversized groups across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.operators.running import find_hot_keys, running_sum

_DAY, _KIND = "__iv_day", "__iv_kind"
_P, _S = "__iv_p", "__iv_s"


def intervals_hit_by_other_points(
    intervals: DataFrame,
    points: DataFrame,
    group_col: str,
    id_col: str,
    lo_col: str,
    hi_col: str,
    at_col: str,
    keep_cols: Sequence[str] = (),
    **skew,
) -> DataFrame:
    """Distinct (group, id, *keep_cols, lo, hi) intervals for which a point of the
    same group with a *different* id lies in ``[lo, hi]`` (both inclusive).

    NULL group, id, bounds or point day never match (SQL comparison rules).
    """
    key = [group_col, id_col, *keep_cols, lo_col, hi_col]
    iv = intervals.select(*key).where(
        F.col(group_col).isNotNull()
        & F.col(id_col).isNotNull()
        & F.col(lo_col).isNotNull()
        & F.col(hi_col).isNotNull()
        & (F.col(lo_col) <= F.col(hi_col))
    )
    pts = points.select(
        F.col(group_col), F.col(id_col), F.col(at_col).alias(_DAY)
    ).where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull() & F.col(_DAY).isNotNull())
    # Only whether a point of another id exists matters.  Repeated points and intervals raise the
    # hits without making them, so neither passes a shuffle of its own to be made distinct.

    null_key = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in [*keep_cols, lo_col, hi_col]]
    # kind orders same-day events: interval start (0) < point (1) < interval end (2),
    # so a point on either boundary day counts as inside.
    point_ev = pts.select(group_col, id_col, *null_key, _DAY, F.lit(1).alias(_KIND))
    bound = [F.struct(F.col(c).alias(_DAY), F.lit(kind).alias(_KIND)) for c, kind in ((lo_col, 0), (hi_col, 2))]
    bound_ev = iv.select(*key, F.inline(F.array(*bound)))
    events = point_ev.unionByName(bound_ev)

    # The id spreads events of one day (the open-ended end day, say) over range partitions.
    order = [F.col(_DAY), F.col(_KIND), F.col(id_col)]
    is_point = (F.col(_KIND) == 1).cast("int")
    # One probe for both sweeps: a (group, id) slice is only hot inside a hot group.
    hot = find_hot_keys(events.select(group_col), [group_col], skew.get("hot_rows"))
    kw = {k: v for k, v in skew.items() if k != "hot_rows"}
    events = running_sum(events, [group_col], order, is_point, _P, hot_keys=hot, **kw)
    events = running_sum(events, [group_col, id_col], order, is_point, _S, hot_keys=hot, **kw)

    # Points of other ids inside [lo, hi] = (P(hi) - P(lo-)) - (S(hi) - S(lo-)).
    inside = (
        events.where(F.col(_KIND) != 1)
        .groupBy(*key)
        .agg(F.sum((F.col(_KIND) - 1) * (F.col(_P) - F.col(_S))).alias("__iv_hits"))
    )
    return inside.where(F.col("__iv_hits") > 0).select(*key)
