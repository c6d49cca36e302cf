"""Global quantiles without a single-task sort: exact by selection, or approximate in one pass.

``percentile_cont(x, p) over ()`` and ``percentile(x, p)`` both end in one
task holding every value (or every distinct value).  Here the values at the
wanted ranks are found by refining a histogram (:func:`values_at_ranks`): a pass
counts the values of ``BUCKETS`` equal parts of the value range, with the least
and greatest value of each; the part that holds a rank is divided in the next
pass, and only its values are looked at, until it has one value or few enough to
be listed.  Every pass is one aggregation whose partial results have at most
``BUCKETS`` rows a rank; nothing is sorted, and no pass shuffles the values.

The passes read the one column, written once to the checkpoint folder
(``reread`` says that the frame is a table already and needs no copy).

Two exact rank rules, and a one-pass one:

* ``"disc"`` -- nearest rank: the value at 1-based rank ``max(1, ceil(p*n))``.
  For p = 0 this is the minimum, for p = 1 the maximum.  It is an exact
  stand-in for the approximate ``approx_quantiles`` of the source warehouse.
* ``"cont"`` -- linear interpolation at 0-based position ``p*(n-1)``
  (``percentile_cont``): ``lo + (hi - lo) * frac``.
* ``"approx"`` -- a value whose rank is within ``n / accuracy`` of the ``"disc"``
  one.  One pass and one mergeable sketch per task, whose size depends on
  ``accuracy`` alone; lazy, where the exact rules run their passes when called.

Defined results: NULLs are left out; without other values every quantile is NULL;
NaN counts as greater than any other number, and infinities have their places.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a value range in one pass, and rows of a part that are listed.
BUCKETS = 2048
LISTED = 10_000
#: Accuracy of the one-pass rule: ranks are right to within n / ACCURACY.
ACCURACY = 10_000

_X = "__q_x"


def values_at_ranks(values: DataFrame, ranks: Sequence[int], buckets: int = BUCKETS, listed: int = LISTED) -> dict[int, object]:
    """The values at 1-based ranks of the single column of ``values`` (numbers, no NULL).

    Ranks beyond the number of rows are an error.  Each pass is one job.
    """
    col = values.columns[0]
    x = F.col(f"`{col}`")
    d = x.cast("double")
    finite = ~F.isnan(d) & (F.abs(d) < F.lit(math.inf))
    # numbers without a place on the scale are counted by themselves: -inf, then all finite ones, +inf, NaN
    place = F.when(finite, F.lit(1)).when(F.isnan(d), F.lit(3)).when(d < 0, F.lit(0)).otherwise(F.lit(2))
    found: dict[int, object] = {}
    open_: dict[tuple, list[tuple[int, int]]] = {}  # (least, greatest) value of a part -> (rank, rank within it)
    sizes: dict[tuple, int] = {}
    before = 0
    for r in sorted(values.groupBy(place.alias("place")).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: r["place"]):
        for rank in sorted(set(ranks)):
            if before < rank <= before + r["n"]:
                _enter(found, open_, rank, rank - before, r["n"], r["lo"], r["hi"])
        sizes[r["lo"], r["hi"]] = r["n"]
        before += r["n"]
    if any(not 1 <= r <= before for r in ranks):
        raise ValueError(f"ranks must be between 1 and {before}")
    while open_:
        parts = list(open_)
        rows, few = [], [i for i, p in enumerate(parts) if sizes.get(p, listed + 1) <= listed]
        for i, (lo, hi) in enumerate(parts):
            step = (float(hi) - float(lo)) / buckets
            if step == 0 or i in few:
                part = F.lit(0)
            elif step == math.inf:  # a range wider than any double: by sign first
                part = F.when(d < 0, F.lit(0)).otherwise(F.lit(1))
            else:
                # x - lo keeps the order of x, so the parts are in order even where doubles round
                part = F.least(F.floor((d - F.lit(float(lo))) / F.lit(step)), F.lit(buckets - 1))
            value = x if i in few or step == 0 else F.lit(None).cast(values.schema[col].dataType)
            rows.append(F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.struct(F.lit(i).alias("i"), part.cast("int").alias("part"), value.alias("value"))))
        seen = values.where(finite).select(x.alias(_X), F.explode(F.array_compact(F.array(*rows))).alias("p"))
        counts = seen.groupBy("p.i", "p.part", "p.value").agg(F.count(_X).alias("n"), F.min(_X).alias("lo"), F.max(_X).alias("hi")).collect()
        wanted, open_, sizes = open_, {}, {}
        for i, p in enumerate(parts):
            at = 0
            for c in sorted((c for c in counts if c["i"] == i), key=lambda c: c["lo"]):
                for rank, inside in wanted[p]:
                    if at < inside <= at + c["n"]:
                        _enter(found, open_, rank, inside - at, c["n"], c["lo"], c["hi"])
                        sizes[c["lo"], c["hi"]] = c["n"]
                at += c["n"]
        if set(open_) & set(parts):
            raise RuntimeError(f"a value range could not be divided: {sorted(open_)}")
    return {r: found[r] for r in ranks}


def _enter(found: dict, open_: dict, rank: int, inside: int, n: int, lo, hi) -> None:
    """A rank lies in a part of ``n`` values from ``lo`` to ``hi``, ``inside`` places from its begin."""
    if lo == hi or lo != lo or inside == 1:
        found[rank] = lo
    elif inside == n:
        found[rank] = hi
    else:
        open_.setdefault((lo, hi), []).append((rank, inside))


def quantile_values(df: DataFrame, col: str, probs: Sequence[float], method: str = "disc", reread: bool = False) -> list:
    """The quantiles as numbers (None without any value); ``method`` is ``"disc"`` or ``"cont"``."""
    if method not in ("disc", "cont"):
        raise ValueError("method is 'disc' or 'cont'")
    values = df.select(F.col(col).alias(_X)).where(F.col(_X).isNotNull())
    if not reread:
        values = values.checkpoint(eager=True)
    n = values.count()
    if not n:
        return [None] * len(probs)
    if method == "disc":
        ranks = [max(1, math.ceil(float(p) * n)) for p in probs]
        found = values_at_ranks(values, ranks)
        return [found[r] for r in ranks]
    at = [float(p) * (n - 1) for p in probs]
    found = values_at_ranks(values, sorted({r for a in at for r in (math.floor(a) + 1, math.ceil(a) + 1)}))
    out = []
    for a in at:
        lo, hi = (float(found[f(a) + 1]) for f in (math.floor, math.ceil))
        out.append(lo + (hi - lo) * (a - math.floor(a)))
    return out


def quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    names: Sequence[str],
    method: str = "disc",
    reread: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One-row frame with one column per probability (NULL if no non-NULL value)."""
    if len(probs) != len(names):
        raise ValueError("one name per probability")
    if method == "approx":
        sketch = F.percentile_approx(F.col(col), F.array(*[F.lit(float(p)) for p in probs]), F.lit(accuracy))
        return df.agg(sketch.alias(_X)).select(*[F.col(_X)[i].alias(name) for i, name in enumerate(names)])
    found = quantile_values(df, col, probs, method, reread)
    kind = df.select(F.col(col)).schema[0].dataType if method == "disc" else T.DoubleType()
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(v).cast(kind).alias(name) for name, v in zip(names, found, strict=True)])
