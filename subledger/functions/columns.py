"""Scalar and aggregate column expressions used across the layers.

All of them compile to JVM expressions that stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from subledger.constants import (
    BUSINESS_TZ,
    DURATION_BIN_BOUNDS,
    DURATION_BIN_LABELS,
    INVOICE_TYPE_LABELS,
    RESULT_DIGITS,
    VAT_RATE,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_SECONDS_PER_DAY = 86_400


def ntz_epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a ``TIMESTAMP_NTZ`` read as UTC.

    ``ntz - TIMESTAMP_NTZ'1970-01-01'`` is plain wall-clock arithmetic; a
    cast to an instant would go through the session time zone and shift
    wall-clock times in its DST gaps.  Sub-second digits are dropped: zone
    offsets are whole seconds, so a local day never starts inside a second.
    """
    c = _col(ts)
    return (c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second").cast("long")


def business_date(ts: Column | str, tz: str = BUSINESS_TZ) -> Column:
    """Local calendar date of a UTC wall-clock timestamp (``TIMESTAMP_NTZ``).

    The UTC seconds of the value become an instant, ``from_utc_timestamp``
    with a literal zone shifts it to local wall-clock time (zone rules
    resolved once, not parsed per row), and the day is cut from the seconds.
    Nothing depends on the session time zone, and it costs a fraction of
    ``convert_timezone`` per row.
    """
    local = F.from_utc_timestamp(F.timestamp_seconds(ntz_epoch_seconds(ts)), tz)
    return F.date_from_unix_date(F.floor(F.unix_seconds(local) / F.lit(_SECONDS_PER_DAY)).cast("int"))


# Zone at the end of a date/time text: Z, UTC or an offset after the time of day.
_ZONE = r"(?i)(?<=[0-9])\s*(Z|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"


def utc_instant_text(text: Column | str) -> Column:
    """A date/time text with its zone spelled out: no zone means UTC, no time midnight.

    Accepts ``T`` or a space before the time, a fraction of a second, and ``Z``,
    ``UTC`` or an offset (``+02:00``, ``+0200``, ``+2``) behind it.
    """
    t = F.trim(_col(text))
    t = F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t)
    zoned = t.rlike(r"[0-9]{1,2}-[0-9]{1,2}[T ].*") & t.rlike(_ZONE)
    t = F.regexp_replace(t, r"(?<=[0-9])\s*([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(zoned, t).otherwise(F.concat(t, F.lit(" UTC")))


def ntz_of_instant(instant: Column) -> Column:
    """The UTC wall-clock time (``TIMESTAMP_NTZ``) of an instant, whatever the session's zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def utc_ntz_of_text(text: Column | str, strict: bool = True) -> Column:
    """UTC wall-clock time of a date/time text; a bad text is an error, or NULL if not ``strict``.

    A plain ten-character date is that midnight; only other forms pass the patterns for times and zones.
    """
    plain = F.trim(_col(text))
    is_plain = (F.length(plain) == 10) & (F.substring(plain, 5, 1) == "-") & (F.substring(plain, 8, 1) == "-")
    t = utc_instant_text(text)
    if strict:
        return F.when(is_plain, plain.cast("timestamp_ntz")).otherwise(ntz_of_instant(t.cast("timestamp")))
    return F.when(is_plain, plain.try_cast("timestamp_ntz")).otherwise(ntz_of_instant(t.try_cast("timestamp")))


def business_date_of_text(text: Column | str, tz: str = BUSINESS_TZ) -> Column:
    """Business date of a date/time text (``date(timestamp(s), tz)``; offsets count, no zone is UTC)."""
    return business_date(utc_ntz_of_text(text), tz)


def flag(cond: Column) -> Column:
    """``if(cond, true, false)``: NULL conditions give false."""
    return F.when(cond, F.lit(True)).otherwise(F.lit(False))


def invoice_type_label(code: Column | str, labels: Mapping[int, str] = INVOICE_TYPE_LABELS) -> Column:
    """Invoice type code -> label; unknown codes give NULL (CASE without ELSE)."""
    c = _col(code)
    out = None
    for k, v in labels.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def net_of_vat(amount: Column | str, rate: float = VAT_RATE) -> Column:
    """Amount without VAT: 0 for non-positive amounts, NULL stays NULL."""
    a = _col(amount)
    return F.when(a <= 0, F.lit(0.0)).when(a > 0, a / F.lit(float(rate)))


def with_vat(amount: Column | str, rate: float = VAT_RATE) -> Column:
    return _col(amount) * F.lit(float(rate))


def duration_bin(
    days: Column | str,
    bounds: Sequence[int] = DURATION_BIN_BOUNDS,
    labels: Sequence[str] = DURATION_BIN_LABELS,
) -> Column:
    """First label whose inclusive upper bound holds; the last label otherwise (NULL too)."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("need exactly one more label than bounds")
    d = _col(days)
    out = F.when(d <= bounds[0], F.lit(labels[0]))
    for b, lab in zip(bounds[1:], labels[1:-1]):
        out = out.when(d <= b, F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))


def rounded(c: Column | str, digits: int | None = RESULT_DIGITS) -> Column:
    """Round a reported double; only the last select of a report does."""
    return _col(c) if digits is None else F.round(_col(c), digits)


#: Digits after the point that a term of an exact sum keeps.
SUM_DIGITS = 8


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles that no order of addition changes, as a double.

    Each term is held as two longs, its whole part and its fraction in units of
    10^-8, which are added as integers; only the two totals meet as decimals.  So a
    term counts as rounded to 8 digits, and nothing else is rounded before a
    report's last select.  A term that is not finite, or of 9 * 10^15 or more, is an
    error; so are totals beyond 64 bits.
    """
    x = _col(c).cast("double")
    bad = F.raise_error(F.concat(F.lit("exact_sum: cannot add "), x.cast("string"))).cast("bigint")
    whole = F.when(x.isNull(), F.lit(None)).when(F.abs(x) < F.lit(9e15), F.floor(x)).otherwise(bad)
    part = F.rint((x - F.floor(x)) * F.lit(10.0**SUM_DIGITS)).cast("bigint")
    unit = F.lit(Decimal(1).scaleb(-SUM_DIGITS)).cast(f"decimal({SUM_DIGITS + 1},{SUM_DIGITS})")
    return (F.sum(whole).cast("decimal(20,0)") + F.sum(part).cast("decimal(20,0)") * unit).cast("double")


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation: NULL for fewer than two pairs, NaN if a side does not vary.

    Only rows where both inputs are non-NULL take part, as in ``corr``.
    """
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    flat = (F.min(xx) == F.max(xx)) | (F.min(yy) == F.max(yy))
    ratio = F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
    return F.when(F.count_if(both) < 2, F.lit(None).cast("double")).when(flat, F.lit(float("nan"))).otherwise(ratio)
