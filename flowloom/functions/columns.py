"""Scalar expressions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column) -> Column:
    """Sums of money in one type, whatever precision the input had."""
    return col.cast("decimal(38,4)")


def _whole(number: Column) -> Column:
    """The nearest long, halves away from zero."""
    return (F.signum(number) * F.floor(F.abs(number) + 0.5)).cast("bigint")


def fixed(number: Column, scale: int) -> Column:
    """A double as decimal(18, scale), by way of a long.

    Casting doubles to decimals goes through text for every row; rounding to a
    whole number of the smallest unit first is several times as fast.  Halves
    are rounded away from zero, as a cast does.
    """
    units = _whole(number * 10**scale).cast("decimal(18,0)")
    return _scaled(units, scale)


def _scaled(units: Column, scale: int) -> Column:
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return (units * unit).cast(f"decimal(18,{scale})")


def net_value(price: Column, discount: Column) -> Column:
    """``price * (1 - discount)`` as decimal(18,4), both given to the cent and per cent."""
    cents = _whole(price * 100)
    per_cent = 100 - _whole(discount * 100)
    return _scaled((cents * per_cent).cast("decimal(18,0)"), 4)


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """Quotient as a rounded double, NULL where ``whole`` is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def seconds(ts: Column) -> Column:
    """Whole seconds of a wall-clock timestamp; no time zone takes part."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def period_start(ts: Column, unit: str) -> Column:
    """Start of the period of a wall-clock timestamp, as one again.

    ``date_trunc`` goes by way of the session time zone; dates do not.
    """
    if unit == "day":
        start = ts.cast("date")
    elif unit in ("week", "month", "quarter", "year"):
        start = F.trunc(ts, unit)
    else:
        start = F.date_trunc(unit, ts)
    return start.cast("timestamp_ntz")


def json_field(props: Column, path: str, dtype: str) -> Column:
    """One typed field of a JSON text; NULL if the text or the field is bad."""
    return F.get_json_object(props, path).try_cast(dtype)


def route_label(src: Column, dst: Column) -> Column:
    """``007>012``: both ends padded so that labels sort like the keys."""
    label = F.format_string("%03d>%03d", src, dst)
    return F.when(src.isNotNull() & dst.isNotNull(), label)


def value_band(value: Column, low: float = 10_000, high: float = 50_000) -> Column:
    """Tier of one flow."""
    return (
        F.when(value.isNull(), "UNKNOWN")
        .when(value < low, "SMALL")
        .when(value < high, "MEDIUM")
        .otherwise("LARGE")
    )


def time_parts(ts: Column) -> dict[str, Column]:
    """Calendar fields; weeks start on Monday, which is 0."""
    return {
        "year": F.year(ts),
        "quarter": F.quarter(ts),
        "month": F.month(ts),
        "weekday": F.weekday(ts),
    }
