"""Time arithmetic on TIMESTAMP_NTZ, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000


def whole(number: Column, unit: int) -> Column:
    """How many whole units, rounded down; exact for any BIGINT, unlike a division of doubles."""
    return F.call_function("div", number - F.pmod(number, F.lit(unit)), F.lit(unit))


def to_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 as BIGINT."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (days * F.lit(MICROS_PER_DAY)
            + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(ts).cast("bigint") * F.lit(60_000_000)
            + (seconds * 1_000_000).cast("bigint"))


def from_micros(micros: Column) -> Column:
    """Inverse of :func:`to_micros`."""
    day = whole(micros, MICROS_PER_DAY)
    rest = micros - day * F.lit(MICROS_PER_DAY)
    seconds = (rest.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), seconds)


def mean_micros(ts: Column) -> Column:
    """Aggregate: exact mean timestamp in whole microseconds.

    The sum is DECIMAL, since a BIGINT sum overflows after a few thousand rows.
    """
    total = F.sum(to_micros(ts).cast("decimal(20,0)"))
    count = F.count(ts)
    return ((total - F.pmod(total, count)) / count).cast("bigint")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour spans between two timestamps."""
    return whole(to_micros(later) - to_micros(earlier), MICROS_PER_DAY)


def calendar_days(later: Column, earlier: Column) -> Column:
    """Difference of the two dates; 1 for a short gap over midnight."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def plus_one_day(ts: Column) -> Column:
    return ts + F.expr("INTERVAL '1' DAY")


def parse_timestamp(text: Column, fmt: str, lenient: bool = False) -> Column:
    if lenient:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return F.to_timestamp_ntz(text, F.lit(fmt))
