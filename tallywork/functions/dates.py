"""Column functions over dates and report periods. Periods are half-open."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _months(period: str) -> int:
    if period not in PERIOD_MONTHS:
        raise ValueError(f"period must be one of {sorted(PERIOD_MONTHS)}")
    return PERIOD_MONTHS[period]


def as_date(value: Column | str | dt.date) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def period_start(day: Column, period: str = "month") -> Column:
    _months(period)
    return F.trunc(day, period)


def period_end(day: Column, period: str = "month") -> Column:
    """First day after the period that holds the day."""
    return F.add_months(period_start(day, period), _months(period))


def previous_period_start(day: Column, period: str = "month") -> Column:
    return F.add_months(period_start(day, period), -_months(period))


def period_label(start: Column, period: str = "month") -> Column:
    if period == "month":
        return F.date_format(start, "MMM yyyy")
    if period == "quarter":
        return F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), F.year(start).cast("string"))
    return F.year(start).cast("string")


def period_starts(as_of: Column | str | dt.date, count: int, period: str = "month") -> Column:
    """Array of the last `count` period starts up to the one that holds as_of."""
    last = period_start(as_date(as_of), period)
    step = _months(period)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.add_months(last, -i * step))


def with_periods(df: DataFrame, as_of: str | dt.date, count: int, period: str = "month") -> DataFrame:
    """One row per input row and period: the spine that keeps empty periods in a report."""
    return df.withColumn("period_start", F.explode(period_starts(as_of, count, period)))


def exclusive_end(last_day: Column) -> Column:
    return F.date_add(last_day, 1)


def days_in_range(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def days_left_in_month(day: Column) -> Column:
    """Days of the month from this one on, itself included."""
    return F.datediff(F.last_day(day), day) + 1


def in_range(day: Column, start: Column | str | dt.date, end: Column | str | dt.date) -> Column:
    return (day >= as_date(start)) & (day < as_date(end))


def monday_week_key(day: Column) -> Column:
    """Year and week of year, weeks starting on Monday, week 00 before the first Monday."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat_ws("-", F.year(day).cast("string"), F.lpad(week.cast("string"), 2, "0"))


def next_monthly(last: Column, after: Column) -> Column:
    """First monthly repeat of `last` on or after `after`, at least one month later.

    The day is always clamped from the original day.
    """
    gap = (F.year(after) - F.year(last)) * 12 + F.month(after) - F.month(last)
    k = F.greatest(F.lit(1), gap)
    near = F.add_months(last, k)
    return F.when(near >= after, near).otherwise(F.add_months(last, k + 1))


def _next_phase(ref: Column, after: Column, step: int) -> Column:
    """First later-than-`after` date that is n >= 1 steps from `ref`."""
    n = F.greatest(F.lit(1), F.floor(F.datediff(after, ref) / F.lit(step)).cast("int") + 1)
    return F.date_add(ref, n * step)


def next_due(cadence: Column, day_of_month: Column, reference: Column, today: Column) -> Column:
    """Next due date of a commitment; null when nothing anchors it.

    A monthly item is placed in the month after `today`.
    """
    anchor = F.least(
        F.coalesce(day_of_month, F.dayofmonth(reference), F.lit(1)), F.dayofmonth(F.last_day(today))
    )
    monthly = next_monthly(F.date_add(F.trunc(today, "month"), anchor - 1), today)
    weekly = F.date_add(today, F.pmod(F.weekday(reference) - F.weekday(today), F.lit(7)))
    return (
        F.when(cadence == "monthly", monthly)
        .when(reference.isNull(), F.lit(None).cast("date"))
        .when(cadence == "one_time", F.when(reference >= today, reference))
        .when(cadence == "weekly", weekly)
        .when(cadence == "biweekly", _next_phase(reference, today, 14))
        .when(cadence == "quarterly", _next_phase(reference, today, 91))
        .when(cadence == "annual", _next_phase(reference, today, 365))
    )


def next_charge(cadence: Column, last: Column, today: Column) -> Column:
    """Predicted next charge of a detected cadence."""
    since = F.datediff(today, last)
    annual = F.add_months(last, 12)
    quarters = F.greatest(F.lit(1), F.ceil(since / F.lit(90)).cast("int"))
    return (
        F.when(cadence == "annual", F.when(annual >= today, annual).otherwise(F.add_months(last, 24)))
        .when(cadence == "weekly", F.date_add(today, 7 - F.pmod(since, F.lit(7))))
        .when(cadence == "biweekly", F.date_add(today, 14 - F.pmod(since, F.lit(14))))
        .when(cadence == "quarterly", F.date_add(last, quarters * 90))
        .otherwise(next_monthly(last, today))
    )
