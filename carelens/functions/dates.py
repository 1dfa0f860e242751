"""Date and time expressions used by the reports.

All inputs are wall-clock values (``DATE`` / ``TIMESTAMP_NTZ``); nothing here depends on
the session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed output formats of the reports (text rendering happens last, on typed values).
FORMAT_DMY = "dd/MM/yyyy"
FORMAT_DMONY = "dd-MMM-yyyy"
FORMAT_ISO = "yyyy-MM-dd"
FORMAT_RAW = "yyyy-MM-dd HH:mm:ss"


def as_column(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, dt.date):
        return F.lit(value)
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def day_after(day) -> Column:
    """Midnight after ``day``: ``ts < day_after(d)`` means "on or before d" (whole day included)."""
    return F.to_timestamp_ntz(F.date_add(as_column(day).cast("date"), 1).cast("string"))


def end_of_day(day: dt.date) -> dt.datetime:
    """Last instant of a day, for inclusive ``<=`` cutoffs."""
    return dt.datetime.combine(day, dt.time(23, 59, 59, 999999))


def midnight(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(0, 0))


def quarter_end(day) -> Column:
    """Last day of the calendar quarter that contains ``day``."""
    return F.last_day(F.add_months(F.trunc(as_column(day).cast("date"), "quarter"), 2))


def quarter_end_py(day: dt.date) -> dt.date:
    month = ((day.month - 1) // 3) * 3 + 3
    nxt = dt.date(day.year + (month // 12), month % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


def minus_months_py(day: dt.date, months: int) -> dt.date:
    """Calendar month subtraction that clamps to the month end (31 May - 3 months = 29 Feb)."""
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    m += 1
    for d in range(day.day, 27, -1):
        try:
            return dt.date(y, m, d)
        except ValueError:
            continue
    return dt.date(y, m, day.day)


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def whole_years(start, end) -> Column:
    """Completed years from ``start`` to ``end`` (month, day and time of day respected)."""
    return F.timestamp_diff("YEAR", _ntz(as_column(start)), _ntz(as_column(end))).cast("int")


def whole_months(start, end) -> Column:
    return F.timestamp_diff("MONTH", _ntz(as_column(start)), _ntz(as_column(end))).cast("int")


def add_whole_days(day, days) -> Column:
    """``day`` + ``days`` rounded to whole days (fractional refill counts round half up)."""
    return F.date_add(as_column(day).cast("date"), F.round(as_column(days)).cast("int"))


def outcome_status(last_pickup, refill_days, grace_days, end) -> Column:
    """'Active' when pickup + refill + grace reaches ``end`` (inclusive), else 'LTFU'.

    Any unknown input gives 'LTFU', never NULL.
    """
    due = F.date_add(as_column(last_pickup).cast("date"),
                     (F.round(as_column(refill_days)) + F.round(as_column(grace_days))).cast("int"))
    return F.when(due >= as_column(end).cast("date"), F.lit("Active")).otherwise(F.lit("LTFU"))


def display_date(c: Column, fmt: str = FORMAT_DMY) -> Column:
    return F.date_format(c, fmt)


def parse_report_date(text, fmt: str = FORMAT_DMY) -> Column:
    """A report's text date back to DATE; malformed text gives NULL (never a runtime error)."""
    return F.try_to_date(as_column(text), fmt)
