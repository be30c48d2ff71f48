"""Calendar columns and ranges. All of them stay on zone-free timestamps and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.domains import HISTORY_PERIODS, MAX_HISTORY_YEARS


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def day_of(ts: Column | str) -> Column:
    return F.to_date(_c(ts))


def hour_of(ts: Column | str) -> Column:
    """Start of the hour, still without a zone (``date_trunc`` would go through the session zone)."""
    return day_of(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(_c(ts)))


def week_of(day: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(_c(day), "week")


def month_of(day: Column | str) -> Column:
    return F.trunc(_c(day), "month")


def quarter_of(day: Column | str) -> Column:
    return F.trunc(_c(day), "quarter")


GRAINS = {"day": day_of, "week": week_of, "month": month_of, "quarter": quarter_of}


def year_month(ts: Column | str) -> Column:
    return F.year(_c(ts)) * 100 + F.month(_c(ts))


def in_zone(facts: DataFrame, zone: str, ts: str = "txn_date") -> DataFrame:
    """Facts with their UTC times shown as local times of ``zone``, for summaries by local hour or day."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    shifted = facts.withColumn(ts, local)
    return shifted.withColumn("txn_year_month", year_month(ts)) if "txn_year_month" in facts.columns else shifted


def ts_lit(value: dt.datetime | dt.date | str) -> Column:
    """A zone-free timestamp literal that is folded before it reaches the scan."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def as_datetime(value: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def in_range(facts: DataFrame, start, end, ts: str = "txn_date", *, closed_end: bool = False,
             open_start: bool = False) -> DataFrame:
    """Rows of a time range.

    The layout column ``txn_year_month`` is bounded too when the table has it,
    because partitions cannot be pruned from a predicate on ``txn_date`` alone.
    """
    condition = F.lit(True)
    column = F.col(ts)
    if start is not None:
        low = ts_lit(start)
        condition = condition & ((column > low) if open_start else (column >= low))
    if end is not None:
        high = ts_lit(end)
        condition = condition & ((column <= high) if closed_end else (column < high))
    if ts == "txn_date" and "txn_year_month" in facts.columns:
        if start is not None:
            first = as_datetime(start)
            condition = condition & (F.col("txn_year_month") >= first.year * 100 + first.month)
        if end is not None:
            last = as_datetime(end)
            condition = condition & (F.col("txn_year_month") <= last.year * 100 + last.month)
    return facts.filter(condition)


def months_before(moment: dt.datetime, months: int) -> dt.datetime:
    """Calendar months back, clamped to the month's last day."""
    index = moment.year * 12 + moment.month - 1 - months
    year, month = divmod(index, 12)
    following = dt.date(year + (month + 1) // 12, (month + 1) % 12 + 1, 1)
    last_day = (following - dt.timedelta(days=1)).day
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last_day))


def period_start(ts: Column | str, months: int) -> Column:
    """Column form of :func:`months_before`; keeps the time of day and the type."""
    return _c(ts) - F.make_ym_interval(F.lit(0), F.lit(months))


def history_window(as_of, period: str = "LAST_MONTH", start=None, end=None) -> tuple[dt.datetime, dt.datetime]:
    """Both closed ends of a history window; never reaches back more than seven years."""
    now = as_datetime(as_of)
    floor = months_before(now, 12 * MAX_HISTORY_YEARS)
    if period == "CUSTOM":
        low = as_datetime(start) if start is not None else floor
        high = as_datetime(end) if end is not None else now
    else:
        low, high = months_before(now, HISTORY_PERIODS[period]), now
    return max(low, floor), high


def relative_range(words: tuple[str, str] | list[str] | str, as_of) -> tuple[dt.date, dt.date]:
    """Resolve a semantic date range to a half-open pair of dates.

    Both ends are dates or phrases of one vocabulary; the last day named is included.
    """
    today = as_datetime(as_of).date()
    first, last = (words, words) if isinstance(words, str) else words
    return _range_start(first, today), _range_end(last, today)


def _shift(day: dt.date, months: int) -> dt.date:
    return months_before(dt.datetime(day.year, day.month, day.day), months).date()


def _range_start(words: str, today: dt.date) -> dt.date:
    month = today.replace(day=1)
    quarter = month.replace(month=3 * ((month.month - 1) // 3) + 1)
    starts = {"last month": _shift(month, 1), "last quarter": _shift(quarter, 3),
              "last year": dt.date(today.year - 1, 1, 1), "this month": month, "now": today}
    if words in starts:
        return starts[words]
    count, _, unit = words.partition(" ")
    if unit in ("months ago", "month ago"):
        return _shift(today, int(count))
    return dt.date.fromisoformat(words)


def _range_end(words: str, today: dt.date) -> dt.date:
    month = today.replace(day=1)
    quarter = month.replace(month=3 * ((month.month - 1) // 3) + 1)
    ends = {"last month": month, "last quarter": quarter, "last year": dt.date(today.year, 1, 1),
            "this month": _shift(month, -1), "now": today + dt.timedelta(days=1)}
    if words in ends:
        return ends[words]
    count, _, unit = words.partition(" ")
    if unit in ("months ago", "month ago"):
        return _shift(today, int(count)) + dt.timedelta(days=1)
    return dt.date.fromisoformat(words) + dt.timedelta(days=1)
