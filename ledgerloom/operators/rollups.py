"""Hourly, daily and monthly summaries of payment facts, the weekly digest, and new marks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import empty_for_null
from ledgerloom.functions.periods import as_datetime, day_of, hour_of, in_range, ts_lit, week_of
from ledgerloom.schemas import AVERAGE, TOTAL

SUBJECT_KEYS = {"customer": ["customer_id"], "org": ["org_id", "division_id"]}
PERIOD_KEYS = {"hour": ["txn_hour"], "day": ["txn_date"], "month": ["txn_year", "txn_month"]}
PARTY_KEYS = ["counterparty_id", "transfer_type", "status"]
LABELS = ["counterparty_name", "counterparty_type"]
MEASURES = ["txn_count", "total_amount", "total_fees", "total_net_amount", "min_amount", "max_amount", "avg_amount"]


def grain_keys(subject: str, period: str) -> list[str]:
    """Columns that identify one summary row."""
    return SUBJECT_KEYS[subject] + PERIOD_KEYS[period] + PARTY_KEYS


def _period_columns(period: str, ts: str) -> list[Column]:
    if period == "hour":
        return [hour_of(ts).alias("txn_hour")]
    if period == "day":
        return [day_of(ts).alias("txn_date")]
    return [F.year(ts).cast("smallint").alias("txn_year"), F.month(ts).cast("smallint").alias("txn_month")]


def rollup(facts: DataFrame, subject: str, period: str, start=None, end=None) -> DataFrame:
    """Summaries of the half-open time range, or of all facts.

    Map tasks aggregate before the one shuffle on the whole grain, so a payer
    that holds a large part of all rows sends one row per task and grain.
    """
    return _summarise(in_range(facts, start, end), subject, period)


def _marked(parties: DataFrame) -> Column:
    """Whether a row's counterparty may be among ``parties``: a scalar bitmap of 32,768 hash places, so of fixed size.

    None of the parties is missed; others that share a place pass as well.
    """
    place = F.xxhash64("counterparty_id").bitwiseAND(32767)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))
    words = parties.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    bits = found.select(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(511).cast("bigint")),
                                    lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("bigint")))).scalar()
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _labelled(rows: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """Groups with their measures and the greatest name and type of their counterparty, without sorting.

    A greatest text can only be kept by a sorted aggregation. But a counterparty nearly always has one name and
    one type: then grouping by them as well, which hashes, gives the same groups. Only the groups of counterparties that
    have several are merged by the greatest. A bitmap tells all others apart where they are read: a join
    on the counterparty would shuffle every row once more, and to few tasks where there are few counterparties.
    """
    # From the rows, not the groups: this reads three columns and shuffles a row per task and label.
    several = rows.select("counterparty_id", *LABELS).distinct().groupBy("counterparty_id").count().filter("count > 1").select(
        "counterparty_id")
    columns = [*keys, *LABELS, *MEASURES]
    marked = _marked(several)
    single = rows.filter(~marked).groupBy(*keys, *LABELS).agg(*measures).select(*columns)
    pairs = rows.filter(marked).groupBy(*keys, *LABELS).agg(*measures)
    sums = _sums_of_sums()
    # A group whose counterparty has one label is one row here and stays as it is.
    kept = F.when(F.max("_several"), sums[-1]).otherwise(F.max("avg_amount")).alias("avg_amount")
    merged = pairs.join(several.withColumn("_several", F.lit(True)), "counterparty_id", "left").groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in LABELS], *sums[:-1], kept)
    return single.unionByName(merged.select(*columns))


def _sums_of_sums() -> list[Column]:
    return [
        F.sum("txn_count").alias("txn_count"),
        *[F.sum(c).cast(TOTAL).alias(c) for c in ("total_amount", "total_fees", "total_net_amount")],
        F.min("min_amount").alias("min_amount"),
        F.max("max_amount").alias("max_amount"),
        (F.sum("total_amount").cast(TOTAL) / F.sum("txn_count")).cast(AVERAGE).alias("avg_amount"),
    ]


def _summarise(facts: DataFrame, subject: str, period: str) -> DataFrame:
    subject_columns = ["customer_id"] if subject == "customer" else ["org_id", empty_for_null("division_id")]
    base = facts.select(
        *subject_columns, *_period_columns(period, "txn_date"), *[empty_for_null(c) for c in PARTY_KEYS],
        *LABELS, "amount", "fees", "net_amount",
    )
    return _labelled(base, grain_keys(subject, period), [
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount").cast(TOTAL).alias("total_amount"),
        F.sum("fees").cast(TOTAL).alias("total_fees"),
        F.sum("net_amount").cast(TOTAL).alias("total_net_amount"),
        F.min("amount").cast(TOTAL).alias("min_amount"),
        F.max("amount").cast(TOTAL).alias("max_amount"),
        F.avg("amount").cast(AVERAGE).alias("avg_amount"),
    ])


def daily_rollup(facts: DataFrame, subject: str, run_date=None) -> DataFrame:
    """The day before ``run_date``, or every day when no date is given."""
    if run_date is None:
        return rollup(facts, subject, "day")
    today = as_datetime(run_date).date()
    return rollup(facts, subject, "day", today - dt.timedelta(days=1), today)


def monthly_rollup(facts: DataFrame, subject: str, run_date=None) -> DataFrame:
    """Month to date through yesterday.

    The month is yesterday's month, so the run on the 1st completes the month
    that has just ended.
    """
    if run_date is None:
        return rollup(facts, subject, "month")
    today = as_datetime(run_date).date()
    first = (today - dt.timedelta(days=1)).replace(day=1)
    return rollup(facts, subject, "month", first, today)


def month_from_days(daily: DataFrame, subject: str) -> DataFrame:
    """Monthly summaries re-aggregated from daily ones; far less input than the facts."""
    months = daily.withColumns({
        "txn_year": F.year("txn_date").cast("smallint"), "txn_month": F.month("txn_date").cast("smallint"),
    })
    return _labelled(months, grain_keys(subject, "month"), _sums_of_sums())


def incremental_hours(facts: DataFrame, subject: str, old_mark, new_mark, lookback_hours: int = 0) -> DataFrame:
    """Whole hours touched by facts in ``(old_mark, new_mark]``, recomputed from the facts.

    The hour of the old mark is included from its beginning, so a later run
    never replaces an hour by a part of it. ``lookback_hours`` widens the range
    for rows that arrive late.
    """
    first = first_touched_hour(old_mark, lookback_hours)
    return _summarise(in_range(facts, first, new_mark, closed_end=True), subject, "hour")


def first_touched_hour(old_mark, lookback_hours: int = 0) -> dt.datetime:
    mark = as_datetime(old_mark)
    return mark.replace(minute=0, second=0, microsecond=0) - dt.timedelta(hours=lookback_hours)


def incremental_partial(facts: DataFrame, subject: str, old_mark, new_mark=None) -> DataFrame:
    """Only the facts above the mark, as the plain incremental run sees them.

    Replacing summary rows with these loses the earlier part of a split hour;
    kept to compare with :func:`incremental_hours`.
    """
    fresh = in_range(facts, old_mark, new_mark, open_start=True, closed_end=True)
    return _summarise(fresh, subject, "hour")


def new_progress(facts: DataFrame, old_mark) -> DataFrame:
    """New mark and number of new rows in one pass; the mark stays when nothing is new."""
    return in_range(facts, old_mark, None, open_start=True).agg(
        F.coalesce(F.max("txn_date"), ts_lit(old_mark)).alias("new_mark"),
        F.count(F.lit(1)).alias("new_rows"),
    )


def weekly_digest(daily: DataFrame, subject: str, week_end=None) -> DataFrame:
    """Totals of the seven days before ``week_end``; without a date, of every Monday-to-Sunday week."""
    subject_id, label = ("customer_id", "unique_customers") if subject == "customer" else ("org_id", "unique_orgs")
    if week_end is not None:
        end = as_datetime(week_end).date()
        rows = daily.filter(F.col("txn_date").between(F.lit(end - dt.timedelta(days=7)),
                                                      F.lit(end - dt.timedelta(days=1))))
        grouped = rows.withColumn("week_end", F.lit(end)).groupBy("week_end")
    else:
        grouped = daily.withColumn("week_end", F.date_add(week_of("txn_date"), 7)).groupBy("week_end")
    return grouped.agg(
        F.count_distinct(subject_id).alias(label),
        F.sum("txn_count").alias("total_txns"),
        F.sum("total_amount").cast(TOTAL).alias("gross_amount"),
        F.sum("total_fees").cast(TOTAL).alias("total_fees"),
        F.sum("total_net_amount").cast(TOTAL).alias("net_amount"),
    )
