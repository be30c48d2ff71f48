"""Jobs that read facts, publish summaries and move the marks. Each may be run again with the same arguments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.domains import FIRST_MARK
from ledgerloom.functions.periods import as_datetime, day_of, ts_lit
from ledgerloom.operators import quality, rollups
from ledgerloom.operators.upsert import fold, read_if_present, replace_periods, replace_range
from ledgerloom.plans import semantic
from ledgerloom.sources import marks as mk

LOOKBACK_HOURS = 24  # late rows up to this age are counted by the next run


def _stored_marks(spark: SparkSession, path: str) -> DataFrame:
    if read_if_present(spark, path) is None:
        return mk.initial_marks(spark)
    return mk.seed_marks(mk.read_marks(spark, path))


def _mark(spark: SparkSession, path: str, pipeline: str):
    """One value."""
    row = _stored_marks(spark, path).filter(F.col("pipeline_name") == pipeline).first()
    return row.last_processed_at if row else as_datetime(FIRST_MARK)


def _advance(spark: SparkSession, path: str, pipeline: str, mark, rows: int, run_at) -> None:
    progress = spark.createDataFrame([(pipeline, int(rows))], "pipeline_name string, new_rows bigint").withColumn(
        "new_mark", ts_lit(mark))
    stored = _stored_marks(spark, path).filter(F.col("pipeline_name") == pipeline)
    mk.append_marks(mk.advance_marks(stored, progress, run_at), path)


def run_hourly(facts: DataFrame, subject: str, summary_path: str, marks_path: str, run_at,
               lookback_hours: int = LOOKBACK_HOURS) -> int:
    """Fold facts above the mark into the hourly summary; returns how many there were.

    The hours before the mark are recomputed as well, so rows that arrive late by up to
    ``lookback_hours`` are counted. The new mark is fixed first, and everything after reads only up to it, so
    rows that arrive meanwhile are left for the next run.
    """
    spark = facts.sparkSession
    pipeline = f"{subject}_hourly_rollup"
    old = _mark(spark, marks_path, pipeline)
    progress = rollups.new_progress(facts, old).first()
    if progress.new_rows or lookback_hours:
        first = rollups.first_touched_hour(old, lookback_hours)
        fresh = rollups.incremental_hours(facts, subject, old, progress.new_mark, lookback_hours)
        fresh = fresh.withColumns({"txn_day": day_of("txn_hour"), "refreshed_at": ts_lit(run_at)})
        replace_range(fresh, summary_path, "txn_day", "txn_hour", ts_lit(first), ts_lit(progress.new_mark))
    _advance(spark, marks_path, pipeline, progress.new_mark, progress.new_rows, run_at)
    return progress.new_rows


def run_daily(facts: DataFrame, subject: str, summary_path: str, marks_path: str, run_date) -> None:
    """Recompute and replace the day before ``run_date``."""
    today = as_datetime(run_date).date()
    day = today - dt.timedelta(days=1)
    fresh = rollups.daily_rollup(facts, subject, today).withColumn("refreshed_at", ts_lit(run_date))
    replace_periods(fresh, summary_path, "txn_date", requested=F.col("txn_date") == F.lit(day))
    rows = facts.sparkSession.read.parquet(summary_path).filter(F.col("txn_date") == F.lit(day)).count()
    _advance(facts.sparkSession, marks_path, f"{subject}_daily_rollup", today, rows, run_date)


def run_monthly(source: DataFrame, subject: str, summary_path: str, marks_path: str, run_date,
                from_daily: bool = False) -> None:
    """Recompute and replace the month of the day before ``run_date``, from facts or from the daily summary."""
    today = as_datetime(run_date).date()
    first = (today - dt.timedelta(days=1)).replace(day=1)
    if from_daily:
        days = source.filter((F.col("txn_date") >= F.lit(first)) & (F.col("txn_date") < F.lit(today)))
        fresh = rollups.month_from_days(days, subject)
    else:
        fresh = rollups.monthly_rollup(source, subject, today)
    number = first.year * 100 + first.month
    month = (F.col("txn_year").cast("int") * 100 + F.col("txn_month")).cast("int")
    replace_periods(fresh.withColumns({"txn_year_month": month, "refreshed_at": ts_lit(run_date)}), summary_path,
                    "txn_year_month", requested=F.col("txn_year_month") == number)
    rows = source.sparkSession.read.parquet(summary_path).filter(F.col("txn_year_month") == number).count()
    _advance(source.sparkSession, marks_path, f"{subject}_monthly_rollup", today, rows, run_date)


def weekly_report(customer_daily: DataFrame, org_daily: DataFrame, run_date) -> DataFrame:
    """Digest of the seven days before ``run_date`` for customers and organisations, one row."""
    customers = rollups.weekly_digest(customer_daily, "customer", run_date)
    orgs = rollups.weekly_digest(org_daily, "org", run_date).withColumnsRenamed(
        {c: f"org_{c}" for c in ("total_txns", "gross_amount", "total_fees", "net_amount")})
    return customers.join(orgs, "week_end", "full_outer")


def refresh_rollup(daily: DataFrame, name: str, path: str, first_day, last_day) -> None:
    """Rebuild the partitions of a stored rollup that the changed days belong to.

    A week belongs to the month of its Monday, so the source range reaches to
    the end of the last week that starts in the last partition.
    """
    spec = semantic.ROLLUPS[name]
    low, high = as_datetime(first_day).date(), as_datetime(last_day).date()
    if spec.grain == "week":
        low, high = low - dt.timedelta(days=low.weekday()), high - dt.timedelta(days=high.weekday())
    if spec.partition == "year":
        start, stop = dt.date(low.year, 1, 1), dt.date(high.year + 1, 1, 1)
        bounds = (low.year, high.year)
    else:
        start = low.replace(day=1)
        stop = (high.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        bounds = (low.year * 100 + low.month, high.year * 100 + high.month)
    reach = stop + dt.timedelta(days=6 if spec.grain == "week" else 0)
    days = daily.filter((F.col("txn_date") >= F.lit(start)) & (F.col("txn_date") < F.lit(reach)))
    built = semantic.build_rollup(days, name).withColumn("period_partition", semantic.partition_of(spec))
    wanted = F.col("period_partition").between(*bounds)
    replace_periods(built.filter(wanted), path, "period_partition", requested=wanted)


def rebuild_rollup(daily: DataFrame, name: str, path: str) -> None:
    """Build every partition, from the first to the last day of the summary."""
    days = daily.agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("last")).first()
    if days["first"] is not None:
        refresh_rollup(daily, name, path, days["first"], days["last"])


_ADDED = {"txn_count": "bigint", "total_amount": "decimal(24,2)", "total_net_amount": "decimal(24,2)", "total_fees": "decimal(24,2)"}


def change_rollup(before: DataFrame, after: DataFrame, name: str, path: str, change: int) -> None:
    """Bring a stored rollup up to date from the daily rows that were replaced and those that replaced them.

    Stored measures are sums, so the old rows count negatively and the new ones positively; what is left of each group is
    added to its stored row. Only partitions with such groups are read and written, whatever the rollup holds besides, and a
    period that has lost its rows costs nothing of its own. A group without transactions left stays as a row of
    zeros, which :func:`read_rollup` leaves out: each row remembers the last ``change`` (a number that
    rises from one to the next) that it took in, so that a change that is run again counts once.
    """
    spec = semantic.ROLLUPS[name]
    signed = after.unionByName(before.withColumns({c: (-F.col(c)).cast(kind) for c, kind in _ADDED.items()}))
    delta = semantic.build_rollup(signed, name)
    keys = [*spec.dimensions, "txn_period", "period_partition"]
    moved = delta.filter(" OR ".join(f"{m} <> 0" for m in spec.measures)).withColumns({
        "period_partition": semantic.partition_of(spec), "change": F.lit(change).cast("bigint")})

    def combined(old: DataFrame, new: DataFrame) -> DataFrame:
        kinds = dict(new.dtypes)
        taken = F.max(F.when(~F.col("_new"), F.col("change"))).alias("_taken")
        rows = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        stored = {m: F.coalesce(F.sum(F.when(~F.col("_new"), F.col(m))), F.lit(0)) for m in spec.measures}
        added = {m: F.coalesce(F.sum(F.when(F.col("_new"), F.col(m))), F.lit(0)) for m in spec.measures}
        grouped = rows.groupBy(*keys).agg(
            F.max("change").alias("change"), taken, *[v.alias(f"_stored_{m}") for m, v in stored.items()],
            *[v.alias(f"_added_{m}") for m, v in added.items()])
        again = F.coalesce(F.col("_taken") >= change, F.lit(False))
        return grouped.select(*keys, "change", *[
            (F.col(f"_stored_{m}") + F.when(again, F.lit(0)).otherwise(F.col(f"_added_{m}"))).cast(kinds[m]).alias(m)
            for m in spec.measures])

    fold(moved, path, "period_partition", combined)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """A stored rollup as :func:`ledgerloom.plans.semantic.build_rollup` would build it now."""
    stored = spark.read.option("mergeSchema", True).parquet(path)
    return stored.filter("total_transactions <> 0").drop("period_partition", "change")


def refresh_due(name: str, last_refresh, now) -> bool:
    """Whether a stored rollup is older than its refresh interval."""
    return as_datetime(now) - as_datetime(last_refresh) >= dt.timedelta(
        minutes=semantic.ROLLUPS[name].refresh_minutes)


def run_quality(spark: SparkSession, customer_facts: DataFrame, org_facts: DataFrame, customer_daily: DataFrame,
                org_daily: DataFrame, marks_path: str, run_date, limits: float | dict[str, float] = 1.0) -> DataFrame:
    """All checks, each on its own."""
    return quality.run_checks(spark, {
        "null_customer_ids": lambda: quality.null_ids(customer_facts, "customer_id"),
        "null_org_ids": lambda: quality.null_ids(org_facts, "org_id"),
        "negative_amounts": lambda: quality.negative_amounts(customer_facts, org_facts),
        "duplicate_transfers": lambda: quality.duplicate_check(customer_facts, org_facts),
        "summary_vs_raw_totals": lambda: quality.summary_vs_raw(
            customer_facts, customer_daily, org_facts, org_daily, run_date),
        "stale_watermarks": lambda: quality.stale_marks(_stored_marks(spark, marks_path), run_date, limits),
    })
