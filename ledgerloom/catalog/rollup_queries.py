"""Rollups, upserts and marks over the sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog.oracle_tables import summary, with_tables
from ledgerloom.operators import rollups
from ledgerloom.operators.upsert import merge_rows, replace_rows_in_range, upsert
from ledgerloom.functions.periods import ts_lit
from ledgerloom.session import fresh_dir
from ledgerloom.sources import marks as mk
from ledgerloom.sources import sample_tables as st

# One hour of the sample stream is split by this mark.
SPLIT_MARK = "2024-01-05 10:20:00"
SPLIT_HOUR = "2024-01-05 10:00:00"
RUN_AT = "2024-01-31 00:15:00"


def _split_run(spark: SparkSession, sf_dir: str, subject: str) -> DataFrame:
    """Hourly summaries built by two runs around the mark."""
    facts = st.activity_facts(spark, sf_dir)
    first = rollups.incremental_hours(facts, subject, "2020-01-01", SPLIT_MARK)
    end = rollups.new_progress(facts, SPLIT_MARK).first().new_mark
    second = rollups.incremental_hours(facts, subject, SPLIT_MARK, end)
    return replace_rows_in_range(first, second, "txn_hour", ts_lit(SPLIT_HOUR), ts_lit(end))


def _split_run_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two runs when the second replaces rows by its own part of the hour."""
    facts = st.activity_facts(spark, sf_dir)
    first = rollups.incremental_partial(facts, "customer", "2020-01-01", SPLIT_MARK)
    second = rollups.incremental_partial(facts, "customer", SPLIT_MARK)
    return merge_rows(first, second, rollups.grain_keys("customer", "hour"))


def _upsert_corrected_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily summary of everything but COMPLETED rows, upserted with the full one of 1998 on."""
    facts = st.customer_facts(spark, sf_dir)
    old = rollups.rollup(facts.filter(F.col("status") != "COMPLETED"), "customer", "day")
    new = rollups.rollup(facts, "customer", "day", "1998-01-01")
    return merge_rows(old, new, rollups.grain_keys("customer", "day"))


def _upsert_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a table stored by month, run twice and read back."""
    facts = st.customer_facts(spark, sf_dir)
    path = f"{fresh_dir(spark, 'upsert')}/summary"
    month = (F.year("txn_date") * 100 + F.month("txn_date")).alias("month")
    old = rollups.rollup(facts.filter(F.col("status") != "COMPLETED"), "customer", "day").select("*", month)
    new = rollups.rollup(facts, "customer", "day", "1998-01-01").select("*", month)
    for rows in (old, new, new):
        upsert(rows, path, rollups.grain_keys("customer", "day"), "month")
    return spark.read.parquet(path).drop("month")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = st.activity_facts(spark, sf_dir)
    starts = {"customer_hourly_rollup": "2024-01-10 00:00:00", "org_hourly_rollup": "2024-01-20 12:00:00",
              "customer_daily_rollup": "2024-01-30 00:00:00", "org_daily_rollup": "2024-02-10 00:00:00"}
    parts = [rollups.new_progress(facts, mark).withColumn("pipeline_name", F.lit(name))
             for name, mark in starts.items()]
    return reduce(DataFrame.unionByName, parts).select("pipeline_name", "new_mark", "new_rows")


def _progress_sql() -> str:
    starts = [("customer_hourly_rollup", "2024-01-10 00:00:00"), ("org_hourly_rollup", "2024-01-20 12:00:00"),
              ("customer_daily_rollup", "2024-01-30 00:00:00"), ("org_daily_rollup", "2024-02-10 00:00:00")]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS pipeline_name, coalesce(max(ts), TIMESTAMP '{m}') AS new_mark, count(*) AS new_rows "
        f"FROM events WHERE ts > TIMESTAMP '{m}'" for n, m in starts)


def _marks_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mk.initial_marks(spark, ("customer_hourly_rollup", "org_daily_rollup"))
    return mk.advance_marks(mk.seed_marks(stored), _progress(spark, sf_dir), RUN_AT)


QUERIES = {
    "customer_facts": st.customer_facts,
    "org_facts": st.org_facts,
    "customer_hourly_rollup": lambda s, d: rollups.rollup(st.activity_facts(s, d), "customer", "hour"),
    "org_hourly_rollup": lambda s, d: rollups.rollup(st.activity_facts(s, d), "org", "hour"),
    "customer_daily_rollup": lambda s, d: rollups.daily_rollup(st.customer_facts(s, d), "customer"),
    "org_daily_rollup": lambda s, d: rollups.daily_rollup(st.org_facts(s, d), "org"),
    "customer_monthly_rollup": lambda s, d: rollups.monthly_rollup(st.customer_facts(s, d), "customer"),
    "org_monthly_rollup": lambda s, d: rollups.monthly_rollup(st.org_facts(s, d), "org"),
    "org_month_from_days": lambda s, d: rollups.month_from_days(
        rollups.daily_rollup(st.org_facts(s, d), "org"), "org"),
    "customer_weekly_digest": lambda s, d: rollups.weekly_digest(
        rollups.daily_rollup(st.customer_facts(s, d), "customer"), "customer"),
    "org_weekly_digest": lambda s, d: rollups.weekly_digest(
        rollups.daily_rollup(st.org_facts(s, d), "org"), "org"),
    "rollup_progress": _progress,
    "customer_hourly_two_runs": lambda s, d: _split_run(s, d, "customer"),
    "org_hourly_two_runs": lambda s, d: _split_run(s, d, "org"),
    "customer_hourly_replace_partial": _split_run_partial,
    "upsert_daily_summary": _upsert_corrected_days,
    "upsert_on_disk": _upsert_on_disk,
    "marks_after_run": _marks_after_run,
    "stored_marks": lambda s, d: mk.marks_for(
        mk.advance_marks(mk.initial_marks(s, ("customer_hourly_rollup",)), _progress(s, d), RUN_AT)),
}

_WEEKLY = """SELECT CAST(date_trunc('week', txn_date) AS DATE) + 7 AS week_end, count(DISTINCT {id}) AS {label},
 CAST(sum(txn_count) AS BIGINT) AS total_txns, CAST(sum(total_amount) AS DECIMAL(24,2)) AS gross_amount,
 CAST(sum(total_fees) AS DECIMAL(24,2)) AS total_fees, CAST(sum(total_net_amount) AS DECIMAL(24,2)) AS net_amount
FROM {table} GROUP BY 1"""

_SEEDS = """SELECT unnest(['customer_hourly_rollup','customer_daily_rollup','customer_monthly_rollup',
 'org_hourly_rollup','org_daily_rollup','org_monthly_rollup']) AS pipeline_name"""

ORACLE = {
    "customer_facts": with_tables("SELECT * FROM customer_facts"),
    "org_facts": with_tables("SELECT * FROM org_facts"),
    "customer_hourly_rollup": with_tables("SELECT * FROM customer_hourly"),
    "org_hourly_rollup": with_tables("SELECT * FROM org_hourly"),
    "customer_daily_rollup": with_tables("SELECT * FROM customer_daily"),
    "org_daily_rollup": with_tables("SELECT * FROM org_daily"),
    "customer_monthly_rollup": with_tables("SELECT * FROM customer_monthly"),
    "org_monthly_rollup": with_tables("SELECT * FROM org_monthly"),
    "org_month_from_days": with_tables("SELECT * FROM org_monthly"),
    "customer_weekly_digest": with_tables(
        _WEEKLY.format(id="customer_id", label="unique_customers", table="customer_daily")),
    "org_weekly_digest": with_tables(_WEEKLY.format(id="org_id", label="unique_orgs", table="org_daily")),
    "rollup_progress": _progress_sql(),
    "customer_hourly_two_runs": with_tables("SELECT * FROM customer_hourly"),
    "org_hourly_two_runs": with_tables("SELECT * FROM org_hourly"),
    "customer_hourly_replace_partial": with_tables(f"""
WITH first_run AS ({summary('customer', 'hour', f"(SELECT * FROM activity_facts WHERE txn_date <= TIMESTAMP '{SPLIT_MARK}')")}),
 second_run AS ({summary('customer', 'hour', f"(SELECT * FROM activity_facts WHERE txn_date > TIMESTAMP '{SPLIT_MARK}')")})
SELECT * FROM first_run a WHERE NOT EXISTS (SELECT 1 FROM second_run b WHERE a.customer_id=b.customer_id
 AND a.txn_hour=b.txn_hour AND a.counterparty_id=b.counterparty_id AND a.transfer_type=b.transfer_type
 AND a.status=b.status)
UNION ALL SELECT * FROM second_run"""),
    "upsert_daily_summary": with_tables("""
SELECT * FROM customer_daily WHERE txn_date >= DATE '1998-01-01' OR status <> 'COMPLETED'"""),
    "marks_after_run": f"""WITH progress AS ({_progress_sql()}), seeds AS ({_SEEDS})
SELECT s.pipeline_name, coalesce(p.new_mark, TIMESTAMP '2020-01-01') AS last_processed_at,
 CASE WHEN p.pipeline_name IS NOT NULL THEN TIMESTAMP '{RUN_AT}' END AS last_run_at,
 CAST(coalesce(p.new_rows, 0) AS BIGINT) AS records_processed
FROM seeds s LEFT JOIN progress p ON s.pipeline_name = p.pipeline_name""",
    "stored_marks": f"""WITH progress AS ({_progress_sql()}), seeds AS ({_SEEDS})
SELECT s.pipeline_name, coalesce(p.new_mark, TIMESTAMP '2020-01-01') AS last_processed_at
FROM seeds s LEFT JOIN progress p ON s.pipeline_name = p.pipeline_name AND p.pipeline_name = 'customer_hourly_rollup'""",
}

ORACLE["upsert_on_disk"] = ORACLE["upsert_daily_summary"]
