"""Data-quality checks. A check is one row: check_name, status, detail (JSON), error."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.periods import as_datetime, day_of, in_range, ts_lit
from ledgerloom.schemas import TOTAL

CHECK_SCHEMA = "check_name string, status string, detail string, error string"
TOLERANCE = "0.01"
EXAMPLES = 20


def _check(df: DataFrame, name: str, failed: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check_name"),
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        F.to_json(detail).alias("detail"),
        F.lit(None).cast("string").alias("error"),
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def null_ids(facts: DataFrame, column: str) -> DataFrame:
    counted = facts.agg(_count(F.col(column).isNull()).alias(f"null_{column}_count"))
    return _check(counted, f"null_{column}s", F.col(f"null_{column}_count") > 0, F.struct(*counted.columns))


def negative_amounts(customer_facts: DataFrame, org_facts: DataFrame) -> DataFrame:
    both = customer_facts.select(F.lit("c").alias("t"), "amount").unionAll(
        org_facts.select(F.lit("o").alias("t"), "amount"))
    negative = F.col("amount") < 0
    counted = both.agg(
        _count(negative & (F.col("t") == "c")).alias("customer_negative_amount_count"),
        _count(negative & (F.col("t") == "o")).alias("org_negative_amount_count"),
    )
    bad = F.col("customer_negative_amount_count") + F.col("org_negative_amount_count") > 0
    return _check(counted, "negative_amounts", bad, F.struct(*counted.columns))


def duplicate_transfers(facts: DataFrame) -> DataFrame:
    """Transfer ids that occur more than once, with their count. Null ids are left out before the shuffle."""
    return facts.filter(F.col("transfer_id").isNotNull()).groupBy("transfer_id").agg(
        F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def duplicate_examples(facts: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    return duplicate_transfers(facts).orderBy(F.desc("cnt"), "transfer_id").limit(limit)


def duplicate_check(customer_facts: DataFrame, org_facts: DataFrame) -> DataFrame:
    """Number of duplicated ids per table; a failing check also lists the most repeated customer ones."""
    duplicates = duplicate_transfers(customer_facts).select(F.lit("c").alias("t"), "transfer_id").unionAll(
        duplicate_transfers(org_facts).select(F.lit("o").alias("t"), "transfer_id"))
    # At most EXAMPLES rows reach the list.
    example = F.struct((-F.col("cnt")).alias("rank"), F.col("transfer_id"), F.col("cnt").alias("count"))
    examples = duplicate_examples(customer_facts).agg(F.array_sort(F.collect_list(example)).alias("e"))
    counted = duplicates.agg(
        _count(F.col("t") == "c").alias("customer_duplicate_transfer_ids"),
        _count(F.col("t") == "o").alias("org_duplicate_transfer_ids"),
    ).withColumn("e", examples.scalar())
    counted = counted.withColumn(
        "customer_examples",
        F.when(F.col("customer_duplicate_transfer_ids") + F.col("org_duplicate_transfer_ids") > 0,
               F.transform("e", lambda x: F.struct(x["transfer_id"].alias("transfer_id"), x["count"].alias("count")))))
    bad = F.col("customer_duplicate_transfer_ids") + F.col("org_duplicate_transfer_ids") > 0
    return _check(counted, "duplicate_transfers", bad, F.struct(
        "customer_duplicate_transfer_ids", "org_duplicate_transfer_ids", "customer_examples"))


def summary_vs_raw_by_day(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """Raw and summary totals of every day side by side; each side is aggregated before the join."""
    raw = facts.groupBy(day_of("txn_date").alias("day")).agg(F.sum("amount").cast(TOTAL).alias("raw_total"))
    summed = daily.groupBy(F.col("txn_date").alias("day")).agg(
        F.sum("total_amount").cast(TOTAL).alias("summary_total"))
    zero = F.lit(0).cast(TOTAL)
    both = raw.join(summed, "day", "full_outer").select(
        "day", F.coalesce("raw_total", zero).alias("raw_total"),
        F.coalesce("summary_total", zero).alias("summary_total"))
    diff = F.abs(F.col("raw_total") - F.col("summary_total")).cast(TOTAL)
    return both.withColumn("diff", diff).withColumn(
        "status", F.when(F.col("diff") > F.lit(TOLERANCE).cast("decimal(3,2)"), "FAIL").otherwise("PASS"))


def summary_vs_raw(customer_facts: DataFrame, customer_daily: DataFrame, org_facts: DataFrame,
                   org_daily: DataFrame, run_date) -> DataFrame:
    """Totals of the day before ``run_date``, raw against summary, in exact decimals."""
    today = as_datetime(run_date).date()
    day = today - dt.timedelta(days=1)
    zero = F.lit(0).cast(TOTAL)

    def raw(facts: DataFrame, kind: str) -> DataFrame:
        return in_range(facts, day, today).select(F.lit(kind).alias("k"), F.col("amount").cast(TOTAL).alias("v"))

    def summed(daily: DataFrame, kind: str) -> DataFrame:
        return daily.filter(F.col("txn_date") == F.lit(day)).select(
            F.lit(kind).alias("k"), F.col("total_amount").alias("v"))

    parts = [raw(customer_facts, "raw_customer_total"), summed(customer_daily, "summary_customer_total"),
             raw(org_facts, "raw_org_total"), summed(org_daily, "summary_org_total")]
    names = ["raw_customer_total", "summary_customer_total", "raw_org_total", "summary_org_total"]
    totals = reduce(DataFrame.unionAll, parts).agg(*[
        F.coalesce(F.sum(F.when(F.col("k") == n, F.col("v"))).cast(TOTAL), zero).alias(n) for n in names])
    totals = totals.withColumns({
        "date": F.lit(day.isoformat()),
        "customer_diff": F.abs(F.col("raw_customer_total") - F.col("summary_customer_total")).cast(TOTAL),
        "org_diff": F.abs(F.col("raw_org_total") - F.col("summary_org_total")).cast(TOTAL),
        "tolerance": F.lit(TOLERANCE).cast("decimal(3,2)"),
    })
    bad = (F.col("customer_diff") > F.col("tolerance")) | (F.col("org_diff") > F.col("tolerance"))
    return _check(totals, "summary_vs_raw_totals", bad, F.struct(
        "date", "raw_customer_total", "summary_customer_total", "customer_diff",
        "raw_org_total", "summary_org_total", "org_diff", "tolerance"))


def _numbers(facts: DataFrame, id_column: str, day: dt.date, today: dt.date) -> DataFrame:
    """What the checks ask of a fact table, in one scan and one row."""
    inside = (F.col("txn_date") >= ts_lit(day)) & (F.col("txn_date") < ts_lit(today))
    return facts.agg(F.struct(
        _count(F.col(id_column).isNull()).alias("nulls"), _count(F.col("amount") < 0).alias("negative"),
        F.coalesce(F.sum(F.when(inside, F.col("amount"))).cast(TOTAL), F.lit(0).cast(TOTAL)).alias("raw")).alias("n"))


def fact_checks(customer_facts: DataFrame, customer_daily: DataFrame, org_facts: DataFrame, org_daily: DataFrame, run_date) -> DataFrame:
    """Null ids, negative amounts and the day's totals against the summaries: each table is read once for all four checks."""
    today = as_datetime(run_date).date()
    day = today - dt.timedelta(days=1)

    def summed(daily: DataFrame) -> Column:
        return daily.filter(F.col("txn_date") == F.lit(day)).agg(
            F.coalesce(F.sum("total_amount").cast(TOTAL), F.lit(0).cast(TOTAL))).scalar()

    numbers = _numbers(customer_facts, "customer_id", day, today).select(
        F.col("n").alias("c"), _numbers(org_facts, "org_id", day, today).scalar().alias("o"),
        summed(customer_daily).alias("c_summary"), summed(org_daily).alias("o_summary"))

    def entry(name: str, failed: Column, *detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), F.when(failed, "FAIL").otherwise("PASS").alias("status"),
                        F.to_json(F.struct(*detail)).alias("detail"), F.lit(None).cast("string").alias("error"))

    c, o, tolerance = F.col("c"), F.col("o"), F.lit(TOLERANCE).cast("decimal(3,2)")
    c_diff = F.abs(c["raw"] - F.col("c_summary")).cast(TOTAL)
    o_diff = F.abs(o["raw"] - F.col("o_summary")).cast(TOTAL)
    return numbers.select(F.inline(F.array(
        entry("null_customer_ids", c["nulls"] > 0, c["nulls"].alias("null_customer_id_count")),
        entry("null_org_ids", o["nulls"] > 0, o["nulls"].alias("null_org_id_count")),
        entry("negative_amounts", c["negative"] + o["negative"] > 0, c["negative"].alias("customer_negative_amount_count"),
              o["negative"].alias("org_negative_amount_count")),
        entry("summary_vs_raw_totals", (c_diff > tolerance) | (o_diff > tolerance), F.lit(day.isoformat()).alias("date"),
              c["raw"].alias("raw_customer_total"), F.col("c_summary").alias("summary_customer_total"), c_diff.alias("customer_diff"),
              o["raw"].alias("raw_org_total"), F.col("o_summary").alias("summary_org_total"), o_diff.alias("org_diff"),
              tolerance.alias("tolerance")))))


def mark_ages(marks: DataFrame, as_of, limit_hours: float | dict[str, float] = 1.0) -> DataFrame:
    """Hours since each mark, never-run pipelines first; a limit may be given per pipeline."""
    micros = F.timestamp_diff("MICROSECOND", F.col("last_processed_at"), ts_lit(as_of))
    if isinstance(limit_hours, dict):
        limit = reduce(lambda acc, kv: acc.when(F.col("pipeline_name") == kv[0], F.lit(kv[1])),
                       limit_hours.items(), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))
    else:
        limit = F.lit(float(limit_hours))
    aged = marks.select("pipeline_name", "last_processed_at", "last_run_at",
                        F.round(micros / F.lit(3600e6), 3).alias("hours_since_update"), limit.alias("limit_hours"))
    stale = F.col("hours_since_update").isNull() | (F.col("hours_since_update") > F.col("limit_hours"))
    return aged.withColumn("stale", stale).orderBy(F.desc_nulls_first("hours_since_update"), "pipeline_name")


def stale_marks(marks: DataFrame, as_of, limit_hours: float | dict[str, float] = 1.0) -> DataFrame:
    """One row; the lists hold at most one entry per pipeline."""
    aged = mark_ages(marks, as_of, limit_hours)
    entry = F.struct("pipeline_name", F.col("last_processed_at").cast("string").alias("last_processed_at"),
                     "hours_since_update")
    listed = aged.agg(
        F.array_sort(F.collect_list(F.when(F.col("stale"), entry))).alias("stale_pipelines"),
        F.array_sort(F.collect_list(F.when(~F.col("stale"), entry))).alias("fresh_pipelines"))
    return _check(listed, "stale_watermarks", F.size("stale_pipelines") > 0,
                  F.struct("stale_pipelines", "fresh_pipelines"))


def freshness(marks: DataFrame, as_of, limit_hours: float = 2.0) -> DataFrame:
    """Warning-level view of the same ages."""
    return mark_ages(marks, as_of, limit_hours).select(
        "pipeline_name", "hours_since_update",
        F.when(F.col("stale"), "WARN").otherwise("OK").alias("level"))


def union_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def report(checks: DataFrame) -> DataFrame:
    failed = F.col("status").isin("FAIL", "ERROR")
    return checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        _count(F.col("status") == "PASS").alias("passed"),
        _count(failed).alias("failed"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(failed, F.col("check_name"))))).alias("failed_checks"),
    )


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Run every check on its own, so that one that breaks becomes an ERROR row and the others still run."""
    rows = []
    for name, build in checks.items():
        try:
            rows.extend(tuple(r) for r in build().collect())
        except Exception as problem:  # noqa: BLE001 - any failure is a result here
            rows.append((name, "ERROR", "{}", str(problem)))
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def require_passed(checks: DataFrame) -> None:
    """Raise when any check failed; for the end of a job."""
    failed = [r.check_name for r in checks.filter(F.col("status").isin("FAIL", "ERROR")).collect()]
    if failed:
        raise ValueError(f"data quality checks failed: {failed}")
