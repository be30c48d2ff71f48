"""Purge of data past its retention, and its dry run."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.domains import MAX_HISTORY_YEARS
from ledgerloom.functions.periods import as_datetime, months_before, ts_lit
from ledgerloom.operators.upsert import partition_values, replace_periods
from ledgerloom.session import staging_dir


def cutoff(as_of, retention_years: int = MAX_HISTORY_YEARS) -> dt.datetime:
    """Rows initiated before this moment are expired; retention is capped at seven years."""
    return months_before(as_datetime(as_of), 12 * min(retention_years, MAX_HISTORY_YEARS))


def is_expired(limit: dt.datetime) -> Column:
    return F.col("initiated_at") < ts_lit(limit)


def expired_ids(transfers: DataFrame, limit: dt.datetime) -> DataFrame:
    return transfers.filter(is_expired(limit)).select("transfer_id")


def kept_records(records: DataFrame, limit: dt.datetime) -> DataFrame:
    """Transfers or gateway payments that stay; a filter, no join."""
    return records.filter(~is_expired(limit))


def kept_children(children: DataFrame, transfers: DataFrame, limit: dt.datetime) -> DataFrame:
    """Ledger or audit rows whose transfer stays; rows that belong to no transfer stay too."""
    return without_transfers(children, expired_ids(transfers, limit))


def without_transfers(children: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of no listed transfer. Those without a transfer get keys of their own, or they would all meet in one task."""
    own = F.concat(F.lit("\u0000"), F.xxhash64(*children.columns).cast("string"))
    keyed = children.withColumn("_key", F.coalesce(F.col("transfer_id"), own))
    gone = ids.select(F.col("transfer_id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").drop("_key")


def purge_counts(transfers: DataFrame, ledger: DataFrame, audit: DataFrame, payments: DataFrame,
                 limit: dt.datetime) -> DataFrame:
    """Rows a purge removes from each table."""
    ids = expired_ids(transfers, limit)

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("expired_rows")).select(F.lit(name).alias("table_name"), "expired_rows")

    parts = [
        counted("wallet_audit_logs", audit.join(ids, "transfer_id", "left_semi")),
        counted("wallet_transactions", ledger.join(ids, "transfer_id", "left_semi")),
        counted("wallet_transfers", ids),
        counted("payment_transactions", payments.filter(is_expired(limit))),
    ]
    return reduce(DataFrame.unionAll, parts)


def dry_run(transfers: DataFrame, payments: DataFrame, limit: dt.datetime) -> DataFrame:
    """Eligible transfers and payments only."""
    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.filter(is_expired(limit)).agg(F.count(F.lit(1)).alias("eligible_rows")).select(
            F.lit(name).alias("table_name"), "eligible_rows")

    return counted("wallet_transfers", transfers).unionAll(counted("payment_transactions", payments))


def oldest_expired(transfers: DataFrame, limit: dt.datetime, count: int = 500) -> DataFrame:
    """Preview of the oldest expired transfers."""
    return transfers.filter(is_expired(limit)).orderBy("initiated_at", "transfer_id").limit(count).select(
        "transfer_id", "initiated_at")


def purge_partitions(spark: SparkSession, path: str, column: str, kept: DataFrame, touched: list) -> None:
    """Rewrite the touched partitions of a table with the rows that stay; emptied ones are cleared."""
    condition = F.col(column).isin(touched)
    replace_periods(kept.filter(condition), path, column, requested=condition)


def purge(spark: SparkSession, paths: dict[str, str], column: str, limit: dt.datetime) -> None:
    """Remove expired rows: children first, so a failed run can be repeated with the transfers still there.

    Only partitions that hold an expired row are rewritten. A child table meets the transfers once, by its key alone; the rows that
    stay are found with the ids that this wrote down.
    """
    transfers = spark.read.parquet(paths["wallet_transfers"])
    for name in ("wallet_audit_logs", "wallet_transactions"):
        if name not in paths:
            continue
        children = spark.read.parquet(paths[name])
        found = children.select("transfer_id", column).join(expired_ids(transfers, limit), "transfer_id", "left_semi").distinct()
        found_path = staging_dir(spark, "expired", paths[name])
        found.write.mode("overwrite").parquet(found_path)
        gone = spark.read.schema(found.schema).parquet(found_path)
        touched = partition_values(gone, column)
        if touched:
            inside = children.filter(F.col(column).isin(touched))
            purge_partitions(spark, paths[name], column, without_transfers(inside, gone), touched)
    for name in ("wallet_transfers", "payment_transactions"):
        if name not in paths:
            continue
        records = spark.read.parquet(paths[name])
        touched = partition_values(records.filter(is_expired(limit)), column)
        if touched:
            purge_partitions(spark, paths[name], column, kept_records(records, limit), touched)
