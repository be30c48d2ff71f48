"""Matching archived webhooks to transfers and payments, and the states they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.domains import TERMINAL_GATEWAY_STATUSES, TERMINAL_TRANSFER_STATUSES
from ledgerloom.functions.keys import spread_nulls
from ledgerloom.functions.labels import without_payout_prefix


# Outcomes that carry the bank's reference.
SUCCESSFUL = ("COMPLETED", "SUCCESS")


def _lookup(rows: DataFrame, reference: Column, targets: DataFrame, key: str, found: str, out: str) -> DataFrame:
    side = targets.filter(F.col(key).isNotNull()).select(F.col(key).alias("_target"), F.col(found).alias(out))
    return rows.withColumn("_ref", reference).join(side, F.col("_ref") == F.col("_target"), "left").drop(
        "_ref", "_target")


def _by_either(webhooks: DataFrame, records: DataFrame, keys: tuple[str, str], found: str) -> DataFrame:
    """Add ``found`` of the record that ``order_id`` refers to, by the first key, else by the second.

    Each key is unique among the records that have it. Both joins are on the same reference, so the webhooks are dealt once.
    """
    rows = webhooks.withColumn("_ref", spread_nulls("order_id", "webhook_id"))
    for i, key in enumerate(keys):
        side = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("_target"), F.col(found).alias(f"_found_{i}"))
        rows = rows.join(side, F.col("_ref") == F.col("_target"), "left").drop("_target")
    return rows.withColumn(found, F.coalesce("_found_0", "_found_1")).drop("_ref", "_found_0", "_found_1")


def match_pg_webhooks(webhooks: DataFrame, transfers: DataFrame) -> DataFrame:
    """Add ``transfer_id``: by idempotency key, else by the transfer's own id; null means a standalone payment."""
    return _by_either(webhooks, transfers, ("idempotency_key", "transfer_id"), "transfer_id")


def match_standalone_webhooks(webhooks: DataFrame, payments: DataFrame) -> DataFrame:
    """Add ``transaction_id``: by order id, else by the gateway's order id."""
    return _by_either(webhooks, payments, ("order_id", "cf_order_id"), "transaction_id")


def match_payout_webhooks(webhooks: DataFrame, transfers: DataFrame) -> DataFrame:
    """Add ``transfer_id``: by the reference without its payout prefix, else by payout id."""
    stripped = webhooks.withColumn("_stripped", without_payout_prefix("transfer_ref"))
    by_id = _lookup(stripped, spread_nulls("_stripped", "webhook_id"), transfers, "transfer_id", "transfer_id", "_by_id")
    both = _lookup(by_id, spread_nulls("cf_payout_id", "webhook_id"), transfers, "cf_payout_id", "transfer_id", "_by_po")
    return both.withColumn("transfer_id", F.coalesce("_by_id", "_by_po")).drop("_stripped", "_by_id", "_by_po")


def transfer_outcome() -> Column:
    """State a webhook asks for, by its type and the transfer's type; null when it changes nothing."""
    event, kind = F.col("event_type"), F.col("transfer_type")
    return (
        F.when((event == "PAYMENT_SUCCESS_WEBHOOK") & (kind == "ACCOUNT_TO_WALLET"), "COMPLETED")
        .when((event == "PAYMENT_SUCCESS_WEBHOOK") & (kind == "ACCOUNT_TO_ACCOUNT"), "PAYOUT_INITIATED")
        .when(event.isin("PAYMENT_FAILED_WEBHOOK", "PAYMENT_USER_DROPPED_WEBHOOK"), "FAILED")
        .when(event == "TRANSFER_SUCCESS", "COMPLETED")
        .when((event == "TRANSFER_FAILED") & (kind == "WALLET_TO_ACCOUNT"), "REVERSED")
        .when(event == "TRANSFER_FAILED", "FAILED")
        .when(event == "TRANSFER_REVERSED", "REVERSED")
    )


def payment_outcome() -> Column:
    event = F.col("event_type")
    return (
        F.when(event == "PAYMENT_SUCCESS_WEBHOOK", "SUCCESS").when(event == "PAYMENT_FAILED_WEBHOOK", "FAILED")
        .when(event == "PAYMENT_USER_DROPPED_WEBHOOK", "CANCELLED").otherwise("PROCESSING")
    )


def _failure_reason(event: Column, detail: Column) -> Column:
    return (
        F.when(event == "PAYMENT_FAILED_WEBHOOK", detail)
        .when(event == "PAYMENT_USER_DROPPED_WEBHOOK", detail)
        .when(event == "TRANSFER_FAILED", F.concat(F.lit("Payout failed: "), detail))
        .when(event == "TRANSFER_REVERSED", "Payout reversed by bank")
    )


def _apply(records: DataFrame, key: str, events: DataFrame, outcome: Column, terminal: tuple[str, ...]) -> DataFrame:
    """Final state per record: the first terminal outcome in event order, else the last other outcome.

    An event without a readable time decides only when no other does. Events are sorted once, by
    record for the join; the outcomes are folded in the order that the join leaves, so grouping by the record's key
    alone needs no further sort or shuffle. A record with very many events is split by the join and
    combined after it. An event's columns are shuffled once each; what they are compared by is put together after the join.
    """
    about = ("event_time", "webhook_id", "detail", "bank_reference", "cf_payment_id")
    named = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("_record"), "event_type", *about)
    timed = F.col("event_time").isNotNull()
    first, last = F.struct((~timed).alias("untimed"), *about).alias("first"), F.struct(timed.alias("timed"), *about).alias("last")
    seen = records.join(named, F.col(key) == F.col("_record"), "left")
    asked = seen.withColumn("outcome", F.when(F.col("event_type").isNotNull(), outcome))
    ends = F.col("outcome").isin(*terminal)
    others = [c for c in records.columns if c != key]
    decided = asked.groupBy(key).agg(
        *[F.any_value(c).alias(c) for c in others],
        F.min(F.when(ends, F.struct(first, "outcome", "event_type"))).alias("final"),
        F.max(F.when(~ends, F.struct(last, "outcome", "event_type"))).alias("open"),
        F.count("_record").alias("webhooks"))
    was_terminal = F.col("status").isin(*terminal)
    has_final, has_open = F.col("final").isNotNull(), F.col("open").isNotNull()
    return decided.select(
        *records.columns,
        F.when(was_terminal, F.col("status")).when(has_final, F.col("final.outcome"))
        .when(has_open, F.col("open.outcome")).otherwise(F.col("status")).alias("new_status"),
        F.when(was_terminal, F.lit(None)).when(has_final, F.col("final.first.webhook_id"))
        .when(has_open, F.col("open.last.webhook_id")).alias("decided_by"),
        F.when(was_terminal, F.lit(None)).when(has_final, F.col("final.first.event_time"))
        .when(has_open, F.col("open.last.event_time")).alias("decided_at"),
        F.when(~was_terminal & has_final, _failure_reason(F.col("final.event_type"), F.col("final.first.detail")))
        .alias("webhook_failure_reason"),
        F.when(~was_terminal & F.col("final.outcome").isin(*SUCCESSFUL), F.col("final.first.bank_reference"))
        .alias("webhook_bank_reference"),
        F.when(was_terminal, F.lit(None)).when(has_final, F.col("final.first.cf_payment_id"))
        .when(has_open, F.col("open.last.cf_payment_id")).alias("webhook_payment_id"),
        "webhooks",
    )


def payment_detail() -> Column:
    """What went wrong with a payment: the error's description and code, or the payment's message without an error."""
    return F.when(
        F.coalesce("error_description", "error_code").isNotNull(),
        F.concat(F.coalesce("error_description", F.lit("")), F.lit(" ["), F.coalesce("error_code", F.lit("")), F.lit("]")),
    ).otherwise(F.col("payment_message"))


def apply_to_transfers(transfers: DataFrame, pg_matched: DataFrame, payout_matched: DataFrame) -> DataFrame:
    events = pg_matched.select("transfer_id", "event_type", "event_time", F.concat(F.lit("pg-"), "webhook_id")
                               .alias("webhook_id"), payment_detail().alias("detail"), "bank_reference", "cf_payment_id").unionByName(
        payout_matched.select("transfer_id", "event_type", "event_time", F.concat(F.lit("po-"), "webhook_id")
                              .alias("webhook_id"), F.col("failure_reason").alias("detail"), "bank_reference",
                              F.lit(None).cast("string").alias("cf_payment_id")))
    records = transfers.select("transfer_id", "transfer_type", "status")
    return _apply(records, "transfer_id", events, transfer_outcome(), TERMINAL_TRANSFER_STATUSES)


def apply_to_payments(payments: DataFrame, matched: DataFrame) -> DataFrame:
    dropped = F.col("event_type") == "PAYMENT_USER_DROPPED_WEBHOOK"
    detail = F.when(dropped, "User dropped payment on checkout page").otherwise(payment_detail())
    events = matched.select("transaction_id", "event_type", "event_time", "webhook_id", detail.alias("detail"),
                            "bank_reference", "cf_payment_id")
    records = payments.select("transaction_id", "status")
    return _apply(records, "transaction_id", events, payment_outcome(), TERMINAL_GATEWAY_STATUSES)


def idempotent_requests(payments: DataFrame) -> DataFrame:
    """One payment per idempotency key (the order id stands in for a missing key); the earliest wins."""
    first = F.struct("initiated_at", "transaction_id", "order_id", "status", "amount")
    return (
        payments.groupBy(F.coalesce("idempotency_key", "order_id").alias("request_key"))
        .agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("requests"))
        .select("request_key", "f.transaction_id", "f.order_id", "f.status", "f.amount", "f.initiated_at", "requests")
    )
