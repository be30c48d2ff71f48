"""Partner settlement, reconciliation, refunds, dunning, intents and the payment funnel.

All of this is *spec*: the requirements describe it, no earlier code does.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ledgerloom.functions.periods import ts_lit
from ledgerloom.plans.cubes import rate
from ledgerloom.schemas import TOTAL

# Workers receive these functions themselves, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
CYCLE_DAYS = {"NET_7": 7, "NET_15": 15, "NET_30": 30}
GST_ON_COMMISSION = Decimal("0.18")
REFUND_DAYS = {"CARD": 180, "UPI": 30}
RETRY_HOURS = (24, 48, 72)
PAUSE_AFTER_DAYS = 7
CANCEL_AFTER_DAYS = 30

BATCH_KEYS = ["payer_party_id", "payee_party_id", "payment_cycle"]


def _choose(column: str, values: dict, kind: str) -> Column:
    empty = F.lit(None).cast(kind)
    return reduce(lambda acc, kv: acc.when(F.col(column) == kv[0], F.lit(kv[1])), values.items(),
                  F.when(F.lit(False), empty)).otherwise(empty)


def cycle_end(approved_on: str = "approved_on") -> Column:
    """The day on which the payment cycle that an invoice falls into is closed; cycles are counted from 1970-01-01."""
    days = _choose("payment_cycle", CYCLE_DAYS, "int")
    return F.date_from_unix_date(((F.floor(F.unix_date(approved_on) / days) + 1) * days).cast("int"))


def batch_id() -> Column:
    """Later invoices of the same pair fall into a later cycle, never into a batch that may have been paid."""
    return F.concat_ws("-", F.lit("stl"), *BATCH_KEYS, F.col("cycle_end").cast("string"))


def due_date(approved_on: str = "approved_on") -> Column:
    return F.date_add(F.col(approved_on), _choose("payment_cycle", CYCLE_DAYS, "int"))


def batch_lines(invoices: DataFrame) -> DataFrame:
    """Approved invoices with the batch they belong to.

    The invoice list of a batch is this table: as an array it would put all
    invoices of a large partner into one row of one task.
    """
    approved = invoices.filter(F.col("status") == "APPROVED").withColumn("cycle_end", cycle_end())
    return approved.select(batch_id().alias("batch_id"), "invoice_id", *BATCH_KEYS, "cycle_end", "gross_amount", "approved_on",
                           due_date().alias("due_date"))


def settlement_batches(invoices: DataFrame) -> DataFrame:
    """One batch per payer, payee and closed cycle; due when its last invoice is."""
    return batch_lines(invoices).groupBy("batch_id", *BATCH_KEYS, "cycle_end").agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum("gross_amount").cast(TOTAL).alias("gross_amount"),
        F.max("due_date").alias("due_date"),
    )


def with_deductions(batches: DataFrame, terms: DataFrame) -> DataFrame:
    """Commission, tax on it, tax withheld and what remains, from the payee's contract terms.

    Without complete terms nothing can be deducted: the amounts stay null and the batch is held.
    """
    joined = batches.join(terms, "payee_party_id", "left")
    held = F.col("commission_pct").isNull() | F.col("tds_rate").isNull()
    joined = joined.withColumn("status", F.when(held, "HELD").otherwise("READY"))
    commission = (F.col("gross_amount") * F.col("commission_pct")).cast(TOTAL)
    with_commission = joined.withColumn("platform_commission", commission)
    gst = (F.col("platform_commission") * F.lit(GST_ON_COMMISSION)).cast(TOTAL)
    tds = (F.col("gross_amount") * F.col("tds_rate")).cast(TOTAL)
    deducted = with_commission.withColumns({"gst_on_commission": gst, "tds_withheld": tds})
    net = F.col("gross_amount") - F.col("platform_commission") - F.col("gst_on_commission") - F.col("tds_withheld")
    return deducted.withColumn("net_payable", net.cast(TOTAL)).drop("commission_pct", "tds_rate")


def reconcile(settlements: DataFrame, bank_entries: DataFrame) -> DataFrame:
    """Settlements against bank credits by bank reference; several credits of one reference are summed first."""
    credits = bank_entries.groupBy("bank_ref").agg(
        F.sum("amount").cast(TOTAL).alias("credited"), F.max("value_date").alias("value_date"),
        F.count(F.lit(1)).alias("credits"))
    ours = settlements.select("bank_ref", "batch_id", "net_payable", "due_date")
    both = ours.join(credits, "bank_ref", "full_outer")
    status = (
        F.when(F.col("batch_id").isNull(), "UNMATCHED_BANK").when(F.col("credited").isNull(), "UNMATCHED_SETTLEMENT")
        .when(F.col("credited") == F.col("net_payable"), "MATCHED").otherwise("PARTIAL")
    )
    late = F.coalesce(F.col("value_date") > F.col("due_date"), F.lit(False))
    return both.select("bank_ref", "batch_id", "net_payable", "credited", "credits",
                       status.alias("reconciliation"), late.alias("delayed"))


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take each payment's requests in their order; one that fits what is left is granted and lowers it."""
    payment, left = None, 0
    for batch in batches:
        granted = []
        for key, paid, asked in zip(*(batch.column(c).to_pylist() for c in ("_turn", "_paid", "_asked"))):
            if key != payment:
                payment, left = key, paid
            fits = asked is not None and left is not None and asked <= left
            left = left - asked if fits else left
            granted.append(fits)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(granted, pa.bool_())], [*batch.schema.names, "_granted"])


def refund_eligibility(refunds: DataFrame, payments: DataFrame) -> DataFrame:
    """Whether each refund request is inside its method's window and still fits the paid amount.

    Requests of a payment count in the order in which they were made. One that is refused, for its time or its amount, uses
    nothing up. Methods without a configured window have no time limit. Each request depends on those before
    it, so a payment's requests are read in order by one task, which holds only the amount that is left;
    requests without a payment are spread.
    """
    paid = payments.filter(F.col("status") == "SUCCESS").select(
        "transaction_id", "payment_method", F.col("amount").cast(TOTAL).alias("paid_amount"),
        F.col("updated_at").alias("paid_at"))
    days = F.date_diff(F.to_date("requested_at"), F.to_date("paid_at"))
    window = _choose("payment_method", REFUND_DAYS, "int")
    joined = refunds.join(paid, "transaction_id", "left")
    in_window = F.coalesce(window.isNull() | (days <= window), F.lit(True))
    cents = F.lit(100)
    counted = F.when(in_window, (F.coalesce("refund_amount", F.lit(0)).cast(TOTAL) * cents).cast("long"))
    turns = joined.select(
        "refund_id", "transaction_id", "refund_amount", "payment_method", "paid_at", "requested_at", in_window.alias("_in_window"),
        F.when(F.col("paid_at").isNotNull(), F.col("transaction_id")).otherwise(F.col("refund_id")).alias("_turn"),
        (F.col("paid_amount") * cents).cast("long").alias("_paid"), counted.alias("_asked"))
    ordered = turns.repartition("_turn").sortWithinPartitions("_turn", "requested_at", "refund_id")
    granted = ordered.mapInArrow(_in_turn, StructType([*ordered.schema.fields, StructField("_granted", BooleanType())]))
    reason = (
        F.when(F.col("paid_at").isNull(), "not paid").when(~F.col("_in_window"), "window over")
        .when(~F.col("_granted"), "exceeds payment")
    )
    return granted.select("refund_id", "transaction_id", "refund_amount", "payment_method",
                          reason.isNull().alias("eligible"), reason.alias("reason"))


def dunning_state(attempts: DataFrame, as_of) -> DataFrame:
    """State of every billing cycle, from counts and times alone.

    A first failure is retried after 24, 48 and 72 hours. When all fail the
    subscription is held, after 7 days paused, after 30 days cancelled.
    """
    failed, paid = ~F.col("succeeded"), F.col("succeeded")
    cycles = attempts.filter(F.col("attempted_at") <= ts_lit(as_of)).groupBy("subscription_id", "cycle_start").agg(
        F.count(F.when(failed, 1)).alias("failures"), F.count(F.when(paid, 1)).alias("payments"),
        F.min(F.when(failed, F.col("attempted_at"))).alias("first_failure"),
        F.max(F.when(failed, F.col("attempted_at"))).alias("last_failure"))
    exhausted = F.col("failures") > len(RETRY_HOURS)
    held_hours = F.timestamp_diff("HOUR", F.col("last_failure"), ts_lit(as_of))
    state = (
        F.when(F.col("payments") > 0, "PAID").when(~exhausted, "RETRYING")
        .when(held_hours >= 24 * CANCEL_AFTER_DAYS, "CANCELLED").when(held_hours >= 24 * PAUSE_AFTER_DAYS, "PAUSED")
        .otherwise("HELD")
    )
    offsets = {i + 1: h for i, h in enumerate(RETRY_HOURS)}
    wait = reduce(lambda acc, kv: acc.when(F.col("failures") == kv[0], F.lit(kv[1])), offsets.items(),
                  F.when(F.lit(False), F.lit(0)))
    retry = F.when(state == "RETRYING", F.col("first_failure") + F.make_dt_interval(F.lit(0), wait))
    return cycles.select("subscription_id", "cycle_start", "failures", state.alias("state"),
                         retry.alias("next_retry_at"),
                         F.when((F.col("payments") == 0) & exhausted, F.col("last_failure")).alias("held_at"))


def expire_intents(intents: DataFrame, as_of) -> DataFrame:
    """Unpaid intents past their expiry become cancelled."""
    over = F.col("status").isin("CREATED", "PROCESSING") & (F.col("expires_at") < ts_lit(as_of))
    return intents.withColumn("new_status", F.when(over, "CANCELLED").otherwise(F.col("status")))


def payment_funnel(payments: DataFrame) -> DataFrame:
    """Conversion and mean time to pay by method."""
    paid = F.col("status") == "SUCCESS"
    seconds = F.timestamp_diff("SECOND", F.col("initiated_at"), F.col("updated_at"))
    total, done = F.count(F.lit(1)), F.count(F.when(paid, 1))
    return payments.groupBy("payment_method").agg(
        total.alias("payments"), done.alias("paid"), rate(done, total).alias("conversion_rate"),
        (F.sum(F.when(paid, seconds)) / F.nullif(done, F.lit(0))).alias("mean_seconds_to_pay"))


def failure_reasons(payments: DataFrame) -> DataFrame:
    failed = payments.filter(F.col("failure_reason").isNotNull())
    return failed.groupBy("payment_method", "failure_reason").agg(F.count(F.lit(1)).alias("failures"))
