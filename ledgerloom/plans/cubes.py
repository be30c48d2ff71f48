"""Named dimensions, measures and segments over the daily summaries."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.domains import FAILED_STATUSES, TERMINAL_TRANSFER_STATUSES
from ledgerloom.functions.labels import blank_to_null
from ledgerloom.functions.periods import week_of
from ledgerloom.schemas import AVERAGE, RATE, TOTAL

# Upper bounds and labels of the amount bands.
AMOUNT_BANDS = (
    (1000, "A: < ₹1K"), (10000, "B: ₹1K – ₹10K"), (100000, "C: ₹10K – ₹1L"), (1000000, "D: ₹1L – ₹10L"),
)
TOP_BAND = "E: > ₹10L"
ORG_LEVEL = "ORG_LEVEL"


@dataclass(frozen=True)
class Measure:
    """An aggregate, or the share that a group's aggregate has in the total of the whole query."""

    aggregate: Column
    needs: tuple[str, ...]
    share: bool = False
    additive: bool = True


@dataclass(frozen=True)
class Cube:
    name: str
    dimensions: dict[str, Column]
    measures: dict[str, Measure]
    segments: dict[str, Column]
    scope_member: str | None = None
    time_member: str = "txn_date"
    members: frozenset[str] = field(default_factory=frozenset)

    def check(self, names, kind: str) -> None:
        known = getattr(self, kind)
        for name in names:
            if name not in known or (self.members and name not in self.members):
                raise ValueError(f"{self.name} has no {kind[:-1]} named {name}")


def rate(part: Column, whole: Column) -> Column:
    """Percentage to two places; null when the whole is zero."""
    return F.round(F.lit(Decimal("100.0")) * part / F.nullif(whole, F.lit(0)), 2).cast(RATE)


def amount_band(total: str = "total_amount") -> Column:
    bands = F.when(F.lit(False), "")
    for bound, label in AMOUNT_BANDS:
        bands = bands.when(F.col(total) < bound, label)
    return bands.otherwise(TOP_BAND)


def _shared_dimensions() -> dict[str, Column]:
    return {
        "txn_date": F.col("txn_date"),
        "txn_year": F.year("txn_date"),
        "txn_quarter": F.quarter("txn_date"),
        "txn_month": F.month("txn_date"),
        "txn_week": week_of("txn_date"),
        "counterparty_id": F.col("counterparty_id"),
        # The summary stores '' for a missing value, so blanks fall back as nulls do.
        "counterparty_name": F.coalesce(blank_to_null("counterparty_name"), F.col("counterparty_id")),
        "counterparty_type": F.col("counterparty_type"),
        "transfer_type": F.col("transfer_type"),
        "status": F.col("status"),
        "amount_bucket": amount_band(),
    }


def _shared_measures() -> dict[str, Measure]:
    completed = F.col("status") == "COMPLETED"
    failed = F.col("status").isin(*FAILED_STATUSES)
    count = F.sum("txn_count")

    def total(column: str) -> Column:
        return F.sum(column).cast(TOTAL)

    zero = F.lit(0)
    return {
        "total_transactions": Measure(count, ("txn_count",)),
        "unique_counterparties": Measure(F.count_distinct("counterparty_id"), ("counterparty_id",), additive=False),
        "total_amount": Measure(total("total_amount"), ("total_amount",)),
        "total_net_amount": Measure(total("total_net_amount"), ("total_net_amount",)),
        "total_fees": Measure(total("total_fees"), ("total_fees",)),
        "completed_amount": Measure(
            F.sum(F.when(completed, F.col("total_amount")).otherwise(zero)).cast(TOTAL), ("status", "total_amount")),
        "avg_transaction_amount": Measure(
            (F.sum("avg_amount").cast(AVERAGE) / F.count("avg_amount")).cast(AVERAGE), ("avg_amount",), additive=False),
        "max_single_txn": Measure(F.max("max_amount"), ("max_amount",)),
        "min_single_txn": Measure(F.min("min_amount"), ("min_amount",)),
        "total_amount_pct": Measure(F.sum("total_amount"), ("total_amount",), share=True),
        "total_txn_pct": Measure(F.sum("txn_count"), ("txn_count",), share=True),
        "success_rate": Measure(
            rate(F.sum(F.when(completed, F.col("txn_count")).otherwise(zero)), count), ("status", "txn_count")),
        "failure_rate": Measure(
            rate(F.sum(F.when(failed, F.col("txn_count")).otherwise(zero)), count), ("status", "txn_count")),
        "fee_rate": Measure(rate(total("total_fees"), total("total_amount")), ("total_fees", "total_amount")),
    }


def _segments() -> dict[str, Column]:
    status, kind = F.col("status"), F.col("transfer_type")
    return {
        "completed_only": status == "COMPLETED",
        "failed_only": status.isin(*FAILED_STATUSES),
        "pending_only": ~status.isin(*TERMINAL_TRANSFER_STATUSES),
        "wallet_transfers": kind == "WALLET_TO_WALLET",
        "bank_payouts": kind.isin("WALLET_TO_ACCOUNT", "ACCOUNT_TO_ACCOUNT"),
    }


def org_cube() -> Cube:
    division = F.coalesce(blank_to_null("division_id"), F.lit(ORG_LEVEL))
    dimensions = {
        "org_id": F.col("org_id"), "division_id": division,
        "org_division_key": F.concat_ws(" / ", F.col("org_id"), division), **_shared_dimensions(),
    }
    return Cube("OrgPayments", dimensions, _shared_measures(), _segments(), scope_member="org_id")


def customer_cube() -> Cube:
    dimensions = {"customer_id": F.col("customer_id"), **_shared_dimensions()}
    measures = {
        "unique_customers": Measure(F.count_distinct("customer_id"), ("customer_id",), additive=False),
        **_shared_measures(),
    }
    return Cube("CustomerPayments", dimensions, measures, _segments())


# Members the organisation view exposes.
VIEW_MEMBERS = frozenset((
    "org_id", "division_id", "org_division_key", "txn_date", "txn_year", "txn_quarter", "txn_month", "txn_week",
    "counterparty_id", "counterparty_name", "counterparty_type", "transfer_type", "status", "amount_bucket",
    "total_transactions", "total_amount", "total_net_amount", "total_fees", "completed_amount", "total_amount_pct",
    "total_txn_pct", "unique_counterparties", "success_rate", "failure_rate", "fee_rate", "avg_transaction_amount",
    "max_single_txn", "min_single_txn",
    "completed_only", "failed_only", "pending_only", "wallet_transfers", "bank_payouts",
))


def org_division_view() -> Cube:
    cube = org_cube()
    return Cube("OrgDivisionPaymentView", cube.dimensions, cube.measures, cube.segments, cube.scope_member,
                members=VIEW_MEMBERS)
