"""Wallet ledger: statements, balances and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.domains import STATUS_PATHS
from ledgerloom.operators.paging import page_after
from ledgerloom.operators.running import previous_value, row_numbers, running_sum
from ledgerloom.schemas import MONEY, TOTAL

STATEMENT_COLUMNS = ["transaction_id", "transfer_id", "transaction_type", "amount", "balance_before",
                     "balance_after", "currency", "description", "created_at"]
ORDER = ["created_at", "transaction_id"]


def signed_amount() -> Column:
    return F.when(F.col("transaction_type") == "DEBIT", -F.col("amount")).otherwise(F.col("amount")).cast(MONEY)


def with_balances(moves: DataFrame) -> DataFrame:
    """Ledger rows with the balance before and after each, from the running sum per wallet."""
    summed = running_sum(moves, ["wallet_id"], ORDER, signed_amount(), "balance_after")
    return summed.withColumns({
        "balance_before": (F.col("balance_after") - signed_amount()).cast(MONEY),
        "balance_after": F.col("balance_after").cast(MONEY),
    })


def wallet_balances(moves: DataFrame) -> DataFrame:
    """Closing balance per wallet."""
    return moves.groupBy("wallet_id").agg(
        F.sum(signed_amount()).cast(TOTAL).alias("balance"), F.count(F.lit(1)).alias("entries"),
        F.max("created_at").alias("last_entry_at"))


NEWEST = [("created_at", True), ("transaction_id", True)]
AUDIT_NEWEST = [("created_at", True), ("audit_id", True)]


def statement(ledger: DataFrame, wallet_id: str, wallet_type: str, page: int = 0, size: int = 20,
              after: Sequence | None = None) -> DataFrame:
    """One page of a wallet's statement, newest first, by its number or, cheaper for later pages, after a cursor."""
    rows = ledger.filter((F.col("wallet_id") == wallet_id) & (F.col("wallet_type") == wallet_type))
    return page_after(rows, NEWEST, size, after, page).select(*STATEMENT_COLUMNS)


def statement_pages(ledger: DataFrame, size: int = 20) -> DataFrame:
    """Every wallet's statement with page numbers."""
    numbered = row_numbers(ledger, ["wallet_id", "wallet_type"], ORDER, "position", descending=True)
    page = F.floor((F.col("position") - 1) / F.lit(size)).cast("bigint")
    return numbered.select("wallet_id", "wallet_type", *STATEMENT_COLUMNS, "position", page.alias("page"))


def transfer_ledger(ledger: DataFrame, transfer_id: str) -> DataFrame:
    return ledger.filter(F.col("transfer_id") == transfer_id).orderBy(*ORDER)


def transfer_audit(audit: DataFrame, transfer_id: str) -> DataFrame:
    return audit.filter(F.col("transfer_id") == transfer_id).orderBy("created_at", "audit_id")


def ordered_ledger(ledger: DataFrame) -> DataFrame:
    """Every transfer's ledger rows with their place, oldest first."""
    return row_numbers(ledger, ["transfer_id"], ORDER, "position")


def ordered_audit(audit: DataFrame) -> DataFrame:
    """Every transfer's audit rows with their place, oldest first."""
    return row_numbers(audit, ["transfer_id"], ["created_at", "audit_id"], "position")


def wallet_audit(audit: DataFrame, wallet_id: str, page: int = 0, size: int = 20, after: Sequence | None = None) -> DataFrame:
    """One page of a wallet's audit trail, newest first, by its number or, cheaper for later pages, after a cursor."""
    return page_after(audit.filter(F.col("wallet_id") == wallet_id), AUDIT_NEWEST, size, after, page)


def wallet_audit_pages(audit: DataFrame, size: int = 20) -> DataFrame:
    """Every wallet's audit trail with page numbers, newest first."""
    numbered = row_numbers(audit, ["wallet_id"], ["created_at", "audit_id"], "position", descending=True)
    return numbered.withColumn("page", F.floor((F.col("position") - 1) / F.lit(size)).cast("bigint"))


def continuity_gaps(ledger: DataFrame) -> DataFrame:
    """Rows that break the ledger: wrong arithmetic, a gap to the row before, or a negative balance."""
    linked = previous_value(ledger, ["wallet_id"], ORDER, "balance_after", "previous_balance")
    arithmetic = F.col("balance_after") != (F.col("balance_before") + signed_amount()).cast(MONEY)
    gap = F.col("previous_balance").isNotNull() & (F.col("balance_before") != F.col("previous_balance"))
    negative = F.col("balance_after") < 0
    return linked.select(
        "wallet_id", "transaction_id", "created_at", "balance_before", "balance_after", "previous_balance",
        arithmetic.alias("wrong_arithmetic"), gap.alias("gap"), negative.alias("negative"),
    ).filter(F.col("wrong_arithmetic") | F.col("gap") | F.col("negative"))


def double_entry_faults(transfers: DataFrame, legs: DataFrame) -> DataFrame:
    """Completed wallet-to-wallet transfers without exactly one matching debit and one matching credit.

    Legs are summed per transfer, side and wallet before they meet the transfers.
    """
    sides = legs.groupBy("transfer_id", "transaction_type", "wallet_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast(TOTAL).alias("total"))
    wanted = transfers.filter((F.col("status") == "COMPLETED") & (F.col("transfer_type") == "WALLET_TO_WALLET")).select(
        "transfer_id", "source_wallet_id", "destination_wallet_id", "amount", "net_amount")
    joined = wanted.join(sides, "transfer_id", "left")
    debit, credit = F.col("transaction_type") == "DEBIT", F.col("transaction_type") == "CREDIT"
    debit_ok = debit & (F.col("wallet_id") == F.col("source_wallet_id")) & (F.col("n") == 1) & (
        F.col("total") == F.col("amount"))
    credit_ok = credit & (F.col("wallet_id") == F.col("destination_wallet_id")) & (F.col("n") == 1) & (
        F.col("total") == F.col("net_amount"))
    checked = joined.groupBy("transfer_id").agg(
        F.count(F.when(debit, 1)).alias("debit_sides"), F.count(F.when(debit_ok, 1)).alias("good_debits"),
        F.count(F.when(credit, 1)).alias("credit_sides"), F.count(F.when(credit_ok, 1)).alias("good_credits"))
    problem = (
        F.when(F.col("debit_sides") == 0, "debit missing").when(F.col("credit_sides") == 0, "credit missing")
        .when((F.col("good_debits") != 1) | (F.col("debit_sides") != 1), "debit wrong")
        .when((F.col("good_credits") != 1) | (F.col("credit_sides") != 1), "credit wrong")
    )
    return checked.select("transfer_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def legal_steps() -> list[tuple[str, str, str]]:
    """Allowed (type, from, to): along the path, from its last state to an end, and to FAILED from anywhere."""
    steps = set()
    for kind, (path, ends) in STATUS_PATHS.items():
        steps.update((kind, a, b) for a, b in zip(path, path[1:]))
        steps.update((kind, path[-1], end) for end in ends)
        steps.update((kind, state, "FAILED") for state in path)
    return sorted(steps)


def illegal_steps(audit: DataFrame, transfers: DataFrame) -> DataFrame:
    """Status changes outside the allowed path, and changes that do not start where the one before ended."""
    kinds = transfers.select("transfer_id", "transfer_type")
    linked = previous_value(audit.join(kinds, "transfer_id"), ["transfer_id"], ["created_at", "audit_id"],
                            "new_value", "state_before")
    step = F.concat_ws(">", "transfer_type", "previous_value", "new_value")
    allowed = step.isin(*[">".join(s) for s in legal_steps()])
    broken = F.col("state_before").isNotNull() & (F.col("state_before") != F.col("previous_value"))
    return linked.select(
        "audit_id", "transfer_id", "transfer_type", "previous_value", "new_value", "state_before",
        (~allowed).alias("illegal"), broken.alias("broken"),
    ).filter(F.col("illegal") | F.col("broken"))
