"""Text and party columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.domains import GATEWAY_STATUS_TEXT, PAYOUT_PREFIX, TRANSFER_STATUS_TEXT


def blank_to_null(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.trim(c) != "", c)


def empty_for_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def _lookup(column: str, texts: dict[str, str], otherwise: Column) -> Column:
    start = F.when(F.lit(False), otherwise)
    chain = reduce(lambda acc, kv: acc.when(F.col(column) == kv[0], F.lit(kv[1])), texts.items(), start)
    return chain.otherwise(otherwise)


def transfer_status_text(column: str = "status") -> Column:
    return _lookup(column, TRANSFER_STATUS_TEXT, F.lit(None).cast("string"))


def gateway_status_text(column: str = "status") -> Column:
    return _lookup(column, GATEWAY_STATUS_TEXT, F.col(column))


def counterparty_id() -> Column:
    """Wallet when the transfer has one, else the bank account."""
    return F.coalesce("destination_wallet_id", "destination_account_number")


def counterparty_type() -> Column:
    return F.when(F.col("destination_wallet_id").isNotNull(), "WALLET").otherwise("BANK_ACCOUNT")


def routing_key() -> Column:
    return F.coalesce("customer_id", "org_id", "transfer_id")


def without_payout_prefix(column: str) -> Column:
    return F.regexp_replace(column, f"^{PAYOUT_PREFIX}", "")


def stable_id(*columns: str) -> Column:
    """A replay-stable surrogate in place of a random identifier."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
