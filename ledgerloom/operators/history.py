"""Transfer history: filters, sorting, paging, statistics, and whole-table page numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.domains import FAILED_STATUSES, HISTORY_PERIODS
from ledgerloom.functions.periods import as_datetime, history_window, months_before, ts_lit
from ledgerloom.operators.paging import Order, cursor_of, page_after, sorted_by
from ledgerloom.operators.running import row_numbers
from ledgerloom.schemas import TOTAL

# Columns of an item.
ITEM_COLUMNS = [
    "transfer_id", "transfer_type", "status", "source_wallet_id", "source_wallet_type", "source_account_number",
    "source_account_name", "destination_wallet_id", "destination_wallet_type", "destination_account_number",
    "destination_account_name", "amount", "fees", "net_amount", "currency", "description", "failure_reason",
    "bank_reference", "initiated_at", "updated_at",
]

# Column and direction of each named order.
SORT_ORDERS = {
    "DATE_DESC": ("initiated_at", True), "DATE_ASC": ("initiated_at", False),
    "AMOUNT_DESC": ("amount", True), "AMOUNT_ASC": ("amount", False),
}


@dataclass(frozen=True)
class HistoryFilter:
    period: str = "LAST_MONTH"
    start: object = None
    end: object = None
    statuses: Sequence[str] = field(default_factory=tuple)
    sort: str = "DATE_DESC"
    page: int = 0
    size: int = 20
    after: Sequence | None = None  # values of the last row seen, in place of a page number


# ---- predicates -------------------------------------------------------------------------------------------------

def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def within_window(start, end) -> Column:
    """Closed on both ends."""
    return F.col("initiated_at").between(ts_lit(start), ts_lit(end))


def has_status(statuses: Sequence[str]) -> Column:
    """An empty list does not filter."""
    return F.col("status").isin(*statuses) if statuses else F.lit(True)


def source_is(party: str) -> Column:
    return (F.col("source_wallet_id") == party) | (F.col("source_account_number") == party)


def destination_is(party: str) -> Column:
    return (F.col("destination_wallet_id") == party) | (F.col("destination_account_number") == party)


def source_wallet_in(wallets: Sequence[str]) -> Column:
    return F.col("source_wallet_id").isin(*wallets)


def destination_wallet_in(wallets: Sequence[str]) -> Column:
    return F.col("destination_wallet_id").isin(*wallets)


def between_parties(source: str, destination: str) -> Column:
    """Directed: from the first party to the second; each may be a wallet or an account."""
    return source_is(source) & destination_is(destination)


def involving_party(party: str) -> Column:
    return source_is(party) | destination_is(party)


def user_predicate(wallet_id: str, start, end, statuses: Sequence[str] = ()) -> Column:
    return _all([F.col("source_wallet_id") == wallet_id, within_window(start, end), has_status(statuses)])


def party_predicate(start, end, statuses: Sequence[str] = (), source: str | None = None,
                    destination: str | None = None) -> Column:
    """Window, states and optional parties; a blank party is no condition."""
    conditions = [within_window(start, end), has_status(statuses)]
    if source and source.strip():
        conditions.append(source_is(source))
    if destination and destination.strip():
        conditions.append(destination_is(destination))
    return _all(conditions)


# ---- selection --------------------------------------------------------------------------------------------------

def items(transfers: DataFrame) -> DataFrame:
    return transfers.select(*ITEM_COLUMNS)


def customer_transfers(transfers: DataFrame, individual: DataFrame) -> DataFrame:
    """Outbound transfers of customers, with the customer."""
    owners = individual.select(F.col("wallet_id").alias("source_wallet_id"), "customer_id")
    return transfers.join(owners, "source_wallet_id")


def org_wallets(enterprise: DataFrame, org_id: str | None = None, division_id: str | None = None,
                org_level_only: bool = False) -> DataFrame:
    wallets = enterprise
    if org_id is not None:
        wallets = wallets.filter(F.col("org_id") == org_id)
    if division_id and division_id.strip():
        wallets = wallets.filter(F.col("division_id") == division_id)
    elif org_level_only:
        wallets = wallets.filter(F.col("division_id").isNull())
    return wallets


def org_transfers(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """Transfers paid from any of the wallets."""
    return transfers.join(wallets.select(F.col("wallet_id").alias("source_wallet_id")), "source_wallet_id", "left_semi")


def by_source_wallet(transfers: DataFrame, wallet_id: str) -> DataFrame:
    return transfers.filter(F.col("source_wallet_id") == wallet_id).orderBy(F.desc("initiated_at"), "transfer_id")


def by_destination_wallet(transfers: DataFrame, wallet_id: str) -> DataFrame:
    return transfers.filter(F.col("destination_wallet_id") == wallet_id).orderBy(
        F.desc("initiated_at"), "transfer_id")


def by_status(transfers: DataFrame, status: str, page: int = 0, size: int = 20) -> DataFrame:
    return page_of(transfers.filter(F.col("status") == status), "DATE_DESC", page, size)


def order_columns(order: str) -> Order:
    """The named order; the transfer id breaks ties so that pages never overlap."""
    return [SORT_ORDERS[order], ("transfer_id", False)]


def sort_keys(order: str) -> list[Column]:
    return sorted_by(order_columns(order))


def page_of(rows: DataFrame, order: str = "DATE_DESC", page: int = 0, size: int = 20) -> DataFrame:
    """One page by its number, for looking at the first few: a page costs as much as all pages before it.

    Pages that follow one another are read with :func:`ledgerloom.operators.paging.page_after`, whole histories
    with :func:`numbered_pages`, once for every page.
    """
    if size < 1 or page < 0:
        raise ValueError("page must be at least 0 and size at least 1")
    return rows.orderBy(*sort_keys(order)).offset(page * size).limit(size)


def page_info(rows: DataFrame, page: int, size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(
        F.lit(page).alias("page"), F.lit(size).alias("size"), total.alias("total_elements"),
        F.ceil(total / F.lit(size)).alias("total_pages"))


# ---- requests ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class History:
    """Lazy parts of a history answer."""

    items: DataFrame
    info: DataFrame
    page_stats: DataFrame
    window_stats: DataFrame
    window: tuple
    order: Order

    def next_page(self) -> tuple | None:
        """What to ask with as ``after`` for the next page; None behind the last row."""
        return cursor_of(self.items, self.order)


def _answer(rows: DataFrame, chosen: HistoryFilter, window: tuple) -> History:
    if chosen.after is not None:
        page = page_after(rows, order_columns(chosen.sort), chosen.size, chosen.after)
    else:
        page = page_of(rows, chosen.sort, chosen.page, chosen.size)
    return History(items(page), page_info(rows, chosen.page, chosen.size), stats(page), stats(rows), window, order_columns(chosen.sort))


def user_history(transfers: DataFrame, individual: DataFrame, customer_id: str, chosen: HistoryFilter,
                 as_of) -> History:
    start, end = history_window(as_of, chosen.period, chosen.start, chosen.end)
    wallets = individual.filter(F.col("customer_id") == customer_id)
    rows = customer_transfers(transfers.filter(party_predicate(start, end, chosen.statuses)), wallets)
    return _answer(rows, chosen, (start, end))


def org_history(transfers: DataFrame, enterprise: DataFrame, org_id: str, chosen: HistoryFilter, as_of,
                division_id: str | None = None, source: str | None = None,
                destination: str | None = None) -> History:
    start, end = history_window(as_of, chosen.period, chosen.start, chosen.end)
    wanted = transfers.filter(party_predicate(start, end, chosen.statuses, source, destination))
    return _answer(org_transfers(wanted, org_wallets(enterprise, org_id, division_id)), chosen, (start, end))


def between_history(transfers: DataFrame, source: str, destination: str, chosen: HistoryFilter, as_of) -> History:
    start, end = history_window(as_of, chosen.period, chosen.start, chosen.end)
    rows = transfers.filter(between_parties(source, destination) & within_window(start, end)
                            & has_status(chosen.statuses))
    return _answer(rows, chosen, (start, end))


# ---- statistics -------------------------------------------------------------------------------------------------

def _stat_columns() -> list[Column]:
    status = F.col("status")
    done, failed = status == "COMPLETED", status.isin(*FAILED_STATUSES)
    zero = F.lit(0).cast(TOTAL)
    return [
        F.coalesce(F.sum(F.when(done, F.col("amount"))).cast(TOTAL), zero).alias("total_amount_spent"),
        zero.alias("total_amount_received"),
        F.count(F.when(done, 1)).alias("success_count"),
        F.count(F.when(failed, 1)).alias("failed_count"),
        F.count(F.when(~(done | failed), 1)).alias("pending_count"),
    ]


def stats(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Completed sum and counts by outcome. Nothing is ever received on outbound history."""
    return rows.groupBy(*keys).agg(*_stat_columns()) if keys else rows.agg(*_stat_columns())


def period_membership(transfers: DataFrame, as_of) -> DataFrame:
    """Transfers and amounts inside each named period, in one pass."""
    now = as_datetime(as_of)
    inside = {p: within_window(months_before(now, m), now) for p, m in HISTORY_PERIODS.items()}
    totals = transfers.agg(*[
        F.struct(F.lit(p).alias("period"), F.count(F.when(c, 1)).alias("transfers"),
                 F.coalesce(F.sum(F.when(c, F.col("amount"))).cast(TOTAL), F.lit(0).cast(TOTAL)).alias("amount"))
        .alias(p) for p, c in inside.items()])
    return totals.select(F.inline(F.array(*HISTORY_PERIODS)))


def numbered_pages(rows: DataFrame, subject: str, size: int = 20) -> DataFrame:
    """Every row with its place and page in its subject's history, newest first.

    A subject with most of the rows is spread over all tasks.
    """
    numbered = row_numbers(rows, [subject], ["initiated_at", "transfer_id"], "position", descending=True)
    return numbered.withColumn("page", F.floor((F.col("position") - 1) / F.lit(size)).cast("bigint"))


# ---- destination groups -----------------------------------------------------------------------------------------

# The columns of each kind of group.
_WALLET_GROUP = ["destination_wallet_id", "destination_wallet_type", "destination_account_name"]
_ACCOUNT_GROUP = ["destination_account_number", "destination_account_name", "destination_ifsc"]
_ORG_GROUP = ["destination_wallet_id", "destination_wallet_type", "destination_account_number",
              "destination_account_name"]


def _group(rows: DataFrame, keys: list[str]) -> DataFrame:
    done = F.col("status") == "COMPLETED"
    return rows.groupBy(*keys).agg(
        F.sum("amount").cast(TOTAL).alias("total_amount"),
        F.sum("net_amount").cast(TOTAL).alias("total_net_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(F.when(done, F.col("amount")).otherwise(F.lit(0))).cast(TOTAL).alias("completed_amount"),
        F.count(F.when(done, 1)).alias("completed_count"),
    )


def group_by_destination_wallet(rows: DataFrame, subject: Sequence[str] = ("source_wallet_id",)) -> DataFrame:
    """Destination wallets; transfers to bank accounts are left out."""
    return _group(rows.filter(F.col("destination_wallet_id").isNotNull()), [*subject, *_WALLET_GROUP])


def group_by_destination_account(rows: DataFrame, subject: Sequence[str] = ("source_wallet_id",)) -> DataFrame:
    """Destination bank accounts; transfers to wallets are left out."""
    to_account = F.col("destination_wallet_id").isNull() & F.col("destination_account_number").isNotNull()
    return _group(rows.filter(to_account), [*subject, *_ACCOUNT_GROUP])


def with_org(transfers: DataFrame, enterprise: DataFrame) -> DataFrame:
    owners = enterprise.select(F.col("wallet_id").alias("source_wallet_id"), "org_id", "division_id")
    return transfers.join(owners, "source_wallet_id")


def group_by_destination_of_org(rows: DataFrame, subject: Sequence[str] = ("org_id",)) -> DataFrame:
    return _group(rows, [*subject, *_ORG_GROUP])


_SUMMARY = ["destination_id", "destination_type", "destination_name", "total_amount", "total_net_amount",
            "transaction_count", "completed_amount", "completed_count"]


def destination_summary(rows: DataFrame, subject: Sequence[str] = ("source_wallet_id",)) -> DataFrame:
    """Wallet and bank destinations in one list, per paying wallet.

    The two groupings are over the same rows with disjoint conditions, so they
    share one pass: the destination's kind is part of the key.
    """
    is_wallet = F.col("destination_wallet_id").isNotNull()
    tagged = rows.filter(is_wallet | F.col("destination_account_number").isNotNull()).withColumns({
        "destination_type": F.when(is_wallet, "WALLET").otherwise("BANK_ACCOUNT"),
        "destination_id": F.coalesce("destination_wallet_id", "destination_account_number"),
        "_detail": F.when(is_wallet, F.col("destination_wallet_type")).otherwise(F.col("destination_ifsc")),
        "destination_name": F.col("destination_account_name"),
    })
    grouped = _group(tagged, [*subject, "destination_id", "destination_type", "destination_name", "_detail"])
    return grouped.select(*subject, *_SUMMARY)


def org_destination_summary(rows: DataFrame, subject: Sequence[str] = ("org_id",)) -> DataFrame:
    grouped = group_by_destination_of_org(rows, subject)
    is_wallet = F.col("destination_wallet_id").isNotNull()
    return grouped.select(
        *subject, F.when(is_wallet, F.col("destination_wallet_id")).otherwise(F.col("destination_account_number"))
        .alias("destination_id"), F.when(is_wallet, "WALLET").otherwise("BANK_ACCOUNT").alias("destination_type"),
        F.col("destination_account_name").alias("destination_name"), *_SUMMARY[3:])


def largest_first(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("total_amount"), *[c for c in groups.columns if c.startswith("destination")])
