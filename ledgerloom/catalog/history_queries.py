"""History, destinations, ledger and retention over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.oracle_tables import with_tables
from ledgerloom.functions import labels
from ledgerloom.operators import history as h
from ledgerloom.operators import ledger as lg
from ledgerloom.operators import paging
from ledgerloom.operators import retention as rt
from ledgerloom.session import fresh_dir
from ledgerloom.sources import sample_tables as st

AS_OF = "2001-08-01 12:00:00"
WINDOW = h.history_window(AS_OF, "LAST_7_YEARS")


def _in_window(s, d) -> DataFrame:
    return st.wallet_transfers(s, d).filter(h.within_window(*WINDOW))


def _predicates(s, d) -> DataFrame:
    """Every predicate as a flag of every transfer."""
    flags = {
        "in_last_year": h.within_window(*h.history_window(AS_OF, "LAST_YEAR")),
        "in_custom": h.within_window(*h.history_window(AS_OF, "CUSTOM", "1990-01-01", "1997-06-30 23:00:00")),
        "is_settled": h.has_status(["COMPLETED", "REVERSED"]),
        "any_status": h.has_status([]),
        "from_w10": h.source_is("W10"),
        "from_wallets": h.source_wallet_in(["W10", "W11", "W12"]),
        "to_acc7": h.destination_is("ACC7"),
        "to_wallets": h.destination_wallet_in(["W7", "W8"]),
        "w10_to_w30": h.between_parties("W10", "W30"),
        "involves_w7": h.involving_party("W7"),
        "user_w10": h.user_predicate("W10", *WINDOW, ["COMPLETED"]),
        "org_like": h.party_predicate(*WINDOW, ["FAILED"], " ", "W8"),
    }
    return st.wallet_transfers(s, d).select(
        "transfer_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def _ledger(s, d) -> DataFrame:
    return lg.with_balances(st.ledger_moves(s, d))


def _faulty_ledger(s, d) -> DataFrame:
    """One row in 101 has its balances shifted."""
    shift = F.when(F.substring("transaction_id", 2, 20).cast("long") % 101 == 0, 1).otherwise(0)
    return _ledger(s, d).withColumns({
        "balance_before": (F.col("balance_before") + shift).cast("decimal(18,2)"),
        "balance_after": (F.col("balance_after") + 2 * shift).cast("decimal(18,2)"),
    })


def _children(s, d) -> tuple[DataFrame, DataFrame]:
    return st.transfer_legs(s, d), st.audit_steps(s, d)


def _purged_on_disk(s, d) -> DataFrame:
    """Transfers, ledger and audit trail stored by year, purged twice, and read back."""
    base = fresh_dir(s, "purge")
    tables = {"wallet_transfers": (st.wallet_transfers(s, d), "initiated_at", "transfer_id"),
              "wallet_transactions": (st.transfer_legs(s, d), "created_at", "transaction_id"),
              "wallet_audit_logs": (st.audit_steps(s, d), "created_at", "audit_id")}
    paths = {name: f"{base}/{name}" for name in tables}
    for name, (rows, at, _) in tables.items():
        rows.withColumn("year", F.year(at)).write.partitionBy("year").parquet(paths[name])
    for _ in range(2):
        rt.purge(s, paths, "year", _CUTOFF)
    left = [s.read.parquet(paths[name]).select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.col(at).alias("at"))
            for name, (_, at, key) in tables.items()]
    return left[0].unionAll(left[1]).unionAll(left[2])


_CUTOFF = rt.cutoff("2005-02-28 00:00:00", 9)

QUERIES = {
    "history_items": lambda s, d: h.items(st.wallet_transfers(s, d)),
    "status_text": lambda s, d: st.wallet_transfers(s, d).select(
        F.col("transfer_id").alias("record_id"), labels.transfer_status_text().alias("message")).unionAll(
        st.payment_transactions(s, d).select("transaction_id", labels.gateway_status_text())),
    "history_predicates": _predicates,
    "period_membership": lambda s, d: h.period_membership(st.wallet_transfers(s, d), AS_OF),
    "customer_transfers": lambda s, d: h.customer_transfers(
        st.wallet_transfers(s, d), st.individual_wallets(s, d)).select("customer_id", "transfer_id", "amount"),
    "org_transfers": lambda s, d: h.org_transfers(
        st.wallet_transfers(s, d), h.org_wallets(st.enterprise_wallets(s, d))).select("transfer_id", "amount"),
    "org_level_transfers": lambda s, d: h.org_transfers(
        st.wallet_transfers(s, d), h.org_wallets(st.enterprise_wallets(s, d), org_level_only=True)).select("transfer_id"),
    "user_history_pages": lambda s, d: h.numbered_pages(h.customer_transfers(
        _in_window(s, d), st.individual_wallets(s, d)), "customer_id").select(
        "customer_id", "transfer_id", "amount", "initiated_at", "position", "page"),
    "org_history_pages": lambda s, d: h.numbered_pages(h.with_org(
        _in_window(s, d), st.enterprise_wallets(s, d)), "org_id", 50).select(
        "org_id", "transfer_id", "status", "initiated_at", "position", "page"),
    "transfers_by_source_pages": lambda s, d: h.numbered_pages(
        st.wallet_transfers(s, d).filter(F.col("source_wallet_id").isNotNull()), "source_wallet_id").select(
        "source_wallet_id", "transfer_id", "position", "page"),
    "transfers_by_destination_pages": lambda s, d: h.numbered_pages(
        st.wallet_transfers(s, d).filter(F.col("destination_wallet_id").isNotNull()), "destination_wallet_id").select(
        "destination_wallet_id", "transfer_id", "position", "page"),
    "transfers_by_status_pages": lambda s, d: h.numbered_pages(st.wallet_transfers(s, d), "status").select(
        "status", "transfer_id", "position", "page"),
    "transfer_ledger": lambda s, d: lg.ordered_ledger(st.transfer_legs(s, d)),
    "transfer_audit": lambda s, d: lg.ordered_audit(st.audit_steps(s, d)),
    "history_page_by_amount": lambda s, d: h.items(h.page_of(st.wallet_transfers(s, d), "AMOUNT_DESC", 2, 50)),
    "history_page_by_date": lambda s, d: h.items(h.page_of(st.wallet_transfers(s, d), "DATE_ASC", 1, 100)),
    "history_page_after": lambda s, d: h.items(paging.nth_page(_in_window(s, d), h.order_columns("DATE_DESC"), 50, 3)),
    "wallet_audit_pages": lambda s, d: lg.wallet_audit_pages(st.wallet_audit_logs(s, d)).select(
        "wallet_id", "audit_id", "transfer_id", "new_value", "created_at", "position", "page"),
    "failed_transfers_page": lambda s, d: h.items(h.by_status(st.wallet_transfers(s, d), "FAILED", 0, 20)),
    "page_info": lambda s, d: h.page_info(_in_window(s, d), 2, 50),
    "group_by_dest_wallet": lambda s, d: h.group_by_destination_wallet(_in_window(s, d)),
    "group_by_dest_account": lambda s, d: h.group_by_destination_account(
        _in_window(s, d), ["source_account_number"]),
    "group_by_dest_org": lambda s, d: h.group_by_destination_of_org(
        h.with_org(_in_window(s, d), st.enterprise_wallets(s, d))),
    "dest_summary": lambda s, d: h.destination_summary(_in_window(s, d)),
    "org_dest_summary": lambda s, d: h.org_destination_summary(
        h.with_org(_in_window(s, d), st.enterprise_wallets(s, d))),
    "largest_destinations": lambda s, d: h.largest_first(h.destination_summary(_in_window(s, d), [])),
    "history_stats": lambda s, d: h.stats(_in_window(s, d)),
    "customer_history_stats": lambda s, d: h.stats(h.customer_transfers(
        _in_window(s, d), st.individual_wallets(s, d)), ["customer_id"]),
    "ledger_balance": _ledger,
    "wallet_balances": lambda s, d: lg.wallet_balances(st.ledger_moves(s, d)),
    "wallet_statement": lambda s, d: lg.statement_pages(_ledger(s, d)),
    "ledger_continuity": lambda s, d: lg.continuity_gaps(_faulty_ledger(s, d)),
    "double_entry_check": lambda s, d: lg.double_entry_faults(st.wallet_transfers(s, d), st.transfer_legs(s, d)),
    "status_path_check": lambda s, d: lg.illegal_steps(st.audit_steps(s, d), st.wallet_transfers(s, d)),
    "purge_kept_transfers": lambda s, d: rt.kept_records(st.wallet_transfers(s, d), _CUTOFF).select("transfer_id"),
    "purge_kept_ledger": lambda s, d: rt.kept_children(
        _children(s, d)[0], st.wallet_transfers(s, d), _CUTOFF).select("transaction_id"),
    "purge_expired": lambda s, d: rt.purge_counts(
        st.wallet_transfers(s, d), *_children(s, d), st.payment_transactions(s, d), _CUTOFF),
    "purge_on_disk": _purged_on_disk,
    "purge_dry_run": lambda s, d: rt.dry_run(st.wallet_transfers(s, d), st.payment_transactions(s, d), _CUTOFF),
    "oldest_expired": lambda s, d: rt.oldest_expired(st.wallet_transfers(s, d), _CUTOFF),
}

_W = f"initiated_at BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'"
_ITEMS = ", ".join(h.ITEM_COLUMNS)
_CUT = f"TIMESTAMP '{_CUTOFF}'"

_GROUP = """CAST(sum(amount) AS DECIMAL(24,2)) AS total_amount, CAST(sum(net_amount) AS DECIMAL(24,2)) AS total_net_amount,
 count(*) AS transaction_count, CAST(sum(CASE WHEN status='COMPLETED' THEN amount ELSE 0 END) AS DECIMAL(24,2)) AS completed_amount,
 count(*) FILTER (status='COMPLETED') AS completed_count"""

_STATS = """CAST(coalesce(sum(amount) FILTER (status='COMPLETED'), 0) AS DECIMAL(24,2)) AS total_amount_spent,
 CAST(0 AS DECIMAL(24,2)) AS total_amount_received, count(*) FILTER (status='COMPLETED') AS success_count,
 count(*) FILTER (status IN ('FAILED','REVERSED')) AS failed_count,
 count(*) FILTER (status NOT IN ('COMPLETED','FAILED','REVERSED')) AS pending_count"""


def _summary_sql(subject: str) -> str:
    keys = f"{subject}, " if subject else ""
    return f"""SELECT {keys}destination_wallet_id AS destination_id, 'WALLET' AS destination_type,
 destination_account_name AS destination_name, {_GROUP} FROM wallet_transfers
WHERE {_W} AND destination_wallet_id IS NOT NULL
GROUP BY {keys}destination_wallet_id, destination_wallet_type, destination_account_name
UNION ALL SELECT {keys}destination_account_number, 'BANK_ACCOUNT', destination_account_name, {_GROUP} FROM wallet_transfers
WHERE {_W} AND destination_wallet_id IS NULL AND destination_account_number IS NOT NULL
GROUP BY {keys}destination_account_number, destination_account_name, destination_ifsc"""


_PERIODS = [("LAST_MONTH", 1), ("LAST_3_MONTHS", 3), ("LAST_6_MONTHS", 6), ("LAST_YEAR", 12), ("LAST_2_YEARS", 24),
            ("LAST_3_YEARS", 36), ("LAST_5_YEARS", 60), ("LAST_7_YEARS", 84)]

_FAULTY = """(SELECT * REPLACE (CAST(balance_before + s AS DECIMAL(18,2)) AS balance_before,
 CAST(balance_after + 2*s AS DECIMAL(18,2)) AS balance_after)
FROM (SELECT *, CASE WHEN CAST(substr(transaction_id,2) AS BIGINT)%101=0 THEN 1 ELSE 0 END AS s FROM ledger))"""

_STEPS = ", ".join(f"'{'>'.join(step)}'" for step in (
    ("WALLET_TO_WALLET", "INITIATED", "COMPLETED"), ("WALLET_TO_WALLET", "INITIATED", "FAILED"),
    ("WALLET_TO_ACCOUNT", "INITIATED", "DEBITED"), ("WALLET_TO_ACCOUNT", "DEBITED", "PAYOUT_INITIATED"),
    ("WALLET_TO_ACCOUNT", "PAYOUT_INITIATED", "COMPLETED"), ("WALLET_TO_ACCOUNT", "PAYOUT_INITIATED", "FAILED"),
    ("WALLET_TO_ACCOUNT", "PAYOUT_INITIATED", "REVERSED"), ("WALLET_TO_ACCOUNT", "INITIATED", "FAILED"),
    ("WALLET_TO_ACCOUNT", "DEBITED", "FAILED"),
    ("ACCOUNT_TO_WALLET", "INITIATED", "PENDING_PAYMENT"), ("ACCOUNT_TO_WALLET", "PENDING_PAYMENT", "COLLECTING"),
    ("ACCOUNT_TO_WALLET", "COLLECTING", "COMPLETED"), ("ACCOUNT_TO_WALLET", "COLLECTING", "FAILED"),
    ("ACCOUNT_TO_WALLET", "INITIATED", "FAILED"), ("ACCOUNT_TO_WALLET", "PENDING_PAYMENT", "FAILED"),
    ("ACCOUNT_TO_ACCOUNT", "INITIATED", "PENDING_PAYMENT"), ("ACCOUNT_TO_ACCOUNT", "PENDING_PAYMENT", "COLLECTING"),
    ("ACCOUNT_TO_ACCOUNT", "COLLECTING", "PAYOUT_INITIATED"), ("ACCOUNT_TO_ACCOUNT", "PAYOUT_INITIATED", "COMPLETED"),
    ("ACCOUNT_TO_ACCOUNT", "PAYOUT_INITIATED", "FAILED"), ("ACCOUNT_TO_ACCOUNT", "PAYOUT_INITIATED", "REVERSED"),
    ("ACCOUNT_TO_ACCOUNT", "INITIATED", "FAILED"), ("ACCOUNT_TO_ACCOUNT", "PENDING_PAYMENT", "FAILED"),
    ("ACCOUNT_TO_ACCOUNT", "COLLECTING", "FAILED"),
))


def _pages(owner: str, wallets: str, columns: str, size: int) -> str:
    return with_tables(f"""SELECT {columns}, position, (position - 1) // {size} AS page FROM
(SELECT w.{owner}, t.*, row_number() OVER (PARTITION BY w.{owner} ORDER BY initiated_at DESC, transfer_id DESC) AS position
 FROM wallet_transfers t JOIN {wallets} w ON t.source_wallet_id = w.wallet_id WHERE {_W})""")


ORACLE = {
    "history_items": with_tables(f"SELECT {_ITEMS} FROM wallet_transfers"),
    "status_text": with_tables("""SELECT transfer_id AS record_id, CASE status WHEN 'INITIATED' THEN 'Transfer initiated'
 WHEN 'PENDING_PAYMENT' THEN 'Awaiting payment — redirect user to paymentLink'
 WHEN 'COLLECTING' THEN 'Payment received, processing payout' WHEN 'DEBITED' THEN 'Source wallet debited, payout pending'
 WHEN 'PAYOUT_INITIATED' THEN 'Payout initiated, awaiting bank settlement'
 WHEN 'COMPLETED' THEN 'Transfer completed successfully' WHEN 'FAILED' THEN 'Transfer failed'
 WHEN 'REVERSED' THEN 'Transfer reversed — funds returned to source' END AS message FROM wallet_transfers
UNION ALL SELECT transaction_id, CASE status WHEN 'INITIATED' THEN 'Payment initiated'
 WHEN 'PENDING_PAYMENT' THEN 'Awaiting user payment' WHEN 'PROCESSING' THEN 'Payment processing'
 WHEN 'SUCCESS' THEN 'Payment successful' WHEN 'FAILED' THEN 'Payment failed' WHEN 'EXPIRED' THEN 'Payment order expired'
 WHEN 'CANCELLED' THEN 'Payment cancelled by user' WHEN 'REFUNDED' THEN 'Payment refunded' ELSE status END
FROM payment_transactions"""),
    "history_predicates": with_tables(f"""SELECT transfer_id,
 initiated_at BETWEEN TIMESTAMP '2000-08-01 12:00:00' AND TIMESTAMP '2001-08-01 12:00:00' AS in_last_year,
 initiated_at BETWEEN TIMESTAMP '1994-08-01 12:00:00' AND TIMESTAMP '1997-06-30 23:00:00' AS in_custom,
 status IN ('COMPLETED','REVERSED') AS is_settled, true AS any_status,
 coalesce(source_wallet_id='W10', false) OR coalesce(source_account_number='W10', false) AS from_w10,
 coalesce(source_wallet_id IN ('W10','W11','W12'), false) AS from_wallets,
 coalesce(destination_account_number='ACC7', false) AS to_acc7,
 coalesce(destination_wallet_id IN ('W7','W8'), false) AS to_wallets,
 coalesce(source_wallet_id='W10' AND destination_wallet_id='W30', false) AS w10_to_w30,
 coalesce(source_wallet_id='W7', false) OR coalesce(destination_wallet_id='W7', false) AS involves_w7,
 coalesce(source_wallet_id='W10' AND {_W} AND status='COMPLETED', false) AS user_w10,
 coalesce({_W} AND status='FAILED' AND destination_wallet_id='W8', false) AS org_like
FROM wallet_transfers"""),
    "period_membership": with_tables(" UNION ALL ".join(
        f"SELECT '{p}' AS period, count(*) AS transfers, CAST(coalesce(sum(amount), 0) AS DECIMAL(24,2)) AS amount "
        f"FROM wallet_transfers WHERE initiated_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {m} MONTH AND TIMESTAMP '{AS_OF}'"
        for p, m in _PERIODS)),
    "customer_transfers": with_tables("""SELECT customer_id, transfer_id, amount FROM wallet_transfers t
JOIN individual_wallets w ON t.source_wallet_id = w.wallet_id"""),
    "org_transfers": with_tables("""SELECT transfer_id, amount FROM wallet_transfers
WHERE source_wallet_id IN (SELECT wallet_id FROM enterprise_wallets)"""),
    "org_level_transfers": with_tables("""SELECT transfer_id FROM wallet_transfers
WHERE source_wallet_id IN (SELECT wallet_id FROM enterprise_wallets WHERE division_id IS NULL)"""),
    "user_history_pages": _pages("customer_id", "individual_wallets",
                                 "customer_id, transfer_id, amount, initiated_at", 20),
    "org_history_pages": _pages("org_id", "enterprise_wallets", "org_id, transfer_id, status, initiated_at", 50),
    **{f"transfers_by_{label}_pages": with_tables(f"""SELECT {column}, transfer_id, position, (position - 1) // 20 AS page
FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY initiated_at DESC, transfer_id DESC) AS position
 FROM wallet_transfers WHERE {column} IS NOT NULL)""") for label, column in (
        ("source", "source_wallet_id"), ("destination", "destination_wallet_id"), ("status", "status"))},
    "transfer_ledger": with_tables("""SELECT *, row_number() OVER (PARTITION BY transfer_id
 ORDER BY created_at, transaction_id) AS position FROM transfer_legs"""),
    "transfer_audit": with_tables("""SELECT *, row_number() OVER (PARTITION BY transfer_id
 ORDER BY created_at, audit_id) AS position FROM audit_steps"""),
    "history_page_by_amount": with_tables(
        f"SELECT {_ITEMS} FROM wallet_transfers ORDER BY amount DESC, transfer_id LIMIT 50 OFFSET 100"),
    "history_page_by_date": with_tables(
        f"SELECT {_ITEMS} FROM wallet_transfers ORDER BY initiated_at, transfer_id LIMIT 100 OFFSET 100"),
    "history_page_after": with_tables(
        f"SELECT {_ITEMS} FROM wallet_transfers WHERE {_W} ORDER BY initiated_at DESC, transfer_id LIMIT 50 OFFSET 150"),
    "wallet_audit_pages": with_tables("""SELECT *, (position - 1) // 20 AS page FROM (SELECT source_wallet_id AS wallet_id, audit_id,
 a.transfer_id, new_value, created_at, row_number() OVER (PARTITION BY source_wallet_id ORDER BY created_at DESC, audit_id DESC) AS position
FROM audit_steps a JOIN wallet_transfers t ON a.transfer_id = t.transfer_id WHERE source_wallet_id IS NOT NULL)"""),
    "failed_transfers_page": with_tables(
        f"SELECT {_ITEMS} FROM wallet_transfers WHERE status='FAILED' ORDER BY initiated_at DESC, transfer_id LIMIT 20"),
    "page_info": with_tables(f"""SELECT CAST(2 AS INTEGER) AS page, CAST(50 AS INTEGER) AS size, count(*) AS total_elements,
 CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM wallet_transfers WHERE {_W}"""),
    "group_by_dest_wallet": with_tables(f"""SELECT source_wallet_id, destination_wallet_id, destination_wallet_type,
 destination_account_name, {_GROUP} FROM wallet_transfers WHERE {_W} AND destination_wallet_id IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    "group_by_dest_account": with_tables(f"""SELECT source_account_number, destination_account_number,
 destination_account_name, destination_ifsc, {_GROUP} FROM wallet_transfers
WHERE {_W} AND destination_wallet_id IS NULL AND destination_account_number IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    "group_by_dest_org": with_tables(f"""SELECT org_id, destination_wallet_id, destination_wallet_type,
 destination_account_number, destination_account_name, {_GROUP} FROM (SELECT t.*, w.org_id FROM wallet_transfers t
 JOIN enterprise_wallets w ON t.source_wallet_id = w.wallet_id) WHERE {_W} GROUP BY 1, 2, 3, 4, 5"""),
    "dest_summary": with_tables(_summary_sql("source_wallet_id")),
    "org_dest_summary": with_tables(f"""SELECT org_id, coalesce(destination_wallet_id, destination_account_number) AS destination_id,
 CASE WHEN destination_wallet_id IS NOT NULL THEN 'WALLET' ELSE 'BANK_ACCOUNT' END AS destination_type,
 destination_account_name AS destination_name, {_GROUP} FROM (SELECT t.*, w.org_id FROM wallet_transfers t
 JOIN enterprise_wallets w ON t.source_wallet_id = w.wallet_id) WHERE {_W}
GROUP BY org_id, destination_wallet_id, destination_wallet_type, destination_account_number, destination_account_name"""),
    "largest_destinations": with_tables(_summary_sql("")),
    "history_stats": with_tables(f"SELECT {_STATS} FROM wallet_transfers WHERE {_W}"),
    "customer_history_stats": with_tables(f"""SELECT customer_id, {_STATS} FROM (SELECT t.*, customer_id FROM wallet_transfers t
 JOIN individual_wallets w ON t.source_wallet_id = w.wallet_id) WHERE {_W} GROUP BY 1"""),
    "ledger_balance": with_tables("SELECT * FROM ledger"),
    "wallet_balances": with_tables("""SELECT wallet_id,
 CAST(sum(CASE WHEN transaction_type='DEBIT' THEN -amount ELSE amount END) AS DECIMAL(24,2)) AS balance,
 count(*) AS entries, max(created_at) AS last_entry_at FROM ledger_moves GROUP BY 1"""),
    "wallet_statement": with_tables("""SELECT wallet_id, wallet_type, transaction_id, transfer_id, transaction_type, amount,
 balance_before, balance_after, currency, description, created_at, position, (position - 1) // 20 AS page
FROM (SELECT *, row_number() OVER (PARTITION BY wallet_id, wallet_type ORDER BY created_at DESC, transaction_id DESC) AS position
 FROM ledger)"""),
    "ledger_continuity": with_tables(f"""SELECT * FROM (SELECT wallet_id, transaction_id, created_at, balance_before, balance_after,
 previous_balance,
 balance_after <> balance_before + CASE WHEN transaction_type='DEBIT' THEN -amount ELSE amount END AS wrong_arithmetic,
 previous_balance IS NOT NULL AND balance_before <> previous_balance AS gap, balance_after < 0 AS negative
FROM (SELECT *, lag(balance_after) OVER (PARTITION BY wallet_id ORDER BY created_at, transaction_id) AS previous_balance
 FROM {_FAULTY})) WHERE wrong_arithmetic OR gap OR negative"""),
    "double_entry_check": with_tables("""SELECT transfer_id, problem FROM (SELECT t.transfer_id, CASE
 WHEN d.transfer_id IS NULL THEN 'debit missing' WHEN c.transfer_id IS NULL THEN 'credit missing'
 WHEN d.amount <> t.amount OR d.wallet_id <> t.source_wallet_id THEN 'debit wrong'
 WHEN c.amount <> t.net_amount OR c.wallet_id <> t.destination_wallet_id THEN 'credit wrong' END AS problem
FROM wallet_transfers t LEFT JOIN transfer_legs d ON t.transfer_id=d.transfer_id AND d.transaction_type='DEBIT'
 LEFT JOIN transfer_legs c ON t.transfer_id=c.transfer_id AND c.transaction_type='CREDIT'
WHERE t.status='COMPLETED' AND t.transfer_type='WALLET_TO_WALLET') WHERE problem IS NOT NULL"""),
    "status_path_check": with_tables(f"""SELECT * FROM (SELECT audit_id, transfer_id, transfer_type, previous_value, new_value,
 state_before, transfer_type||'>'||previous_value||'>'||new_value NOT IN ({_STEPS}) AS illegal,
 state_before IS NOT NULL AND state_before <> previous_value AS broken
FROM (SELECT a.*, t.transfer_type,
  lag(new_value) OVER (PARTITION BY a.transfer_id ORDER BY a.created_at, a.audit_id) AS state_before
 FROM audit_steps a JOIN wallet_transfers t ON a.transfer_id=t.transfer_id)) WHERE illegal OR broken"""),
    "purge_kept_transfers": with_tables(f"SELECT transfer_id FROM wallet_transfers WHERE initiated_at >= {_CUT}"),
    "purge_kept_ledger": with_tables(f"""SELECT transaction_id FROM transfer_legs l WHERE NOT EXISTS
(SELECT 1 FROM wallet_transfers t WHERE t.transfer_id=l.transfer_id AND t.initiated_at < {_CUT})"""),
    "purge_expired": with_tables(f"""WITH gone AS (SELECT transfer_id FROM wallet_transfers WHERE initiated_at < {_CUT})
SELECT 'wallet_audit_logs' AS table_name, count(*) AS expired_rows FROM audit_steps WHERE transfer_id IN (SELECT transfer_id FROM gone)
UNION ALL SELECT 'wallet_transactions', count(*) FROM transfer_legs WHERE transfer_id IN (SELECT transfer_id FROM gone)
UNION ALL SELECT 'wallet_transfers', count(*) FROM gone
UNION ALL SELECT 'payment_transactions', count(*) FROM payment_transactions WHERE initiated_at < {_CUT}"""),
    "purge_on_disk": with_tables(f"""WITH gone AS (SELECT transfer_id FROM wallet_transfers WHERE initiated_at < {_CUT})
SELECT 'wallet_transfers' AS table_name, transfer_id AS id, initiated_at AS at FROM wallet_transfers WHERE initiated_at >= {_CUT}
UNION ALL SELECT 'wallet_transactions', transaction_id, created_at FROM transfer_legs
 WHERE transfer_id IS NULL OR transfer_id NOT IN (SELECT transfer_id FROM gone)
UNION ALL SELECT 'wallet_audit_logs', audit_id, created_at FROM audit_steps
 WHERE transfer_id IS NULL OR transfer_id NOT IN (SELECT transfer_id FROM gone)"""),
    "purge_dry_run": with_tables(f"""SELECT 'wallet_transfers' AS table_name, count(*) AS eligible_rows FROM wallet_transfers
WHERE initiated_at < {_CUT} UNION ALL SELECT 'payment_transactions', count(*) FROM payment_transactions WHERE initiated_at < {_CUT}"""),
    "oldest_expired": with_tables(f"""SELECT transfer_id, initiated_at FROM wallet_transfers WHERE initiated_at < {_CUT}
ORDER BY initiated_at, transfer_id LIMIT 500"""),
}
