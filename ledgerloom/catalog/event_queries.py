"""Events, routing and webhooks over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog.oracle_tables import with_tables
from ledgerloom.operators import enrichment as en
from ledgerloom.operators import webhooks as wh
from ledgerloom.sources import messages
from ledgerloom.sources import sample_tables as st


def _wallets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return st.individual_wallets(s, d), st.enterprise_wallets(s, d)


def _pg(s, d) -> DataFrame:
    return messages.pg_webhooks(st.pg_webhook_archive(s, d))


def _payout(s, d) -> DataFrame:
    return messages.payout_webhooks(st.payout_webhook_archive(s, d))


def _standalone(s, d) -> DataFrame:
    unmatched = wh.match_pg_webhooks(_pg(s, d), st.wallet_transfers(s, d)).filter(F.col("transfer_id").isNull())
    return wh.match_standalone_webhooks(unmatched.drop("transfer_id"), st.payment_transactions(s, d))


def _routed_facts(s, d, subject: str) -> DataFrame:
    routed = en.route(st.success_events(s, d)).filter(F.col("route") == subject).drop("route")
    return en.event_to_fact(en.first_per_transfer(routed), subject)


QUERIES = {
    "parsed_events": lambda s, d: messages.parse_events(messages.event_messages(st.success_events(s, d))),
    "wallet_success_events": lambda s, d: en.wallet_success_events(st.wallet_transfers(s, d), *_wallets(s, d)),
    "standalone_success_events": lambda s, d: en.standalone_success_events(st.payment_transactions(s, d)),
    "all_success_events": lambda s, d: en.all_success_events(
        st.wallet_transfers(s, d), *_wallets(s, d), st.payment_transactions(s, d)),
    "enrich_sources": lambda s, d: en.enrich_sources(st.wallet_transfers(s, d), *_wallets(s, d)).select(
        "transfer_id", "source_type", "customer_id", "org_id", "division_id", "org_wallet_id"),
    "routing_keys": lambda s, d: en.with_routing_key(st.success_events(s, d)).select(
        "event_id", "routing_key"),
    "route_events": lambda s, d: en.route(st.success_events(s, d)).select("event_id", "source_type", "route"),
    "dedupe_events": lambda s, d: en.first_per_transfer(st.success_events(s, d)),
    "customer_event_facts": lambda s, d: _routed_facts(s, d, "customer"),
    "org_event_facts": lambda s, d: _routed_facts(s, d, "org"),
    "dead_letters": lambda s, d: en.route(st.success_events(s, d)).filter(F.col("route") == "dead_letter"),
    "pg_webhooks": _pg,
    "pg_webhook_rejects": lambda s, d: messages.rejected_webhooks(st.pg_webhook_archive(s, d)).select("webhook_id"),
    "payout_webhooks": _payout,
    "match_pg_webhooks": lambda s, d: wh.match_pg_webhooks(_pg(s, d), st.wallet_transfers(s, d)).select(
        "webhook_id", "event_type", "order_id", "transfer_id"),
    "match_standalone_webhooks": lambda s, d: _standalone(s, d).select("webhook_id", "order_id", "transaction_id"),
    "match_payout_webhooks": lambda s, d: wh.match_payout_webhooks(_payout(s, d), st.wallet_transfers(s, d)).select(
        "webhook_id", "transfer_ref", "transfer_id"),
    "apply_webhooks": lambda s, d: wh.apply_to_transfers(
        st.wallet_transfers(s, d), wh.match_pg_webhooks(_pg(s, d), st.wallet_transfers(s, d)),
        wh.match_payout_webhooks(_payout(s, d), st.wallet_transfers(s, d))),
    "apply_standalone_webhooks": lambda s, d: wh.apply_to_payments(st.payment_transactions(s, d), _standalone(s, d)),
    "idempotent_requests": lambda s, d: wh.idempotent_requests(st.payment_transactions(s, d)),
}

_WALLET_EVENTS = """SELECT sha256(transfer_id) AS event_id,
 CASE WHEN source_wallet_id IS NULL OR source_wallet_type='INDIVIDUAL' THEN 'INDIVIDUAL'
  WHEN source_wallet_type='ENTERPRISE' THEN 'ENTERPRISE' END AS source_type,
 CASE WHEN source_wallet_id IS NULL THEN source_account_number
  WHEN source_wallet_type='INDIVIDUAL' THEN coalesce(i.customer_id, source_wallet_id) END AS customer_id,
 CASE WHEN source_wallet_type='INDIVIDUAL' THEN source_wallet_id END AS source_wallet_id,
 CASE WHEN source_wallet_type='ENTERPRISE' THEN coalesce(e.org_id, source_wallet_id) END AS org_id,
 CASE WHEN source_wallet_type='ENTERPRISE' THEN e.division_id END AS division_id,
 CASE WHEN source_wallet_type='ENTERPRISE' THEN source_wallet_id END AS org_wallet_id,
 t.transfer_id, pg_order_id, cf_payment_id, bank_reference, transfer_type, 'COMPLETED' AS status, amount, fees,
 net_amount, t.currency,
 CASE WHEN destination_wallet_id IS NOT NULL THEN destination_wallet_id ELSE destination_account_number END AS counterparty_id,
 destination_account_name AS counterparty_name,
 CASE WHEN destination_wallet_id IS NOT NULL THEN 'WALLET' ELSE 'BANK_ACCOUNT' END AS counterparty_type,
 description, updated_at AS succeeded_at
FROM wallet_transfers t LEFT JOIN individual_wallets i ON t.source_wallet_id=i.wallet_id AND t.source_wallet_type='INDIVIDUAL'
 LEFT JOIN enterprise_wallets e ON t.source_wallet_id=e.wallet_id AND t.source_wallet_type='ENTERPRISE'"""

_STANDALONE_EVENTS = """SELECT sha256(transaction_id) AS event_id, 'STANDALONE_PG' AS source_type,
 debitor_id AS customer_id, transaction_id AS transfer_id, order_id AS pg_order_id, cf_payment_id, bank_reference,
 'COMPLETED' AS status, CAST(amount AS DECIMAL(18,2)) AS amount, CAST(0 AS DECIMAL(18,2)) AS fees,
 CAST(amount AS DECIMAL(18,2)) AS net_amount, currency, creditor_account AS counterparty_id,
 creditor_name AS counterparty_name, 'BANK_ACCOUNT' AS counterparty_type, updated_at AS succeeded_at
FROM payment_transactions WHERE status='SUCCESS'"""

_ROUTE = """CASE WHEN source_type IN ('INDIVIDUAL','STANDALONE_PG') THEN 'customer'
 WHEN source_type='ENTERPRISE' THEN 'org' ELSE 'dead_letter' END"""


def _first(where: str) -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY transfer_id
 ORDER BY succeeded_at, event_id) AS rn FROM success_events WHERE {where}) WHERE rn=1)"""


def _facts(owner: str, where: str) -> str:
    return with_tables(f"""SELECT sha256(event_id) AS txn_id, {owner}, transfer_id, pg_order_id, cf_payment_id,
 bank_reference, transfer_type, amount, coalesce(fees, CAST(0 AS DECIMAL(18,2))) AS fees,
 coalesce(net_amount, CAST(amount - coalesce(fees, CAST(0 AS DECIMAL(18,2))) AS DECIMAL(18,2))) AS net_amount,
 coalesce(currency, 'INR') AS currency, counterparty_id, counterparty_name, counterparty_type, status,
 succeeded_at AS txn_date, CAST(year(succeeded_at)*100+month(succeeded_at) AS INTEGER) AS txn_year_month, description
FROM {_first(where)}""")


_PG_MATCH = """(SELECT w.*, coalesce(k.transfer_id, t.transfer_id) AS transfer_id FROM pg_webhooks w
 LEFT JOIN wallet_transfers k ON w.order_id=k.idempotency_key LEFT JOIN wallet_transfers t ON w.order_id=t.transfer_id)"""
_PO_MATCH = """(SELECT w.*, coalesce(a.transfer_id, b.transfer_id) AS transfer_id FROM payout_webhooks w
 LEFT JOIN wallet_transfers a ON a.transfer_id = CASE WHEN starts_with(w.transfer_ref, 'PAYOUT-')
  THEN substr(w.transfer_ref, 8) ELSE w.transfer_ref END
 LEFT JOIN wallet_transfers b ON b.cf_payout_id = w.cf_payout_id)"""
_ST_MATCH = f"""(SELECT w.* EXCLUDE (transfer_id), coalesce(a.transaction_id, b.transaction_id) AS transaction_id
 FROM (SELECT * FROM {_PG_MATCH} WHERE transfer_id IS NULL) w
 LEFT JOIN payment_transactions a ON a.order_id=w.order_id LEFT JOIN payment_transactions b ON b.cf_order_id=w.order_id)"""


_DETAIL = """CASE WHEN coalesce(error_description, error_code) IS NOT NULL
 THEN coalesce(error_description, '')||' ['||coalesce(error_code, '')||']' ELSE payment_message END"""


def _applied(records: str, key: str, events: str, outcome: str, terminal: str, reason: str) -> str:
    return f"""
WITH ev AS (SELECT e.*, {outcome} AS outcome FROM ({events}) e JOIN {records} r ON e.{key}=r.{key}),
 finals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_time NULLS LAST, webhook_id) AS rn
  FROM ev WHERE outcome IN ({terminal})) WHERE rn=1),
 opens AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_time DESC NULLS LAST, webhook_id DESC) AS rn
  FROM ev WHERE outcome NOT IN ({terminal})) WHERE rn=1),
 seen AS (SELECT {key}, count(*) AS webhooks FROM ev GROUP BY 1)
SELECT r.*, CASE WHEN r.status IN ({terminal}) THEN r.status ELSE coalesce(f.outcome, o.outcome, r.status) END AS new_status,
 CASE WHEN r.status NOT IN ({terminal}) THEN coalesce(f.webhook_id, o.webhook_id) END AS decided_by,
 CASE WHEN r.status NOT IN ({terminal}) THEN CASE WHEN f.outcome IS NOT NULL THEN f.event_time ELSE o.event_time END END AS decided_at,
 CASE WHEN r.status NOT IN ({terminal}) THEN {reason} END AS webhook_failure_reason,
 CASE WHEN r.status NOT IN ({terminal}) AND f.outcome IN ('COMPLETED', 'SUCCESS') THEN f.bank_reference END AS webhook_bank_reference,
 CASE WHEN r.status IN ({terminal}) THEN NULL WHEN f.outcome IS NOT NULL THEN f.cf_payment_id ELSE o.cf_payment_id END AS webhook_payment_id,
 coalesce(s.webhooks, 0) AS webhooks
FROM {records} r LEFT JOIN finals f ON r.{key}=f.{key} LEFT JOIN opens o ON r.{key}=o.{key}
 LEFT JOIN seen s ON r.{key}=s.{key}"""


ORACLE = {
    "parsed_events": with_tables("SELECT * FROM success_events"),
    "wallet_success_events": with_tables(_WALLET_EVENTS + " WHERE t.status='COMPLETED'"),
    "standalone_success_events": with_tables(_STANDALONE_EVENTS),
    "all_success_events": with_tables(
        f"SELECT * FROM ({_WALLET_EVENTS} WHERE t.status='COMPLETED') UNION ALL BY NAME SELECT * FROM ({_STANDALONE_EVENTS})"),
    "enrich_sources": with_tables(
        f"SELECT transfer_id, source_type, customer_id, org_id, division_id, org_wallet_id FROM ({_WALLET_EVENTS})"),
    "routing_keys": with_tables(
        "SELECT event_id, coalesce(customer_id, org_id, transfer_id) AS routing_key FROM success_events"),
    "route_events": with_tables(f"SELECT event_id, source_type, {_ROUTE} AS route FROM success_events"),
    "dedupe_events": with_tables(f"SELECT * FROM {_first('true')}"),
    "customer_event_facts": _facts("customer_id, source_wallet_id", f"{_ROUTE} = 'customer'"),
    "org_event_facts": _facts("org_id, division_id, org_wallet_id AS source_wallet_id", f"{_ROUTE} = 'org'"),
    "dead_letters": with_tables(f"SELECT *, 'dead_letter' AS route FROM success_events WHERE {_ROUTE} = 'dead_letter'"),
    "pg_webhooks": with_tables("SELECT * FROM pg_webhooks"),
    "pg_webhook_rejects": with_tables("SELECT webhook_id FROM pg_webhooks_all WHERE broken"),
    "payout_webhooks": with_tables("SELECT * FROM payout_webhooks"),
    "match_pg_webhooks": with_tables(f"SELECT webhook_id, event_type, order_id, transfer_id FROM {_PG_MATCH}"),
    "match_standalone_webhooks": with_tables(f"SELECT webhook_id, order_id, transaction_id FROM {_ST_MATCH}"),
    "match_payout_webhooks": with_tables(f"SELECT webhook_id, transfer_ref, transfer_id FROM {_PO_MATCH}"),
    "apply_webhooks": with_tables(_applied(
        "(SELECT transfer_id, transfer_type, status FROM wallet_transfers)", "transfer_id",
        f"""SELECT transfer_id, event_type, event_time, 'pg-'||webhook_id AS webhook_id, {_DETAIL} AS detail,
 bank_reference, cf_payment_id FROM {_PG_MATCH}
 UNION ALL SELECT transfer_id, event_type, event_time, 'po-'||webhook_id, failure_reason, bank_reference, NULL FROM {_PO_MATCH}""",
        """CASE WHEN event_type='PAYMENT_SUCCESS_WEBHOOK' THEN CASE transfer_type WHEN 'ACCOUNT_TO_WALLET' THEN 'COMPLETED'
  WHEN 'ACCOUNT_TO_ACCOUNT' THEN 'PAYOUT_INITIATED' END
 WHEN event_type IN ('PAYMENT_FAILED_WEBHOOK','PAYMENT_USER_DROPPED_WEBHOOK') THEN 'FAILED'
 WHEN event_type='TRANSFER_SUCCESS' THEN 'COMPLETED'
 WHEN event_type='TRANSFER_FAILED' THEN CASE WHEN transfer_type='WALLET_TO_ACCOUNT' THEN 'REVERSED' ELSE 'FAILED' END
 WHEN event_type='TRANSFER_REVERSED' THEN 'REVERSED' END""",
        "'COMPLETED','FAILED','REVERSED'",
        """CASE f.event_type WHEN 'PAYMENT_FAILED_WEBHOOK' THEN f.detail WHEN 'PAYMENT_USER_DROPPED_WEBHOOK' THEN f.detail
 WHEN 'TRANSFER_FAILED' THEN 'Payout failed: '||f.detail WHEN 'TRANSFER_REVERSED' THEN 'Payout reversed by bank' END""")),
    "apply_standalone_webhooks": with_tables(_applied(
        "(SELECT transaction_id, status FROM payment_transactions)", "transaction_id",
        f"SELECT transaction_id, event_type, event_time, webhook_id, {_DETAIL} AS detail, bank_reference, cf_payment_id FROM {_ST_MATCH}",
        """CASE event_type WHEN 'PAYMENT_SUCCESS_WEBHOOK' THEN 'SUCCESS' WHEN 'PAYMENT_FAILED_WEBHOOK' THEN 'FAILED'
 WHEN 'PAYMENT_USER_DROPPED_WEBHOOK' THEN 'CANCELLED' ELSE 'PROCESSING' END""",
        "'SUCCESS','FAILED','EXPIRED','CANCELLED','REFUNDED'",
        """CASE f.event_type WHEN 'PAYMENT_FAILED_WEBHOOK' THEN f.detail
 WHEN 'PAYMENT_USER_DROPPED_WEBHOOK' THEN 'User dropped payment on checkout page' END""")),
    "idempotent_requests": with_tables("""SELECT request_key, transaction_id, order_id, status, amount, initiated_at, requests
FROM (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY initiated_at, transaction_id) AS rn,
  count(*) OVER (PARTITION BY request_key) AS requests
 FROM (SELECT *, coalesce(idempotency_key, order_id) AS request_key FROM payment_transactions)) WHERE rn=1"""),
}
