"""The derived payment tables in DuckDB SQL, for checking the Spark queries."""

from __future__ import annotations

import re

_TRANSFER_TYPE_FACT = """CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'WALLET_TO_WALLET' WHEN '2' THEN 'WALLET_TO_ACCOUNT'
 WHEN '3' THEN 'ACCOUNT_TO_WALLET' WHEN '5' THEN 'ACCOUNT_TO_ACCOUNT' END"""

_EVENT_TYPE_TRANSFER = """CASE event_type WHEN 'click' THEN 'WALLET_TO_WALLET' WHEN 'view' THEN 'WALLET_TO_ACCOUNT'
 WHEN 'purchase' THEN 'ACCOUNT_TO_ACCOUNT' END"""

TABLES = {
    "customer_facts": f"""
SELECT 'O'||o_orderkey AS txn_id, 'C'||o_custkey AS customer_id, 'W'||o_custkey AS source_wallet_id,
 CASE WHEN o_orderkey%50<>7 THEN 'T'||(o_orderkey - CASE WHEN o_orderkey%100=1 THEN 1 ELSE 0 END) END AS transfer_id,
 'PG'||o_orderkey AS pg_order_id, 'CF'||o_orderkey AS cf_payment_id, 'B'||o_orderkey AS bank_reference,
 {_TRANSFER_TYPE_FACT} AS transfer_type, amount, fees, CAST(amount - fees AS DECIMAL(18,2)) AS net_amount,
 'INR' AS currency,
 CASE WHEN o_orderkey%20<>0 THEN 'CP'||(o_orderkey%20) END AS counterparty_id,
 CASE WHEN o_orderkey%20 NOT IN (0,3) THEN 'Party '||(o_orderkey%20) END AS counterparty_name,
 CASE WHEN o_orderkey%2=0 THEN 'WALLET' ELSE 'BANK_ACCOUNT' END AS counterparty_type,
 CASE WHEN o_orderstatus='F' AND o_orderkey%10=0 THEN 'REVERSED' WHEN o_orderstatus='F' THEN 'COMPLETED'
  WHEN o_orderstatus='O' THEN 'PENDING_PAYMENT' ELSE 'FAILED' END AS status,
 txn_date, CAST(year(txn_date)*100+month(txn_date) AS INTEGER) AS txn_year_month, CAST(NULL AS VARCHAR) AS description
FROM (SELECT *, CAST(amount*CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS fees,
        o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS txn_date
      FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders))""",
    "org_facts": """
SELECT 'L'||l_orderkey||'-'||l_linenumber AS txn_id, 'ORG'||s_nationkey AS org_id,
 CASE WHEN l_suppkey%7<>0 THEN 'DIV'||l_suppkey END AS division_id, 'W'||l_suppkey AS source_wallet_id,
 l_orderkey||'-'||l_linenumber AS transfer_id, 'PG'||l_orderkey AS pg_order_id,
 CAST(NULL AS VARCHAR) AS cf_payment_id, CAST(NULL AS VARCHAR) AS bank_reference,
 CASE l_returnflag WHEN 'R' THEN 'WALLET_TO_WALLET' WHEN 'A' THEN 'WALLET_TO_ACCOUNT' ELSE 'ACCOUNT_TO_ACCOUNT' END
  AS transfer_type, amount, fees, CAST(amount - fees AS DECIMAL(18,2)) AS net_amount, 'INR' AS currency,
 'CP'||(l_partkey%50) AS counterparty_id,
 CASE WHEN l_partkey%50<>3 THEN 'Party '||(l_partkey%50) END AS counterparty_name,
 CASE WHEN (l_partkey%50)%2=0 THEN 'WALLET' ELSE 'BANK_ACCOUNT' END AS counterparty_type,
 CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 'REVERSED' WHEN l_returnflag='A' AND l_linestatus='O' THEN 'FAILED'
  WHEN l_linestatus='F' THEN 'COMPLETED' ELSE 'PENDING_PAYMENT' END AS status,
 l_shipdate AS txn_date, CAST(year(l_shipdate)*100+month(l_shipdate) AS INTEGER) AS txn_year_month,
 CAST(NULL AS VARCHAR) AS description
FROM (SELECT *, CAST(amount*CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS fees
      FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
            FROM lineitem JOIN supplier ON l_suppkey=s_suppkey))""",
    "success_events": f"""
SELECT 'E'||event_id AS event_id,
 CASE WHEN event_type='error' AND event_id%11=0 THEN NULL WHEN event_type IN ('click','view') THEN 'INDIVIDUAL'
  WHEN event_type='signup' THEN 'STANDALONE_PG' WHEN event_type='purchase' THEN 'ENTERPRISE' ELSE 'UNKNOWN' END AS source_type,
 CASE WHEN event_type<>'purchase' THEN 'U'||user_id END AS customer_id,
 CASE WHEN event_type IN ('click','view') THEN 'W'||user_id END AS source_wallet_id,
 CASE WHEN event_type='purchase' THEN 'ORG'||(user_id%10) END AS org_id,
 CASE WHEN event_type='purchase' AND user_id%3<>0 THEN 'DIV'||user_id END AS division_id,
 CASE WHEN event_type='purchase' THEN 'OW'||user_id END AS org_wallet_id,
 'T'||(event_id - CASE WHEN event_id%40=1 THEN 1 ELSE 0 END) AS transfer_id, 'PG'||event_id AS pg_order_id,
 CAST(NULL AS VARCHAR) AS cf_payment_id, CAST(NULL AS VARCHAR) AS bank_reference,
 {_EVENT_TYPE_TRANSFER} AS transfer_type,
 CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'REVERSED'
  WHEN 'view' THEN 'PENDING_PAYMENT' ELSE 'INITIATED' END AS status,
 amount, fees,
 CASE WHEN event_id%3=0 THEN CAST(amount - coalesce(fees, CAST(0 AS DECIMAL(18,2))) AS DECIMAL(18,2)) END AS net_amount,
 CASE WHEN event_id%4<>0 THEN 'INR' END AS currency, 'CP'||(event_id%20) AS counterparty_id,
 CAST(NULL AS VARCHAR) AS counterparty_name,
 CASE WHEN event_id%2=0 THEN 'WALLET' ELSE 'BANK_ACCOUNT' END AS counterparty_type,
 'props '||props AS description, ts AS succeeded_at
FROM (SELECT *, CASE WHEN event_id%5<>0 THEN CAST(amount*CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS fees
      FROM (SELECT *, CAST(value AS DECIMAL(18,2)) AS amount FROM events))""",
    "activity_facts": f"""
SELECT 'E'||event_id AS txn_id, 'U'||user_id AS customer_id, 'ORG'||(user_id%10) AS org_id,
 CASE WHEN user_id%3<>0 THEN 'DIV'||user_id END AS division_id, 'T'||event_id AS transfer_id,
 {_EVENT_TYPE_TRANSFER} AS transfer_type, amount, fees, CAST(amount - fees AS DECIMAL(18,2)) AS net_amount,
 CASE WHEN event_id%20<>0 THEN 'CP'||(event_id%20) END AS counterparty_id,
 CASE WHEN event_id%20>3 THEN 'Party '||(event_id%20) END AS counterparty_name,
 CASE WHEN event_id%2=0 THEN 'WALLET' ELSE 'BANK_ACCOUNT' END AS counterparty_type,
 CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'REVERSED'
  WHEN 'view' THEN 'PENDING_PAYMENT' END AS status,
 ts AS txn_date, CAST(year(ts)*100+month(ts) AS INTEGER) AS txn_year_month
FROM (SELECT *, CAST(amount*CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS fees
      FROM (SELECT *, CAST(value AS DECIMAL(18,2)) AS amount FROM events))""",
    "individual_wallets": """
SELECT 'W'||c_custkey AS wallet_id, 'INDIVIDUAL' AS wallet_type, 'C'||c_custkey AS customer_id,
 c_name AS customer_name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, 'INR' AS currency, 'ACTIVE' AS status
FROM customer WHERE c_custkey%3<>0""",
    "enterprise_wallets": """
SELECT 'W'||c_custkey AS wallet_id, 'ENTERPRISE' AS wallet_type, 'ORG'||c_nationkey AS org_id,
 CASE WHEN c_custkey%9<>0 THEN 'DIV'||c_custkey END AS division_id, c_name AS wallet_name,
 CAST(c_acctbal AS DECIMAL(18,2)) AS balance, 'INR' AS currency, 'ACTIVE' AS status
FROM customer WHERE c_custkey%3=0""",
    "wallet_transfers": """
SELECT 'T'||k AS transfer_id, 'K'||k AS idempotency_key,
 CASE p WHEN '2' THEN 'WALLET_TO_ACCOUNT' WHEN '3' THEN 'ACCOUNT_TO_WALLET' WHEN '5' THEN 'ACCOUNT_TO_ACCOUNT'
  ELSE 'WALLET_TO_WALLET' END AS transfer_type,
 CASE WHEN fw THEN CASE WHEN k%37=0 THEN 'WX'||c ELSE 'W'||c END END AS source_wallet_id,
 CASE WHEN fw AND k%41<>0 THEN CASE WHEN c%3=0 THEN 'ENTERPRISE' ELSE 'INDIVIDUAL' END END AS source_wallet_type,
 CASE WHEN NOT fw THEN 'ACC'||c END AS source_account_number,
 CASE WHEN NOT fw THEN 'Holder '||c END AS source_account_name,
 CASE WHEN tw THEN 'W'||d END AS destination_wallet_id,
 CASE WHEN tw THEN CASE WHEN d%3=0 THEN 'ENTERPRISE' ELSE 'INDIVIDUAL' END END AS destination_wallet_type,
 CASE WHEN NOT tw THEN 'ACC'||d END AS destination_account_number,
 CASE WHEN NOT tw THEN 'IFSC'||(d%7) END AS destination_ifsc,
 CASE WHEN d%11<>0 THEN 'Payee '||d END AS destination_account_name,
 amount, 'INR' AS currency, fees, CAST(amount - fees AS DECIMAL(18,2)) AS net_amount,
 CASE WHEN s='F' AND k%10=0 THEN 'REVERSED' WHEN s='F' THEN 'COMPLETED' WHEN s='P' THEN 'FAILED'
  WHEN k%4=0 THEN 'PENDING_PAYMENT' WHEN k%4=1 THEN 'COLLECTING' WHEN k%4=2 THEN 'DEBITED'
  ELSE 'PAYOUT_INITIATED' END AS status,
 CASE WHEN s='P' THEN 'declined' END AS failure_reason,
 CASE WHEN NOT fw THEN 'PG'||k END AS pg_order_id, CASE WHEN NOT fw THEN 'CF'||k END AS cf_payment_id,
 CASE WHEN NOT tw THEN 'PO'||k END AS cf_payout_id, CASE WHEN s='F' THEN 'B'||k END AS bank_reference,
 CAST(NULL AS VARCHAR) AS description, t AS initiated_at, t + INTERVAL '2' HOUR AS updated_at
FROM (SELECT *, CAST(amount*CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS fees FROM (
 SELECT o_orderkey AS k, o_custkey AS c, o_orderkey%200 AS d, o_orderstatus AS s, substr(o_orderpriority,1,1) AS p,
  substr(o_orderpriority,1,1) IN ('1','2','4') AS fw, substr(o_orderpriority,1,1) IN ('1','3','4') AS tw,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS t
 FROM orders))""",
    "payment_transactions": """
SELECT 'PT'||k AS transaction_id, 'ORD'||k AS order_id, CASE WHEN k%7<>0 THEN 'IK'||(k-k%5) END AS idempotency_key,
 'CFO'||k AS cf_order_id, CASE WHEN s='F' THEN 'CF'||k END AS cf_payment_id,
 CASE WHEN s='F' THEN 'B'||k END AS bank_reference, 'C'||c AS debitor_id, 'CR'||(k%30) AS creditor_id,
 'Creditor '||(k%30) AS creditor_name, 'ACC'||(k%30) AS creditor_account, CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
 'INR' AS currency, CASE k%3 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD' ELSE 'ACCOUNT_TRANSFER' END AS payment_method,
 CASE WHEN s='F' THEN 'SUCCESS' WHEN s='P' AND k%4=0 THEN 'EXPIRED' WHEN s='P' AND k%4=1 THEN 'ERROR'
  WHEN s='P' THEN 'FAILED' WHEN k%2=0 THEN 'PENDING_PAYMENT' ELSE 'PROCESSING' END AS status,
 CASE WHEN s='P' THEN CASE WHEN k%2=0 THEN 'declined' ELSE 'timeout' END END AS failure_reason,
 t AS initiated_at, t + (k%90) * INTERVAL '1' MINUTE AS updated_at
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice,
       o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS t FROM orders)""",
    "ledger_moves": """
SELECT 'L'||event_id AS transaction_id, 'T'||event_id AS transfer_id, 'U'||user_id AS wallet_id,
 CASE WHEN user_id%3=0 THEN 'ENTERPRISE' ELSE 'INDIVIDUAL' END AS wallet_type,
 CASE WHEN event_type IN ('purchase','error') THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type,
 CAST(value AS DECIMAL(18,2)) AS amount, 'INR' AS currency, event_type AS description, ts AS created_at
FROM events""",
    "ledger": """
SELECT transaction_id, transfer_id, wallet_id, wallet_type, transaction_type, amount,
 CAST(bal - signed AS DECIMAL(18,2)) AS balance_before, CAST(bal AS DECIMAL(18,2)) AS balance_after,
 currency, description, created_at
FROM (SELECT *, sum(signed) OVER (PARTITION BY wallet_id ORDER BY created_at, transaction_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal
      FROM (SELECT *, CASE WHEN transaction_type='DEBIT' THEN -amount ELSE amount END AS signed FROM ledger_moves))""",
    "transfer_legs": """
SELECT transfer_id||'-'||transaction_type AS transaction_id, transfer_id, wallet_id, transaction_type, amount, created_at
FROM (
 SELECT transfer_id, source_wallet_id AS wallet_id, 'DEBIT' AS transaction_type,
  CAST(CASE WHEN CAST(substr(transfer_id,2) AS BIGINT)%59=0 THEN amount+1 ELSE amount END AS DECIMAL(18,2)) AS amount,
  initiated_at AS created_at FROM wallet_transfers WHERE status='COMPLETED'
 UNION ALL
 SELECT transfer_id, destination_wallet_id, 'CREDIT', net_amount, initiated_at FROM wallet_transfers
 WHERE status='COMPLETED' AND CAST(substr(transfer_id,2) AS BIGINT)%53<>0)
WHERE wallet_id IS NOT NULL""",
    "audit_steps": """
SELECT transfer_id||'-'||n AS audit_id, 'TRANSFER_STATUS' AS event_type, transfer_id,
 CASE WHEN n=1 THEN 'INITIATED' WHEN k%61=0 THEN 'COLLECTING' ELSE middle END AS previous_value,
 CASE WHEN n=1 THEN middle ELSE status END AS new_value, initiated_at + n * INTERVAL '1' MINUTE AS created_at
FROM (SELECT transfer_id, status, initiated_at, CAST(substr(transfer_id,2) AS BIGINT) AS k,
  CASE WHEN transfer_type='WALLET_TO_ACCOUNT' THEN 'DEBITED' ELSE 'PENDING_PAYMENT' END AS middle FROM wallet_transfers),
 (SELECT unnest([1,2]) AS n)""",
    "pg_webhooks_all": """
SELECT k||'-'||n AS webhook_id,
 CASE WHEN n=1 AND k%5=0 THEN 'PAYMENT_FAILED_WEBHOOK' WHEN s='F' THEN 'PAYMENT_SUCCESS_WEBHOOK'
  WHEN s='P' AND k%2=0 THEN 'PAYMENT_FAILED_WEBHOOK' WHEN s='P' THEN 'PAYMENT_USER_DROPPED_WEBHOOK'
  ELSE 'PAYMENT_PENDING_WEBHOOK' END AS event_type,
 CASE WHEN k%41<>0 OR n<>0 THEN t + (n*7+1) * INTERVAL '1' MINUTE END AS event_time,
 CASE WHEN k%7=0 THEN 'E'||(k%5) END AS error_code, CASE WHEN k%7=0 THEN 'error '||(k%3) END AS error_description,
 CASE k%3 WHEN 0 THEN 'K'||k WHEN 1 THEN 'T'||k ELSE CASE WHEN k%2=0 THEN 'ORD'||k ELSE 'CFO'||k END END AS order_id,
 amount, 'CF'||k AS cf_payment_id, 'message '||(k%9) AS payment_message, 'B'||k AS bank_reference,
 (k+n)%97=0 AS broken
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS t FROM orders), (SELECT unnest([0,1]) AS n)""",
    "pg_webhooks": """
SELECT webhook_id, event_type, event_time, order_id, amount, cf_payment_id, payment_message, bank_reference, error_code, error_description
FROM pg_webhooks_all WHERE NOT broken""",
    "payout_webhooks": """
SELECT k||'-'||n AS webhook_id,
 CASE WHEN n=1 AND k%5=0 THEN 'TRANSFER_FAILED' WHEN s='F' THEN 'TRANSFER_SUCCESS' WHEN s='P' THEN 'TRANSFER_FAILED'
  WHEN k%2=0 THEN 'TRANSFER_REVERSED' ELSE 'TRANSFER_PENDING' END AS event_type,
 t + INTERVAL '1' HOUR + (n*7) * INTERVAL '1' MINUTE AS event_time,
 CASE k%3 WHEN 0 THEN 'PAYOUT-T'||k WHEN 1 THEN 'T'||k ELSE 'NONE'||k END AS transfer_ref,
 'PO'||k AS cf_payout_id, amount, 'U'||k AS bank_reference, 'reason '||(k%4) AS failure_reason
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS t FROM orders), (SELECT unnest([0,1]) AS n)""",
    "settlement_invoices": """
SELECT 'INV'||l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS invoice_id, 'PLATFORM' AS payer_party_id,
 'S'||l_suppkey AS payee_party_id, CASE l_suppkey%3 WHEN 0 THEN 'NET_7' WHEN 1 THEN 'NET_15' ELSE 'NET_30' END AS payment_cycle,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_amount, CAST(l_shipdate AS DATE) AS approved_on,
 CASE l_linestatus WHEN 'F' THEN 'APPROVED' ELSE 'PENDING' END AS status FROM lineitem""",
    "contract_terms": """
SELECT 'S'||s_suppkey AS payee_party_id, CAST(CASE WHEN s_suppkey%2=0 THEN 0.05 ELSE 0.0325 END AS DECIMAL(6,4)) AS commission_pct,
 CAST(CASE WHEN s_suppkey%5=0 THEN 0.02 ELSE 0.01 END AS DECIMAL(6,4)) AS tds_rate FROM supplier WHERE s_suppkey%13<>0""",
    "batches": """
SELECT 'stl-'||payer_party_id||'-'||payee_party_id||'-'||payment_cycle||'-'||strftime(cycle_end, '%Y-%m-%d') AS batch_id,
 payer_party_id, payee_party_id, payment_cycle, cycle_end, count(*) AS invoice_count, CAST(sum(gross_amount) AS DECIMAL(24,2)) AS gross_amount,
 max(approved_on) + CASE payment_cycle WHEN 'NET_7' THEN 7 WHEN 'NET_15' THEN 15 ELSE 30 END AS due_date
FROM (SELECT *, date_trunc('day', DATE '1970-01-01' + CAST((date_diff('day', DATE '1970-01-01', approved_on) // days + 1) * days AS INTEGER))::DATE AS cycle_end
 FROM (SELECT *, CASE payment_cycle WHEN 'NET_7' THEN 7 WHEN 'NET_15' THEN 15 ELSE 30 END AS days FROM settlement_invoices))
WHERE status='APPROVED' GROUP BY payer_party_id, payee_party_id, payment_cycle, cycle_end""",
    "settled": """
SELECT *, CAST(gross_amount - platform_commission - gst_on_commission - tds_withheld AS DECIMAL(24,2)) AS net_payable
FROM (SELECT *, CAST(platform_commission * CAST(0.18 AS DECIMAL(3,2)) AS DECIMAL(24,2)) AS gst_on_commission FROM
 (SELECT b.*, CAST(gross_amount * commission_pct AS DECIMAL(24,2)) AS platform_commission,
  CAST(gross_amount * tds_rate AS DECIMAL(24,2)) AS tds_withheld,
  CASE WHEN commission_pct IS NULL OR tds_rate IS NULL THEN 'HELD' ELSE 'READY' END AS status
  FROM batches b LEFT JOIN contract_terms t ON b.payee_party_id=t.payee_party_id))""",
    "bank_entries": """
SELECT CASE WHEN k%11=0 THEN 'X'||ref ELSE ref END AS bank_ref,
 CAST(CASE WHEN k%5=0 THEN net_payable - 1 WHEN k%4=0 THEN half ELSE net_payable END AS DECIMAL(24,2)) AS amount,
 due_date + CASE WHEN k%6=0 THEN 3 ELSE 0 END AS value_date FROM (SELECT *, 'UTR-'||batch_id AS ref,
  CAST(substr(payee_party_id,2) AS BIGINT) AS k,
  CAST((CAST(net_payable*100 AS HUGEINT) + 1) // 2 AS DECIMAL(24,0)) * CAST(0.01 AS DECIMAL(3,2)) AS half FROM settled WHERE status='READY') WHERE k%7<>0
UNION ALL
SELECT ref, CAST(net_payable - half AS DECIMAL(24,2)), due_date FROM (SELECT *, 'UTR-'||batch_id AS ref,
  CAST(substr(payee_party_id,2) AS BIGINT) AS k,
  CAST((CAST(net_payable*100 AS HUGEINT) + 1) // 2 AS DECIMAL(24,0)) * CAST(0.01 AS DECIMAL(3,2)) AS half FROM settled WHERE status='READY')
WHERE k%7<>0 AND k%4=0 AND k%5<>0 AND k%11<>0""",
    "refund_requests": """
SELECT 'R-'||k||'-'||n AS refund_id, 'PT'||k AS transaction_id,
 CAST(amount * CAST(CASE WHEN k%4=0 THEN 0.30 WHEN n=2 THEN 0.40 ELSE 0.60 END AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS refund_amount,
 t + ((k%70)*3 + n) * INTERVAL '1' DAY AS requested_at
FROM (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS t FROM orders), (SELECT unnest([0,1,2]) AS n)""",
}


def _summary(subject: str, period: str, facts: str) -> str:
    who = "customer_id" if subject == "customer" else "org_id, coalesce(division_id,'') AS division_id"
    when = {
        "hour": "date_trunc('hour', txn_date) AS txn_hour",
        "day": "CAST(txn_date AS DATE) AS txn_date",
        "month": "CAST(year(txn_date) AS SMALLINT) AS txn_year, CAST(month(txn_date) AS SMALLINT) AS txn_month",
    }[period]
    who_keys = "customer_id" if subject == "customer" else "org_id, coalesce(division_id,'')"
    when_keys = {
        "hour": "date_trunc('hour', txn_date)", "day": "CAST(txn_date AS DATE)",
        "month": "year(txn_date), month(txn_date)",
    }[period]
    return f"""
SELECT {who}, {when}, coalesce(counterparty_id,'') AS counterparty_id, coalesce(transfer_type,'') AS transfer_type,
 coalesce(status,'') AS status, max(counterparty_name) AS counterparty_name, max(counterparty_type) AS counterparty_type,
 count(*) AS txn_count, CAST(sum(amount) AS DECIMAL(24,2)) AS total_amount, CAST(sum(fees) AS DECIMAL(24,2)) AS total_fees,
 CAST(sum(net_amount) AS DECIMAL(24,2)) AS total_net_amount, CAST(min(amount) AS DECIMAL(24,2)) AS min_amount,
 CAST(max(amount) AS DECIMAL(24,2)) AS max_amount, {avg6('sum(amount)', 'count(amount)')} AS avg_amount
FROM {facts}
GROUP BY {who_keys}, {when_keys}, coalesce(counterparty_id,''), coalesce(transfer_type,''), coalesce(status,'')"""


def avg6(total: str, count: str) -> str:
    """Exact average of cents rounded half up to six places (positive totals)."""
    scaled = f"((CAST(({total}) * 100 AS HUGEINT) * 20000 + ({count})) // nullif(2 * ({count}), 0))"
    return f"CAST(CAST({scaled} AS DECIMAL(30,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(24,6))"


def rate2(part: str, whole: str) -> str:
    """100 * part / whole for integers, rounded half up to two places, exactly."""
    scaled = f"((CAST({part} AS HUGEINT) * 20000 + CAST({whole} AS HUGEINT)) // nullif(2 * CAST({whole} AS HUGEINT), 0))"
    return f"CAST(CAST({scaled} AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(9,2))"


TABLES["customer_daily"] = _summary("customer", "day", "customer_facts")
TABLES["org_daily"] = _summary("org", "day", "org_facts")
TABLES["customer_monthly"] = _summary("customer", "month", "customer_facts")
TABLES["org_monthly"] = _summary("org", "month", "org_facts")
TABLES["customer_hourly"] = _summary("customer", "hour", "activity_facts")
TABLES["org_hourly"] = _summary("org", "hour", "activity_facts")


def summary(subject: str, period: str, facts: str) -> str:
    return _summary(subject, period, facts)


def with_tables(body: str) -> str:
    """Prefix a query with the derived tables it mentions, directly or through each other."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        for other in TABLES:
            if other != name and other not in needed and re.search(rf"\b{other}\b", TABLES[name]):
                visit_name(other)
        if name not in needed:
            needed.append(name)

    visit(body)
    if not needed:
        return body
    own = body.strip()
    clauses = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    if own.upper().startswith("WITH "):
        return f"WITH {clauses},\n{own[5:]}"
    return f"WITH {clauses}\n{own}"
