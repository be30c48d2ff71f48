"""Settlement, reconciliation, refunds, dunning and funnel over the sample tables (*spec* operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.oracle_tables import rate2, with_tables
from ledgerloom.operators import settlement as se
from ledgerloom.sources import sample_tables as st

DUNNING_AS_OF = "2024-01-25 00:00:00"
INTENT_AS_OF = "1999-06-30 00:00:00"


def _settled(s, d) -> DataFrame:
    return se.with_deductions(se.settlement_batches(st.settlement_invoices(s, d)), st.contract_terms(s, d))


def _reconciled(s, d) -> DataFrame:
    settlements = _settled(s, d).filter("status = 'READY'").withColumn("bank_ref", F.concat(F.lit("UTR-"), "batch_id"))
    return se.reconcile(settlements, st.bank_entries(settlements))


QUERIES = {
    "settlement_batches": lambda s, d: se.settlement_batches(st.settlement_invoices(s, d)),
    "settlement_lines": lambda s, d: se.batch_lines(st.settlement_invoices(s, d)).select("batch_id", "invoice_id"),
    "settlement_deductions": _settled,
    "settlement_due": lambda s, d: se.batch_lines(st.settlement_invoices(s, d)).select(
        "invoice_id", "payment_cycle", "approved_on", "due_date"),
    "reconcile_bank": _reconciled,
    "refund_eligibility": lambda s, d: se.refund_eligibility(
        st.refund_requests(s, d), st.payment_transactions(s, d)),
    "dunning_state": lambda s, d: se.dunning_state(st.billing_attempts(s, d), DUNNING_AS_OF),
    "intent_expiry": lambda s, d: se.expire_intents(st.payment_intents(s, d), INTENT_AS_OF).select(
        "intent_id", "status", "new_status"),
    "payment_funnel": lambda s, d: se.payment_funnel(st.payment_transactions(s, d)),
    "failure_reasons": lambda s, d: se.failure_reasons(st.payment_transactions(s, d)),
}

ORACLE = {
    "settlement_batches": with_tables("SELECT * FROM batches"),
    "settlement_lines": with_tables("""SELECT 'stl-'||payer_party_id||'-'||payee_party_id||'-'||payment_cycle||'-'||
 strftime(DATE '1970-01-01' + CAST((date_diff('day', DATE '1970-01-01', approved_on) // days + 1) * days AS INTEGER), '%Y-%m-%d') AS batch_id,
 invoice_id FROM (SELECT *, CASE payment_cycle WHEN 'NET_7' THEN 7 WHEN 'NET_15' THEN 15 ELSE 30 END AS days
  FROM settlement_invoices) WHERE status='APPROVED'"""),
    "settlement_deductions": with_tables("SELECT * FROM settled"),
    "settlement_due": with_tables("""SELECT invoice_id, payment_cycle, approved_on,
 approved_on + CASE payment_cycle WHEN 'NET_7' THEN 7 WHEN 'NET_15' THEN 15 ELSE 30 END AS due_date
FROM settlement_invoices WHERE status='APPROVED'"""),
    "reconcile_bank": with_tables("""SELECT coalesce(s.bank_ref, c.bank_ref) AS bank_ref, batch_id, net_payable, credited, credits,
 CASE WHEN batch_id IS NULL THEN 'UNMATCHED_BANK' WHEN credited IS NULL THEN 'UNMATCHED_SETTLEMENT'
  WHEN credited = net_payable THEN 'MATCHED' ELSE 'PARTIAL' END AS reconciliation,
 coalesce(value_date > due_date, false) AS delayed
FROM (SELECT *, 'UTR-'||batch_id AS bank_ref FROM settled WHERE status='READY') s FULL JOIN
 (SELECT bank_ref, CAST(sum(amount) AS DECIMAL(24,2)) AS credited, max(value_date) AS value_date, count(*) AS credits
  FROM bank_entries GROUP BY 1) c ON s.bank_ref = c.bank_ref"""),
    "refund_eligibility": with_tables("""SELECT r.refund_id, r.transaction_id, r.refund_amount, f.payment_method,
 f.refund_id IS NOT NULL AND f.granted AS eligible,
 CASE WHEN f.refund_id IS NULL THEN 'not paid' WHEN f.late THEN 'window over' WHEN NOT f.granted THEN 'exceeds payment' END AS reason
FROM refund_requests r LEFT JOIN (WITH RECURSIVE asked AS (SELECT r.*, p.payment_method, p.amount AS paid,
  coalesce((p.payment_method='CARD' AND date_diff('day', p.updated_at, r.requested_at) > 180)
   OR (p.payment_method='UPI' AND date_diff('day', p.updated_at, r.requested_at) > 30), false) AS late,
  row_number() OVER (PARTITION BY r.transaction_id ORDER BY r.requested_at, r.refund_id) AS turn
  FROM refund_requests r JOIN payment_transactions p ON r.transaction_id=p.transaction_id AND p.status='SUCCESS'),
 turns AS (SELECT *, NOT late AND refund_amount <= paid AS granted,
   paid - CASE WHEN NOT late AND refund_amount <= paid THEN refund_amount ELSE 0 END AS rest FROM asked WHERE turn = 1
  UNION ALL SELECT a.*, NOT a.late AND a.refund_amount <= t.rest,
   t.rest - CASE WHEN NOT a.late AND a.refund_amount <= t.rest THEN a.refund_amount ELSE 0 END
  FROM asked a JOIN turns t ON a.transaction_id = t.transaction_id AND a.turn = t.turn + 1)
 SELECT * FROM turns) f ON r.refund_id = f.refund_id"""),
    "dunning_state": f"""SELECT subscription_id, cycle_start, failures, state,
 CASE WHEN state='RETRYING' THEN ff + CASE failures WHEN 1 THEN 24 WHEN 2 THEN 48 ELSE 72 END * INTERVAL '1' HOUR END AS next_retry_at,
 CASE WHEN ok = 0 AND failures > 3 THEN lf END AS held_at
FROM (SELECT *, CASE WHEN ok > 0 THEN 'PAID' WHEN failures <= 3 THEN 'RETRYING'
  WHEN TIMESTAMP '{DUNNING_AS_OF}' >= lf + INTERVAL '30' DAY THEN 'CANCELLED'
  WHEN TIMESTAMP '{DUNNING_AS_OF}' >= lf + INTERVAL '7' DAY THEN 'PAUSED' ELSE 'HELD' END AS state
 FROM (SELECT 'SUB'||user_id AS subscription_id, CAST(ts AS DATE) AS cycle_start,
  count(*) FILTER (event_type NOT IN ('purchase','signup')) AS failures,
  count(*) FILTER (event_type IN ('purchase','signup')) AS ok,
  min(ts) FILTER (event_type NOT IN ('purchase','signup')) AS ff, max(ts) FILTER (event_type NOT IN ('purchase','signup')) AS lf
  FROM events WHERE ts <= TIMESTAMP '{DUNNING_AS_OF}' GROUP BY 1, 2))""",
    "intent_expiry": f"""SELECT 'PI'||k AS intent_id, status, CASE WHEN status IN ('CREATED','PROCESSING')
 AND expires_at < TIMESTAMP '{INTENT_AS_OF}' THEN 'CANCELLED' ELSE status END AS new_status
FROM (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'CAPTURED' WHEN 'P' THEN 'PROCESSING' ELSE 'CREATED' END AS status,
 o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR + (o_orderkey%60) * INTERVAL '1' MINUTE AS expires_at FROM orders)""",
    "payment_funnel": with_tables(f"""SELECT payment_method, count(*) AS payments,
 count(*) FILTER (status='SUCCESS') AS paid, {rate2("count(*) FILTER (status='SUCCESS')", "count(*)")} AS conversion_rate,
 CAST(sum(date_diff('second', initiated_at, updated_at)) FILTER (status='SUCCESS') AS DOUBLE)
  / count(*) FILTER (status='SUCCESS') AS mean_seconds_to_pay
FROM payment_transactions GROUP BY 1"""),
    "failure_reasons": with_tables("""SELECT payment_method, failure_reason, count(*) AS failures FROM payment_transactions
WHERE failure_reason IS NOT NULL GROUP BY 1, 2"""),
}
