"""Worked examples of settlement, reconciliation and refunds."""

import datetime as dt
from decimal import Decimal

from ledgerloom.operators import settlement as se

DAY = dt.date(2026, 8, 2)


def _invoices(spark, rows):
    return spark.createDataFrame(rows, "invoice_id string, payer_party_id string, payee_party_id string, "
                                       "payment_cycle string, gross_amount decimal(18,2), approved_on date, status string")


def test_batch_of_three_invoices(spark):
    rows = [(f"INV{i}", "org", "carrier", "NET_30", Decimal("15000.00"), DAY, "APPROVED") for i in range(3)]
    rows.append(("INV9", "org", "carrier", "NET_30", Decimal("1.00"), DAY, "PENDING"))
    terms = spark.createDataFrame([("carrier", Decimal("0.05"), Decimal("0.01"))],
                                  "payee_party_id string, commission_pct decimal(6,4), tds_rate decimal(6,4)")
    batch = se.with_deductions(se.settlement_batches(_invoices(spark, rows)), terms).first()
    assert (batch.gross_amount, batch.platform_commission, batch.gst_on_commission, batch.tds_withheld,
            batch.net_payable) == tuple(map(Decimal, ("45000.00", "2250.00", "405.00", "450.00", "41895.00")))
    assert batch.due_date == dt.date(2026, 9, 1)
    assert (batch.invoice_count, batch.batch_id) == (3, "stl-org-carrier-NET_30-2026-08-05")


def test_reconciliation_of_parts_and_strangers(spark):
    settlements = spark.createDataFrame(
        [(f"R{i}", f"B{i}", Decimal("10.00"), DAY) for i in range(4)],
        "bank_ref string, batch_id string, net_payable decimal(24,2), due_date date")
    bank = spark.createDataFrame(
        [("R0", Decimal("4.00"), DAY), ("R0", Decimal("6.00"), DAY), ("R1", Decimal("9.00"), DAY + dt.timedelta(1)),
         ("R3", Decimal("10.00"), DAY + dt.timedelta(2)), ("Z", Decimal("1.00"), DAY)],
        "bank_ref string, amount decimal(24,2), value_date date")
    got = {r.bank_ref: (r.reconciliation, r.delayed) for r in se.reconcile(settlements, bank).collect()}
    assert got == {"R0": ("MATCHED", False), "R1": ("PARTIAL", True), "R2": ("UNMATCHED_SETTLEMENT", False),
                   "R3": ("MATCHED", True), "Z": ("UNMATCHED_BANK", False)}


def test_refund_windows(spark):
    paid_at = dt.datetime(2024, 1, 1, 12)
    payments = spark.createDataFrame(
        [("C", "CARD", "SUCCESS"), ("U", "UPI", "SUCCESS"), ("A", "ACCOUNT_TRANSFER", "SUCCESS"), ("F", "UPI", "FAILED")],
        "transaction_id string, payment_method string, status string").selectExpr(
        "*", "cast(100 as decimal(15,2)) AS amount", f"cast('{paid_at}' as timestamp_ntz) AS updated_at")
    ask = [("r1", "C", "100.00", 180), ("r2", "U", "10.00", 30), ("r3", "U", "10.00", 31), ("r4", "A", "60.00", 900),
           ("r5", "A", "50.00", 900), ("r6", "F", "1.00", 1), ("r7", "none", "1.00", 1)]
    refunds = spark.createDataFrame(
        [(i, t, Decimal(a), paid_at + dt.timedelta(days=d)) for i, t, a, d in ask],
        "refund_id string, transaction_id string, refund_amount decimal(18,2), requested_at timestamp_ntz")
    got = {r.refund_id: r.reason for r in se.refund_eligibility(refunds, payments).collect()}
    assert got == {"r1": None, "r2": None, "r3": "window over", "r4": None, "r5": "exceeds payment",
                   "r6": "not paid", "r7": "not paid"}


def test_refused_refunds_use_nothing_up(spark):
    at = dt.datetime(2024, 1, 1)
    payments = spark.createDataFrame([("P", "ACCOUNT_TRANSFER", "SUCCESS"), ("Q", "UPI", "SUCCESS")],
                                     "transaction_id string, payment_method string, status string").selectExpr(
        "*", "cast(100 as decimal(15,2)) AS amount", f"cast('{at}' as timestamp_ntz) AS updated_at")
    ask = [("r1", "P", "60.00", 1), ("r2", "P", "60.00", 2), ("r3", "P", "40.00", 3), ("r4", "P", "0.01", 4), ("r5", "P", "0.00", 5),
           ("r6", "Q", "90.00", 31), ("r7", "Q", "100.00", 2), ("r8", None, "1.00", 1), ("r9", "Q", None, 3)]
    refunds = spark.createDataFrame(
        [(i, t, a and Decimal(a), at + dt.timedelta(days=d)) for i, t, a, d in ask],
        "refund_id string, transaction_id string, refund_amount decimal(18,2), requested_at timestamp_ntz")
    got = {r.refund_id: r.reason for r in se.refund_eligibility(refunds, payments).collect()}
    assert got == {"r1": None, "r2": "exceeds payment", "r3": None, "r4": "exceeds payment", "r5": None, "r6": "window over",
                   "r7": None, "r8": "not paid", "r9": None}
