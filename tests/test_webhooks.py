"""Hand-written webhooks: repeats, order, prefixes, unreadable bodies."""

import datetime as dt
import json
from decimal import Decimal

from ledgerloom.operators import webhooks as wh
from ledgerloom.sources import messages

T0 = dt.datetime(2024, 1, 1, 10)
ARCHIVE = "webhook_id string, body string"


def _pg(number, order, kind, minutes=0, payment=None):
    body = {"type": kind, "event_time": (T0 + dt.timedelta(minutes=minutes)).isoformat(),
            "data": {"order": {"order_id": order, "order_amount": 10.5}, "payment": payment or {"cf_payment_id": "X"},
                     "extra": [1, 2]}}
    return (f"w{number}", json.dumps(body))


def _payout(number, transfer, kind, minutes=0, payout=None):
    body = {"type": kind, "event_time": (T0 + dt.timedelta(minutes=minutes)).isoformat(),
            "data": {"transfer": {"transfer_id": transfer, "cf_transfer_id": payout, "failure_reason": "closed"}}}
    return (f"w{number}", json.dumps(body))


def _transfers(spark, rows):
    return spark.createDataFrame(
        rows, "transfer_id string, idempotency_key string, cf_payout_id string, transfer_type string, status string")


def _apply(spark, transfers, pg, payouts):
    pg_rows = messages.pg_webhooks(spark.createDataFrame(pg, ARCHIVE))
    po_rows = messages.payout_webhooks(spark.createDataFrame(payouts, ARCHIVE))
    result = wh.apply_to_transfers(transfers, wh.match_pg_webhooks(pg_rows, transfers),
                                   wh.match_payout_webhooks(po_rows, transfers))
    return {r.transfer_id: r for r in result.collect()}


def test_first_terminal_event_wins_and_later_ones_are_ignored(spark):
    transfers = _transfers(spark, [
        ("T1", "K1", None, "ACCOUNT_TO_WALLET", "PENDING_PAYMENT"),
        ("T2", "K2", None, "ACCOUNT_TO_ACCOUNT", "PENDING_PAYMENT"),
        ("T3", "K3", "PO3", "WALLET_TO_ACCOUNT", "PAYOUT_INITIATED"),
        ("T4", "K4", None, "WALLET_TO_ACCOUNT", "COMPLETED"),
        ("T5", "K5", None, "WALLET_TO_WALLET", "INITIATED"),
        ("T6", "K6", None, "ACCOUNT_TO_ACCOUNT", "PAYOUT_INITIATED"),
    ])
    got = _apply(spark, transfers, [
        _pg(1, "K1", "PAYMENT_FAILED_WEBHOOK", 9, {"payment_message": "late"}),
        _pg(2, "K1", "PAYMENT_SUCCESS_WEBHOOK", 3),
        _pg(3, "T2", "PAYMENT_SUCCESS_WEBHOOK", 1),
        _pg(4, "K5", "PAYMENT_SUCCESS_WEBHOOK", 1),
        _pg(5, "nobody", "PAYMENT_SUCCESS_WEBHOOK", 1),
        _pg(6, "T2", "SOMETHING_ELSE", 2),
    ], [
        _payout(7, "unknown", "TRANSFER_FAILED", 5, "PO3"),
        _payout(8, "T4", "TRANSFER_REVERSED", 5),
        _payout(9, "PAYOUT-T6", "TRANSFER_FAILED", 8),
        _payout(10, "PAYOUT-T6", "TRANSFER_SUCCESS", 8),
    ])
    assert {k: r.new_status for k, r in got.items()} == {
        "T1": "COMPLETED", "T2": "PAYOUT_INITIATED", "T3": "REVERSED", "T4": "COMPLETED", "T5": "INITIATED",
        "T6": "COMPLETED"}
    assert got["T1"].decided_at == T0 + dt.timedelta(minutes=3)
    assert got["T3"].webhook_failure_reason == "Payout failed: closed"
    # Equal times are ordered by id, as text.
    assert got["T6"].decided_by == "po-w10"
    assert (got["T4"].decided_by, got["T5"].webhooks) == (None, 1)


def test_standalone_payments(spark):
    payments = spark.createDataFrame(
        [("P1", "O1", "G1", "PENDING_PAYMENT"), ("P2", "O2", "G2", "PENDING_PAYMENT"), ("P3", "O3", "G3", "EXPIRED")],
        "transaction_id string, order_id string, cf_order_id string, status string")
    rows = messages.pg_webhooks(spark.createDataFrame([
        _pg(1, "G1", "PAYMENT_USER_DROPPED_WEBHOOK", 1), _pg(2, "O2", "NEW_KIND", 1), _pg(3, "O3", "PAYMENT_SUCCESS_WEBHOOK"),
    ], ARCHIVE))
    got = wh.apply_to_payments(payments, wh.match_standalone_webhooks(rows, payments)).collect()
    assert {r.transaction_id: r.new_status for r in got} == {"P1": "CANCELLED", "P2": "PROCESSING", "P3": "EXPIRED"}
    reasons = {r.transaction_id: r.webhook_failure_reason for r in got}
    assert reasons["P1"] == "User dropped payment on checkout page"


def test_unreadable_bodies_are_kept_apart(spark):
    good = _pg(1, "O1", "PAYMENT_SUCCESS_WEBHOOK")
    archive = spark.createDataFrame(
        [good, ("w2", good[1][:40]), ("w3", "not json"), ("w4", None), ("w5", "{}"), ("w6", '{"type": "X"}')], ARCHIVE)
    rows = messages.pg_webhooks(archive).collect()
    assert [(r.webhook_id, r.amount) for r in rows] == [("w1", Decimal("10.50"))]
    rejected = {r.webhook_id for r in messages.rejected_webhooks(archive).collect()}
    assert rejected == {"w2", "w3", "w4", "w5", "w6"}


def test_many_copies_of_one_webhook_count_once_in_effect(spark):
    transfers = _transfers(spark, [("T1", "K1", None, "ACCOUNT_TO_WALLET", "PENDING_PAYMENT")])
    copies = [_pg(n, "K1", "PAYMENT_SUCCESS_WEBHOOK", 1) for n in range(200)]
    got = _apply(spark, transfers, copies, [_payout(1, "none", "TRANSFER_SUCCESS")])
    assert (got["T1"].new_status, got["T1"].webhooks) == ("COMPLETED", 200)


def test_first_request_of_a_key_wins(spark):
    rows = [("P2", "O2", "K", "FAILED", Decimal("1.00"), T0 + dt.timedelta(minutes=1)),
            ("P1", "O1", "K", "SUCCESS", Decimal("2.00"), T0), ("P3", "O3", None, "SUCCESS", Decimal("3.00"), T0)]
    payments = spark.createDataFrame(rows, "transaction_id string, order_id string, idempotency_key string, "
                                           "status string, amount decimal(15,2), initiated_at timestamp_ntz")
    got = {r.request_key: (r.transaction_id, r.requests) for r in wh.idempotent_requests(payments).collect()}
    assert got == {"K": ("P1", 2), "O3": ("P3", 1)}


def test_events_are_shuffled_as_plain_columns(spark):
    transfers = _transfers(spark, [("T1", "K1", None, "ACCOUNT_TO_WALLET", "PENDING_PAYMENT")])
    pg = messages.pg_webhooks(spark.createDataFrame([_pg(1, "K1", "PAYMENT_SUCCESS_WEBHOOK", 3)], ARCHIVE))
    payouts = messages.payout_webhooks(spark.createDataFrame([_payout(2, "T1", "TRANSFER_FAILED", 5)], ARCHIVE))
    result = wh.apply_to_transfers(transfers, wh.match_pg_webhooks(pg, transfers), wh.match_payout_webhooks(payouts, transfers))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    before, joined = plan.split("Join LeftOuter", 1)
    assert "struct(untimed" in before and "struct(untimed" not in joined
    assert [(r.new_status, r.decided_by, r.webhooks) for r in result.collect()] == [("COMPLETED", "pg-w1", 2)]
