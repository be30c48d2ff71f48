"""Following cursors gives every row once, in order; the cursor reaches the scan."""

import datetime as dt
import random

import pytest

from ledgerloom.operators import history, ledger, paging

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("ids_descending", [True, False])
def test_pages_hold_every_row_once(spark, descending, ids_descending):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 2, 3]), f"T{i:03d}") for i in range(57)]
    df = spark.createDataFrame(rows, "v int, id string").coalesce(2)
    order = [("v", descending), ("id", ids_descending)]
    found, cursor = [], None
    while True:
        page = paging.page_after(df, order, 10, cursor)
        found += [tuple(r) for r in page.collect()]
        cursor = paging.cursor_of(page, order)
        if cursor is None:
            break
    ids = sorted(rows, key=lambda r: r[1], reverse=ids_descending)
    filled = sorted((r for r in ids if r[0] is not None), key=lambda r: r[0], reverse=descending)
    empty = [r for r in ids if r[0] is None]
    assert found == (filled + empty if descending else empty + filled)


def test_the_cursor_is_a_filter_of_the_scan(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS v", "cast(id AS string) AS transfer_id")
    df.repartitionByRange(8, "v").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    plan = paging.page_after(read, [("v", True), ("transfer_id", False)], 20, (1000, "1000"))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "LessThan(v,1000)" in plan[plan.index("PushedFilters"):]


def test_a_wrong_cursor_is_refused(spark):
    with pytest.raises(ValueError):
        paging.after([("v", True), ("id", False)], (1,))
    with pytest.raises(ValueError):
        paging.page_after(spark.range(1), [("id", False)], 0)


def test_history_requests_follow_cursors(spark):
    names = history.ITEM_COLUMNS
    kinds = ", ".join(f"{n} " + {"amount": "decimal(18,2)", "fees": "decimal(18,2)", "net_amount": "decimal(18,2)",
                                 "initiated_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}.get(n, "string") for n in names)
    rows = [{"transfer_id": f"T{i:02d}", "status": "COMPLETED", "source_wallet_id": "W1", "destination_wallet_id": "W2",
             "initiated_at": DAY + dt.timedelta(hours=i // 2)} for i in range(45)]
    transfers = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)
    wanted = [r["transfer_id"] for r in sorted(rows, key=lambda r: (-r["initiated_at"].timestamp(), r["transfer_id"]))]
    found, after = [], None
    while True:
        answer = history.between_history(transfers, "W1", "W2", history.HistoryFilter("LAST_MONTH", size=20, after=after), "2024-01-20")
        found += [r.transfer_id for r in answer.items.collect()]
        after = answer.next_page()
        if after is None:
            break
    assert found == wanted


def test_wallet_audit_newest_first(spark):
    rows = [(f"A{i}", "W1" if i % 3 else "W2", DAY + dt.timedelta(minutes=i // 2)) for i in range(20)]
    audit = spark.createDataFrame(rows, "audit_id string, wallet_id string, created_at timestamp_ntz")
    first = ledger.wallet_audit(audit, "W1", 0, 5)
    second = ledger.wallet_audit(audit, "W1", 0, 5, paging.cursor_of(first, ledger.AUDIT_NEWEST))
    wanted = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True) if r[1] == "W1"]
    assert [r.audit_id for r in first.collect() + second.collect()] == wanted[:10]
    assert [r.audit_id for r in ledger.wallet_audit(audit, "W1", 1, 5).collect()] == wanted[5:10]
