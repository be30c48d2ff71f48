"""History requests for one subject, against plain Python over the same rows."""

import pytest

from ledgerloom.operators import history as h
from ledgerloom.operators import ledger as lg
from ledgerloom.operators import retention as rt
from ledgerloom.sources import sample_tables as st
from facts_fixture import plain

AS_OF = "2001-08-01 12:00:00"


@pytest.fixture(scope="module")
def transfers(spark, sf_dir):
    return st.wallet_transfers(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def rows(transfers):
    return transfers.collect()


def _window(rows, low, high):
    return [r for r in rows if low <= r.initiated_at <= high]


def test_user_history(spark, sf_dir, transfers, rows):
    chosen = h.HistoryFilter(period="LAST_7_YEARS", sort="AMOUNT_DESC", page=1, size=3)
    got = h.user_history(transfers, st.individual_wallets(spark, sf_dir), "C10", chosen, AS_OF)
    mine = [r for r in _window(rows, *got.window) if r.source_wallet_id == "W10"]
    mine.sort(key=lambda r: (-r.amount, r.transfer_id))
    assert [r.transfer_id for r in got.items.collect()] == [r.transfer_id for r in mine[3:6]]
    info = got.info.first()
    assert (info.total_elements, info.total_pages) == (len(mine), -(-len(mine) // 3))
    page = mine[3:6]
    stats = got.page_stats.first()
    assert stats.success_count == sum(r.status == "COMPLETED" for r in page)
    assert stats.total_amount_spent == sum((r.amount for r in page if r.status == "COMPLETED"), 0)
    whole = got.window_stats.first()
    assert whole.failed_count == sum(r.status in ("FAILED", "REVERSED") for r in mine)
    assert whole.success_count + whole.failed_count + whole.pending_count == len(mine)


def test_org_history_by_division_and_party(spark, sf_dir, transfers, rows):
    wallets = st.enterprise_wallets(spark, sf_dir).collect()
    # The organisation with most transfers in the sample.
    paid = {w.wallet_id: sum(r.source_wallet_id == w.wallet_id for r in rows) for w in wallets}
    wallet = max((w for w in wallets if w.division_id), key=lambda w: paid[w.wallet_id])
    chosen = h.HistoryFilter(period="LAST_7_YEARS", size=100, statuses=("FAILED", "COMPLETED"))
    got = h.org_history(transfers, st.enterprise_wallets(spark, sf_dir), wallet.org_id, chosen, AS_OF)
    ids = {w.wallet_id for w in wallets if w.org_id == wallet.org_id}
    expected = {r.transfer_id for r in _window(rows, *got.window)
                if r.source_wallet_id in ids and r.status in chosen.statuses}
    assert {r.transfer_id for r in got.items.collect()} == expected
    one = h.org_history(transfers, st.enterprise_wallets(spark, sf_dir), wallet.org_id,
                        h.HistoryFilter(period="LAST_7_YEARS", size=100), AS_OF, wallet.division_id)
    mine = [r for r in _window(rows, *got.window) if r.source_wallet_id == wallet.wallet_id]
    assert {r.transfer_id for r in one.items.collect()} == {r.transfer_id for r in mine}
    target = next(r.destination_wallet_id or r.destination_account_number for r in mine)
    some = h.org_history(transfers, st.enterprise_wallets(spark, sf_dir), wallet.org_id,
                         h.HistoryFilter(period="LAST_7_YEARS", size=100), AS_OF, " ", "", target)
    assert {r.transfer_id for r in some.items.collect()} == {
        r.transfer_id for r in _window(rows, *got.window) if r.source_wallet_id in ids
        and target in (r.destination_wallet_id, r.destination_account_number)}


def test_between_is_directed(transfers, rows):
    row = next(r for r in rows if r.source_wallet_id and r.destination_wallet_id and r.initiated_at.year > 1995)
    chosen = h.HistoryFilter(period="LAST_7_YEARS")
    a, b = row.source_wallet_id, row.destination_wallet_id
    there = h.between_history(transfers, a, b, chosen, AS_OF).items.collect()
    assert row.transfer_id in {r.transfer_id for r in there}
    assert all(r.source_wallet_id == a and r.destination_wallet_id == b for r in there)


def test_pages_do_not_overlap_and_sizes_are_limited(transfers, rows):
    seen = []
    for page in range(3):
        seen += [r.transfer_id for r in h.page_of(transfers, "DATE_DESC", page, 100).collect()]
    expected = sorted(rows, key=lambda r: r.transfer_id)
    expected.sort(key=lambda r: r.initiated_at, reverse=True)
    assert seen == [r.transfer_id for r in expected[:300]]
    with pytest.raises(ValueError):
        h.page_of(transfers, size=0)


def test_summary_has_no_group_of_the_other_kind(transfers, rows):
    groups = h.destination_summary(transfers, []).collect()
    assert all(g.destination_id is not None for g in groups)
    assert sum(g.transaction_count for g in groups) == len(rows)


def test_single_wallet_lookups(spark, sf_dir, transfers, rows):
    newest = [r.initiated_at for r in h.by_source_wallet(transfers, "W10").collect()]
    assert newest == sorted(newest, reverse=True) and newest
    assert h.by_destination_wallet(transfers, "W7").count() == sum(r.destination_wallet_id == "W7" for r in rows)
    ledger = lg.with_balances(st.ledger_moves(spark, sf_dir)).cache()
    mine = sorted((r for r in ledger.collect() if r.wallet_id == "U3"), key=lambda r: r.created_at, reverse=True)
    page = lg.statement(ledger, "U3", mine[0].wallet_type, 1, 5).collect()
    assert [r.transaction_id for r in page] == [r.transaction_id for r in mine[5:10]]
    assert lg.statement(ledger, "U3", "OTHER").count() == 0
    audit = st.audit_steps(spark, sf_dir)
    assert [r.audit_id for r in lg.transfer_audit(audit, "T5").collect()] == ["T5-1", "T5-2"]
    legs = st.transfer_legs(spark, sf_dir)
    some = legs.first().transfer_id
    assert lg.transfer_ledger(legs, some).count() == legs.filter(legs.transfer_id == some).count()


def test_purge_of_stored_tables(spark, sf_dir, tmp_path, transfers):
    limit = rt.cutoff("2005-02-28", 30)
    assert str(limit) == "1998-02-28 00:00:00"
    edge = "2005-02-28"
    assert rt.cutoff(edge, 3).year == 2002
    tables = {
        "wallet_transfers": transfers.withColumn("y", transfers.initiated_at.cast("date").substr(1, 4).cast("int")),
        "wallet_transactions": st.transfer_legs(spark, sf_dir).selectExpr("*", "year(created_at) AS y"),
        "wallet_audit_logs": st.audit_steps(spark, sf_dir).selectExpr("*", "year(created_at) AS y"),
        "payment_transactions": st.payment_transactions(spark, sf_dir).selectExpr("*", "year(initiated_at) AS y"),
    }
    paths = {}
    for name, table in tables.items():
        paths[name] = str(tmp_path / name)
        table.write.partitionBy("y").parquet(paths[name])
    before = rt.purge_counts(*(spark.read.parquet(paths[n]) for n in (
        "wallet_transfers", "wallet_transactions", "wallet_audit_logs", "payment_transactions")), limit)
    gone = {r.table_name: r.expired_rows for r in before.collect()}
    sizes = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    expected = {n: plain(rt.kept_records(spark.read.parquet(paths[n]), limit))
                for n in ("wallet_transfers", "payment_transactions")}
    rt.purge(spark, paths, "y", limit)
    for name, path in paths.items():
        assert spark.read.parquet(path).count() == sizes[name] - gone[name]
    for name, kept in expected.items():
        assert plain(spark.read.parquet(paths[name])) == kept
    rt.purge(spark, paths, "y", limit)
    assert spark.read.parquet(paths["wallet_transfers"]).count() == len(expected["wallet_transfers"])
