"""Rollup edge rows and invariants."""

import datetime as dt
from decimal import Decimal

from facts_fixture import fact, frame, plain
from ledgerloom.operators import rollups as r
from ledgerloom.plans.jobs import weekly_report
from ledgerloom.operators.upsert import merge_rows, replace_rows_in_range
from ledgerloom.functions.periods import in_zone, ts_lit
from ledgerloom.sources.facts import month_predicates


def test_null_and_empty_grain_values_share_one_group(spark):
    rows = [
        fact("2024-02-29 23:59:59.999999", kind=None, party=None, name=None, status=None),
        fact("2024-02-29 00:00:00", kind="", party="", name="Zed", status=""),
        fact("2024-03-01 00:00:00", kind="", party="", name="Zed", status=""),
    ]
    days = r.daily_rollup(frame(spark, rows), "customer").orderBy("txn_date").collect()
    assert [(d.txn_date, d.txn_count, d.counterparty_name) for d in days] == [
        (dt.date(2024, 2, 29), 2, "Zed"), (dt.date(2024, 3, 1), 1, "Zed")]
    org = r.daily_rollup(frame(spark, rows), "org").collect()
    assert {o.division_id for o in org} == {""}


def test_average_is_rounded_half_up(spark):
    rows = [fact("2024-01-01", amount=a) for a in ("0.01", "0.01", "0.02")]
    row = r.daily_rollup(frame(spark, rows), "customer").first()
    assert row.avg_amount == Decimal("0.013333")
    assert row.total_amount == Decimal("0.04")


def test_month_run_on_the_first_completes_the_month_before(spark):
    rows = [fact("2024-01-31 10:00:00"), fact("2024-02-01 10:00:00")]
    done = r.monthly_rollup(frame(spark, rows), "customer", "2024-02-01").collect()
    assert [(d.txn_year, d.txn_month, d.txn_count) for d in done] == [(2024, 1, 1)]


def test_daily_run_takes_only_yesterday(spark):
    rows = [fact("2024-01-30 23:59:59"), fact("2024-01-31 00:00:00"), fact("2024-02-01 00:00:00")]
    done = r.daily_rollup(frame(spark, rows), "customer", "2024-02-01").collect()
    assert [d.txn_date for d in done] == [dt.date(2024, 1, 31)]


def _stream_like(spark):
    start = dt.datetime(2024, 1, 5, 8)
    rows = [fact(start + dt.timedelta(minutes=7 * i), amount=f"{i + 1}.25", customer=f"C{i % 3}", party=f"P{i % 2}")
            for i in range(60)]
    return frame(spark, rows), rows


def test_any_split_gives_the_full_result(spark):
    facts, rows = _stream_like(spark)
    end = rows[-1][12]
    full = plain(r.rollup(facts, "customer", "hour"))
    for cut in (rows[3][12], rows[17][12], rows[40][12], end):
        first = r.incremental_hours(facts, "customer", "2020-01-01", cut)
        second = r.incremental_hours(facts, "customer", cut, end)
        low = ts_lit(r.first_touched_hour(cut))
        assert plain(replace_rows_in_range(first, second, "txn_hour", low, ts_lit(end))) == full


def test_partial_replacement_loses_part_of_a_split_hour(spark):
    facts, rows = _stream_like(spark)
    cut = rows[3][12]
    first = r.incremental_partial(facts, "customer", "2020-01-01", cut)
    second = r.incremental_partial(facts, "customer", cut)
    merged = merge_rows(first, second, r.grain_keys("customer", "hour"))
    total = merged.agg({"txn_count": "sum"}).first()[0]
    assert total < len(rows)


def test_summaries_add_up_to_the_facts_at_every_period(spark):
    facts, rows = _stream_like(spark)
    for period in ("hour", "day", "month"):
        got = r.rollup(facts, "org", period).agg({"total_amount": "sum", "txn_count": "sum"}).first()
        assert got["sum(total_amount)"] == sum(x[5] for x in rows)
        assert got["sum(txn_count)"] == len(rows)


def test_progress_keeps_the_mark_when_nothing_is_new(spark):
    facts, rows = _stream_like(spark)
    end = rows[-1][12]
    at_end = r.new_progress(facts, end).first()
    assert (at_end.new_mark, at_end.new_rows) == (end, 0)
    before = r.new_progress(facts, rows[-3][12]).first()
    assert (before.new_mark, before.new_rows) == (end, 2)


def test_local_days_of_a_zone(spark):
    facts = in_zone(frame(spark, [fact("2024-01-31 18:29:59"), fact("2024-01-31 18:30:00")]), "Asia/Kolkata")
    days = r.daily_rollup(facts, "customer").collect()
    assert {d.txn_date for d in days} == {dt.date(2024, 1, 31), dt.date(2024, 2, 1)}
    assert {f.txn_year_month for f in facts.collect()} == {202401, 202402}


def test_hours_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # This local hour does not exist in that zone.
        hours = r.rollup(frame(spark, [fact("2024-03-10 02:30:00")]), "customer", "hour").collect()
        assert [h.txn_hour for h in hours] == [dt.datetime(2024, 3, 10, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_single_week_digest(spark):
    rows = [fact("2024-01-01", customer="A"), fact("2024-01-07", customer="B"), fact("2024-01-08", customer="C")]
    daily = r.daily_rollup(frame(spark, rows), "customer")
    week = r.weekly_digest(daily, "customer", "2024-01-08").collect()
    assert [(w.week_end, w.unique_customers, w.total_txns) for w in week] == [(dt.date(2024, 1, 8), 2, 2)]
    both = weekly_report(daily, r.daily_rollup(frame(spark, rows), "org"), "2024-01-08").first()
    assert (both.unique_customers, both.unique_orgs, both.org_total_txns) == (2, 1, 2)


def test_range_filters_reach_the_scan_and_prune_months(spark, tmp_path):
    facts, _ = _stream_like(spark)
    path = str(tmp_path / "facts")
    facts.write.partitionBy("txn_year_month").parquet(path)
    plan = r.daily_rollup(spark.read.parquet(path), "customer", "2024-01-06")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan =="):]
    assert "PartitionFilters: [isnotnull(txn_year_month" in scan
    assert "GreaterThanOrEqual(txn_date" in scan
    assert "description" not in scan


def test_month_predicates_name_every_month_once():
    assert month_predicates("2023-11-30 12:00:00", "2024-02-01") == [
        f"txn_year_month = {m}" for m in (202311, 202312, 202401, 202402)]
    assert month_predicates("2024-05-01", "2024-05-31 23:00:00") == ["txn_year_month = 202405"]


def test_parties_with_several_labels_keep_the_greatest(spark):
    day = "2024-03-05 10:00:00"
    rows = [fact(day, "1.00", party="P", name="Ann"), fact(day, "2.50", party="P", name="Bob"), fact(day, "4.00", party="P", name=None),
            fact(day, "1.00", party="Q", name="Zoe"), fact(day, "2.00", party="Q", name="Zoe"), fact(day, "3.00", party=None, name=None),
            fact(day, "3.00", party=None, name="Eve", party_type="BANK_ACCOUNT"), fact("2024-03-06 10:00:00", party="P", name="Ann")]
    got = {(str(d.txn_date), d.counterparty_id): (d.counterparty_name, d.counterparty_type, d.txn_count, str(d.total_amount),
                                                  str(d.min_amount), str(d.max_amount), str(d.avg_amount))
           for d in r.rollup(frame(spark, rows), "customer", "day").collect()}
    assert got == {("2024-03-05", "P"): ("Bob", "WALLET", 3, "7.50", "1.00", "4.00", "2.500000"),
                   ("2024-03-05", "Q"): ("Zoe", "WALLET", 2, "3.00", "1.00", "2.00", "1.500000"),
                   ("2024-03-05", ""): ("Eve", "WALLET", 2, "6.00", "3.00", "3.00", "3.000000"),
                   ("2024-03-06", "P"): ("Ann", "WALLET", 1, "10.00", "10.00", "10.00", "10.000000")}


def test_a_rollup_does_not_sort_what_it_adds_up(spark, tmp_path):
    rows = [fact(f"2024-03-0{1 + i % 5} 10:00:00", party=f"P{i % 7}", name=f"N{i % 7}") for i in range(200)]
    frame(spark, rows).write.parquet(str(tmp_path / "facts"))
    got = r.rollup(spark.read.parquet(str(tmp_path / "facts")), "customer", "day")
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" in final and "SortAggregate" not in final and "Sort " not in final


def test_rows_of_parties_with_one_label_are_shuffled_once(spark, tmp_path):
    """Nothing but the grain deals the rows: with a join on the party, each of a few parties would be one task's."""
    rows = [fact(f"2024-03-0{1 + i % 5} 10:00:00", party=f"P{i % 2}", name=f"N{i % 2}") for i in range(200)]
    frame(spark, rows).write.parquet(str(tmp_path / "facts"))
    daily = r.rollup(spark.read.parquet(str(tmp_path / "facts")), "customer", "day")
    for got in (daily, r.month_from_days(daily, "customer")):
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_several_labels_among_many_parties(spark):
    """Parties that share a place of the bitmap with one that has several labels keep their rows as they are."""
    rows = [fact("2024-03-05 10:00:00", "1.00", party=f"P{i}", name=f"N{i}") for i in range(3000)]
    rows += [fact("2024-03-05 11:00:00", "2.00", party=f"P{i}", name=f"M{i}") for i in range(0, 3000, 3)]
    got = {d.counterparty_id: (d.counterparty_name, d.txn_count, str(d.total_amount), str(d.avg_amount))
           for d in r.rollup(frame(spark, rows), "customer", "day").collect()}
    assert got == {f"P{i}": (f"N{i}", 1, "1.00", "1.000000") if i % 3 else (f"N{i}", 2, "3.00", "1.500000") for i in range(3000)}
