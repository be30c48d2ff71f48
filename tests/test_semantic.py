"""Guards, ranges and shares of semantic queries."""

import datetime as dt

import pytest

from facts_fixture import fact, frame
from ledgerloom.functions.periods import history_window, months_before, relative_range
from ledgerloom.operators.rollups import daily_rollup
from ledgerloom.plans import cubes
from ledgerloom.plans import semantic as sem


@pytest.fixture(scope="module")
def daily(spark):
    rows = [fact(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), amount=f"{500 * (i + 1)}.00", org=f"O{i % 3}",
                 division="" if i % 2 else "D1", party=f"P{i % 4}", name="" if i % 4 == 0 else f"Party {i % 4}",
                 status=("COMPLETED", "FAILED", "REVERSED", "INITIATED")[i % 4]) for i in range(24)]
    rows.append(fact("2024-02-01", amount="0.00", org="ZERO", fees="0.00"))
    return daily_rollup(frame(spark, rows), "org").cache()


def test_scope_is_required_and_applied(daily):
    cube = cubes.org_cube()
    with pytest.raises(PermissionError):
        sem.kpi_tiles(daily, cube)
    seen = sem.cube_query(daily, cube, ["total_amount"], ["org_id"], scope="O1").collect()
    assert [r.org_id for r in seen] == ["O1"]


def test_unknown_members_are_refused(daily):
    view = cubes.org_division_view()
    for bad in (dict(measures=["nothing"]), dict(measures=["total_amount"], dimensions=["customer_id"]),
                dict(measures=["total_amount"], segments=["nothing"])):
        with pytest.raises(ValueError):
            sem.cube_query(daily, view, scope=sem.ALL_ORGS, **bad)
    assert len(cubes.VIEW_MEMBERS) == 33


def test_shares_sum_to_one(daily):
    rows = sem.cube_query(daily, cubes.org_cube(), ["total_amount_pct", "total_txn_pct"], ["counterparty_id"],
                          scope=sem.ALL_ORGS).collect()
    assert sum(r.total_amount_pct for r in rows) == pytest.approx(1)
    assert sum(r.total_txn_pct for r in rows) == pytest.approx(1)


def test_rates_of_nothing_are_null(daily):
    row = sem.cube_query(daily, cubes.org_cube(), ["fee_rate", "success_rate"], scope="ZERO").first()
    assert row.fee_rate is None and str(row.success_rate) == "100.00"
    none = sem.kpi_tiles(daily, cubes.org_cube(), scope="nobody").first()
    assert none.success_rate is None


def test_blank_division_and_name_fall_back(daily):
    rows = sem.cube_query(daily, cubes.org_cube(), ["total_amount"], ["division_id", "counterparty_name"],
                          scope=sem.ALL_ORGS).collect()
    assert {r.division_id for r in rows} == {"ORG_LEVEL", "D1"}
    assert "P0" in {r.counterparty_name for r in rows}


def test_drill_down_adds_one_filter_per_step(daily):
    cube = cubes.org_division_view()
    top = sem.drill_down(daily, cube, scope=sem.ALL_ORGS).collect()
    assert {r.org_id for r in top} == {"O0", "O1", "O2", "ZERO"}
    divisions = sem.drill_down(daily, cube, {"org_id": "O1"}, scope="O1").collect()
    assert {(r.org_id, r.division_id) for r in divisions} == {("O1", "ORG_LEVEL"), ("O1", "D1")}
    parties = sem.drill_down(daily, cube, {"org_id": "O1", "division_id": "D1"}, scope="O1")
    days = sem.drill_down(daily, cube, {"org_id": "O1", "division_id": "D1",
                                        "counterparty_id": parties.first().counterparty_id}, scope="O1")
    assert days.columns[:4] == list(sem.DRILL_LEVELS)
    total = sum(r.total_amount for r in parties.collect())
    assert total == [r.total_amount for r in divisions if r.division_id == "D1"][0]
    with pytest.raises(ValueError):
        sem.drill_down(daily, cube, {"division_id": "D1"}, scope="O1")


def test_rollup_without_the_needed_columns_is_refused(daily):
    stored = sem.as_summary(sem.build_rollup(daily, "org_weekly_trend"), "org_weekly_trend")
    with pytest.raises(ValueError, match="avg_amount"):
        sem.cube_query(stored, cubes.org_cube(), ["avg_transaction_amount"], scope=sem.ALL_ORGS)


def test_relative_ranges():
    as_of = "2024-05-15"
    day = dt.date
    assert relative_range(("last month", "now"), as_of) == (day(2024, 4, 1), day(2024, 5, 16))
    assert relative_range("last month", as_of) == (day(2024, 4, 1), day(2024, 5, 1))
    assert relative_range(("last quarter", "now"), as_of) == (day(2024, 1, 1), day(2024, 5, 16))
    assert relative_range(("6 months ago", "now"), as_of) == (day(2023, 11, 15), day(2024, 5, 16))
    assert relative_range("this month", as_of) == (day(2024, 5, 1), day(2024, 6, 1))
    assert relative_range(("6 months ago", "3 months ago"), as_of) == (day(2023, 11, 15), day(2024, 2, 16))
    assert relative_range("last year", as_of) == (day(2023, 1, 1), day(2024, 1, 1))
    assert relative_range(("2024-01-01", "2024-03-31"), as_of) == (day(2024, 1, 1), day(2024, 4, 1))


def test_history_windows():
    now = dt.datetime(2024, 2, 29, 10, 30)
    assert months_before(now, 12) == dt.datetime(2023, 2, 28, 10, 30)
    assert history_window(now, "LAST_3_MONTHS") == (dt.datetime(2023, 11, 29, 10, 30), now)
    floor = dt.datetime(2017, 2, 28, 10, 30)
    assert history_window(now, "LAST_7_YEARS") == (floor, now)
    assert history_window(now, "CUSTOM", "2001-01-01") == (floor, now)
    assert history_window(now, "CUSTOM") == (floor, now)
    assert history_window(now, "CUSTOM", "2023-01-01", "2023-02-01")[1] == dt.datetime(2023, 2, 1)
