"""Jobs publish the same summaries however often and in however many pieces they run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from facts_fixture import fact, frame, plain
from ledgerloom.operators import rollups as r
from ledgerloom.operators import upsert as u
from ledgerloom.plans import jobs, semantic
from ledgerloom.plans.cubes import org_cube
from ledgerloom.sources import marks as mk

START = dt.datetime(2024, 1, 5, 22)


def _facts(spark, count=80, step=11):
    return frame(spark, [
        fact(START + dt.timedelta(minutes=step * i), amount=f"{i}.50", customer=f"C{i % 4}", org=f"O{i % 2}",
             division=f"D{i % 3}" if i % 3 else None, party=f"P{i % 5}", transfer=f"T{i}",
             status=("COMPLETED", "FAILED", "PENDING_PAYMENT")[i % 3]) for i in range(count)])


def _measures(df):
    return plain(df.drop("refreshed_at", "txn_day", "txn_year_month", "period_partition"))


def test_hourly_runs_in_pieces_equal_one_run(spark, tmp_path):
    facts = _facts(spark)
    path, marks = str(tmp_path / "hourly"), str(tmp_path / "marks")
    for minutes in (95, 100, 400, 2000):
        seen = facts.filter(F.col("txn_date") <= F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz"))
        jobs.run_hourly(seen, "customer", path, marks, "2024-01-08 00:00:00")
    assert _measures(spark.read.parquet(path)) == _measures(r.rollup(facts, "customer", "hour"))
    assert jobs.run_hourly(facts, "customer", path, marks, "2024-01-08 00:15:00") == 0
    assert _measures(spark.read.parquet(path)) == _measures(r.rollup(facts, "customer", "hour"))
    mark = mk.read_marks(spark, marks).first()
    assert mark.records_processed == 80
    assert mark.last_run_at == dt.datetime(2024, 1, 8, 0, 15)


def test_lookback_picks_up_a_late_row(spark, tmp_path):
    facts = _facts(spark)
    path, marks = str(tmp_path / "hourly"), str(tmp_path / "marks")
    jobs.run_hourly(facts, "customer", path, marks, "2024-01-08")
    late = facts.unionByName(frame(spark, [fact(START + dt.timedelta(hours=12, minutes=1), customer="LATE")]))
    jobs.run_hourly(late, "customer", path, marks, "2024-01-08", lookback_hours=0)
    assert spark.read.parquet(path).filter("customer_id = 'LATE'").count() == 0
    jobs.run_hourly(late, "customer", path, marks, "2024-01-08")
    assert _measures(spark.read.parquet(path)) == _measures(r.rollup(late, "customer", "hour"))


def test_daily_run_twice_equals_once_and_clears_an_emptied_day(spark, tmp_path):
    facts = _facts(spark)
    path, marks = str(tmp_path / "daily"), str(tmp_path / "marks")
    for _ in range(2):
        for day in ("2024-01-06", "2024-01-07"):
            jobs.run_daily(facts, "org", path, marks, day)
    assert _measures(spark.read.parquet(path)) == _measures(r.daily_rollup(facts, "org"))
    kept = facts.filter("to_date(txn_date) <> '2024-01-06'")
    jobs.run_daily(kept, "org", path, marks, "2024-01-07")
    assert _measures(spark.read.parquet(path)) == _measures(r.daily_rollup(kept, "org"))


def test_monthly_from_days_equals_monthly_from_facts(spark, tmp_path):
    facts = _facts(spark)
    marks = str(tmp_path / "marks")
    jobs.run_monthly(facts, "org", str(tmp_path / "a"), marks, "2024-02-01")
    jobs.run_monthly(r.daily_rollup(facts, "org"), "org", str(tmp_path / "b"), marks, "2024-02-01", from_daily=True)
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    assert _measures(a) == _measures(b) == _measures(r.rollup(facts, "org", "month"))


def test_backfill_writes_few_files_per_period(spark, tmp_path):
    rows = [fact(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), customer=f"C{i % 50}") for i in range(480)]
    daily = r.daily_rollup(frame(spark, rows).repartition(8), "customer")
    path = tmp_path / "daily"
    u.replace_periods(daily, str(path), "txn_date")
    files = [p for p in path.glob("txn_date=*/*.parquet")]
    assert len(files) == 20
    assert _measures(spark.read.parquet(str(path))) == _measures(daily)


def test_upsert_replaces_by_key_and_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, day date, v int"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    u.upsert(spark.createDataFrame([("a", d1, 1), ("b", d1, 1), ("c", d2, 1)], schema), path, ["k", "day"], "day")
    untouched = sorted(p.name for p in (tmp_path / "t" / "day=2024-01-02").iterdir())
    u.upsert(spark.createDataFrame([("a", d1, 2), ("z", d1, 2)], schema), path, ["k", "day"], "day")
    assert plain(spark.read.parquet(path), "k", "day", "v") == [
        ("a", "2024-01-01", "2"), ("b", "2024-01-01", "1"), ("c", "2024-01-02", "1"), ("z", "2024-01-01", "2")]
    assert sorted(p.name for p in (tmp_path / "t" / "day=2024-01-02").iterdir()) == untouched


def test_failed_publish_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    schema = "k string, day date, v int"
    day = dt.date(2024, 1, 1)
    u.upsert(spark.createDataFrame([("a", day, 1)], schema), path, ["k", "day"], "day")
    fresh = spark.createDataFrame([("a", day, 2), ("b", day, 2)], schema)
    with monkeypatch.context() as patch:
        def crash(*_):
            raise RuntimeError("lost")
        patch.setattr(u, "finish_publish", crash)
        with pytest.raises(RuntimeError):
            u.upsert(fresh, path, ["k", "day"], "day")
    assert plain(spark.read.parquet(path), "k", "v") == [("a", "1")]
    u.upsert(fresh, path, ["k", "day"], "day")
    assert plain(spark.read.parquet(path), "k", "v") == [("a", "2"), ("b", "2")]


@pytest.mark.parametrize("name", ["org_weekly_trend", "org_monthly_summary", "org_status_quarterly"])
def test_refreshed_rollup_equals_a_full_build(spark, tmp_path, name):
    long = frame(spark, [
        fact(dt.datetime(2023, 12, 20) + dt.timedelta(days=i), amount=f"{i}.00", org=f"O{i % 2}") for i in range(60)])
    daily = r.daily_rollup(long, "org")
    path = str(tmp_path / name)
    jobs.rebuild_rollup(daily, name, path)
    assert _measures(spark.read.parquet(path)) == _measures(semantic.build_rollup(daily, name))
    changed = long.filter("not (to_date(txn_date) = '2024-01-30')")
    new_daily = r.daily_rollup(changed, "org")
    jobs.refresh_rollup(new_daily, name, path, "2024-01-30", "2024-01-30")
    stored = spark.read.parquet(path)
    assert _measures(stored) == _measures(semantic.build_rollup(new_daily, name))


@pytest.mark.parametrize("name", [n for n, s in semantic.ROLLUPS.items() if s.subject == "org"])
def test_rollup_reaggregates_to_the_base(spark, name):
    daily = r.daily_rollup(_facts(spark), "org")
    stored = semantic.as_summary(semantic.build_rollup(daily, name), name)
    measures = ["total_transactions", "total_amount", "success_rate", "total_amount_pct"]
    ask = dict(measures=measures, dimensions=["org_id", "status"], scope=semantic.ALL_ORGS)
    assert plain(semantic.cube_query(stored, org_cube(), **ask)) == plain(
        semantic.cube_query(daily, org_cube(), **ask))


def test_refresh_intervals():
    assert jobs.refresh_due("org_daily_detail", "2024-01-01 00:00:00", "2024-01-01 00:30:00")
    assert not jobs.refresh_due("org_party_monthly", "2024-01-01 00:00:00", "2024-01-01 00:30:00")


def test_quality_job_turns_a_broken_check_into_an_error_row(spark, tmp_path):
    facts = _facts(spark)
    daily = r.daily_rollup(facts, "customer")
    result = jobs.run_quality(spark, facts, facts.drop("org_id"), daily, r.daily_rollup(facts, "org"),
                              str(tmp_path / "none"), "2024-01-07").collect()
    status = {row.check_name: row.status for row in result}
    assert status["null_org_ids"] == "ERROR"
    assert status["null_customer_ids"] == "PASS"
    assert status["summary_vs_raw_totals"] == "PASS"
    assert status["stale_watermarks"] == "FAIL"
    from ledgerloom.operators import quality
    with pytest.raises(ValueError, match="null_org_ids"):
        quality.require_passed(spark.createDataFrame(result, quality.CHECK_SCHEMA))
