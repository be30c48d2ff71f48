"""Ordered calculations agree with plain loops, also when one key holds most rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import running
from ledgerloom.operators.running import previous_value, row_numbers, running_sum

SCHEMA = "k string, at timestamp_ntz, id int, v int"


def _rows():
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        # Coarse times make many equal ones; the id breaks ties.
        at = start + dt.timedelta(minutes=30 * rng.randrange(200))
        rows.append((key, at, i, rng.randrange(-50, 50)))
    return rows


def _by_key(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


def test_running_sum(spark):
    rows = _rows()
    expected = {}
    for group in _by_key(rows).values():
        total = 0
        for row in group:
            total += row[3]
            expected[row[2]] = total
    got = running_sum(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], F.col("v"), "s")
    assert {r.id: r.s for r in got.collect()} == expected


def test_row_numbers_newest_first(spark):
    rows = _rows()
    expected = {r[2]: i + 1 for g in _by_key(rows).values() for i, r in enumerate(reversed(g))}
    got = row_numbers(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], "n", descending=True)
    assert {r.id: r.n for r in got.collect()} == expected


def test_previous_value(spark):
    rows = _rows()
    expected = {}
    for group in _by_key(rows).values():
        before = None
        for row in group:
            expected[row[2]] = before
            before = row[3]
    got = previous_value(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], "v", "p")
    assert {r.id: r.p for r in got.collect()} == expected


def test_one_key_in_one_instant_is_spread_over_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "fresh_dir", lambda *_: str(tmp_path / "ranges"))
    at = dt.datetime(2024, 1, 1)
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(at).alias("at"), F.col("id").cast("int").alias("id"), F.lit(1).alias("v"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # this little data would go to one task
    try:
        got = running_sum(df, ["k"], ["at", "id"], F.col("v"), "s")
    finally:
        spark.conf.set(setting, "true")
    assert got.filter("s <> id + 1").count() == 0
    ranges = spark.read.parquet(str(tmp_path / "ranges")).filter("NOT _end")
    sizes = [r["count"] for r in ranges.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000


def test_rows_are_not_shuffled_again_when_the_ranges_are_linked(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    for got in (running_sum(df, ["k"], ["at", "id"], F.col("v"), "s"), previous_value(df, ["k"], ["at", "id"], "v", "p")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows_side, ranges_side = plan.split("BroadcastExchange")
        assert "BroadcastHashJoin" in rows_side and "Exchange" not in rows_side and "Sort" not in rows_side
        assert "IsNotNull(_end), EqualTo(_end,true)" in ranges_side


def test_sums_of_decimals_and_nulls(spark):
    rows = [("a", 1, None), ("a", 2, "0.10"), ("a", 3, None), ("a", 4, "-3.25"), (None, 1, "99999999999999.99"), (None, 2, "0.01"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, t string").withColumn("v", F.col("t").cast("decimal(18,2)"))
    got = {(r.k, r.i): None if r.s is None else str(r.s) for r in running_sum(df, ["k"], ["i"], F.col("v"), "s").collect()}
    assert got == {("a", 1): None, ("a", 2): "0.10", ("a", 3): "0.10", ("a", 4): "-3.15", (None, 1): "99999999999999.99",
                   (None, 2): "100000000000000.00", ("b", 1): None}
    assert running_sum(df.limit(0), ["k"], ["i"], F.col("v"), "s").collect() == []


def test_a_sum_beyond_64_bits_is_refused(spark):
    df = spark.range(3).select(F.lit("a").alias("k"), "id", F.lit(9_000_000_000_000_000_000).alias("v"))
    with pytest.raises(Exception, match="64 bits|OVERFLOW"):
        running_sum(df, ["k"], ["id"], F.col("v"), "s").collect()
