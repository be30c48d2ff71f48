"""The streaming dunning state agrees with the batch one, and timers move held cycles on."""

import datetime as dt
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from ledgerloom.operators.settlement import dunning_state
from ledgerloom.streaming.dunning import DunningProcessor, dunning_stream
from ledgerloom.streaming.state import STATE_PROVIDER

SCHEMA = "subscription_id string, cycle_start date, attempted_at timestamp_ntz, succeeded boolean"
START = dt.datetime(2024, 1, 1, 9)


def _attempts():
    day = START.date()
    rows = [("held", day, START + dt.timedelta(hours=h), False) for h in (0, 24, 48, 72)]
    rows += [("retrying", day, START + dt.timedelta(hours=h), False) for h in (0, 24)]
    rows += [("paid", day, START, False), ("paid", day, START + dt.timedelta(hours=24), True)]
    return rows


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_PROVIDER)
    yield
    spark.conf.set(name, before)


def test_timers_pause_and_cancel(spark, rocksdb, tmp_path):
    source = str(tmp_path / "in")
    batches = [_attempts()] + [
        [("clock", START.date(), START + dt.timedelta(days=d), True)] for d in (5, 12, 13, 40, 41)]
    seen = []
    query = None
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = dunning_stream(stream).writeStream.outputMode("update").foreachBatch(
            lambda b, _: seen.extend(b.collect())).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    by_subscription = {}
    for row in seen:
        by_subscription.setdefault(row.subscription_id, []).append(row.state)
    assert by_subscription["held"] == ["HELD", "PAUSED", "CANCELLED"]
    assert by_subscription["retrying"] == ["RETRYING"]
    assert by_subscription["paid"] == ["PAID"]

    attempts = spark.createDataFrame(_attempts(), SCHEMA)
    for day, expected in ((5, "HELD"), (12, "PAUSED"), (40, "CANCELLED")):
        state = {r.subscription_id: r.state for r in dunning_state(attempts, START + dt.timedelta(days=day)).collect()}
        assert state == {"held": expected, "retrying": "RETRYING", "paid": "PAID"}


def test_workers_do_not_need_the_package(tmp_path):
    body = tmp_path / "processor.pickle"
    body.write_bytes(cloudpickle.dumps(DunningProcessor()))
    code = ("import sys, pickle; found = pickle.load(open(sys.argv[1], 'rb')); "
            "assert 'ledgerloom' not in sys.modules; print(type(found).__name__)")
    done = subprocess.run([sys.executable, "-c", code, str(body)], cwd=tmp_path, capture_output=True, text=True,
                          timeout=120)
    assert done.stdout.strip() == "DunningProcessor", done.stderr


def test_cycles_of_a_month_share_their_state(spark, rocksdb, tmp_path):
    """Cycles of one subscription stay apart, timers of the same time too; rows without a result or a time are taken in."""
    first, second = START.date(), START.date() + dt.timedelta(days=1)
    late = START + dt.timedelta(hours=72)
    held = [("s", day, late - dt.timedelta(hours=h), False) for day in (first, second) for h in (0, 1, 2, 3)]
    odd = [("odd", None, None, False)] * 4 + [("odd", first, START, None), (None, first, START, True)]
    batches = [held + odd, [("s", second, late, True)], [("clock", first, START + dt.timedelta(days=12), True)],
               [("clock", first, START + dt.timedelta(days=13), True)]]
    source, seen = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        dunning_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    states = {}
    for row in seen:
        states.setdefault((row.subscription_id, row.cycle_start), []).append((row.state, row.failures))
    states.pop(("clock", first))
    assert states == {("s", first): [("HELD", 4), ("PAUSED", 4)], ("s", second): [("HELD", 4), ("PAID", 4)],
                      ("odd", None): [("HELD", 4)], ("odd", first): [("RETRYING", 0)], (None, first): [("PAID", 0)]}
    assert [r.changed_at for r in seen if r.state == "PAUSED"] == [late + dt.timedelta(days=7)]
