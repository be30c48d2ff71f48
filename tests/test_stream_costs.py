"""What a stream does once for each message, and not more often."""

import glob

from pyspark.sql import functions as F

from ledgerloom.catalog import streaming_queries
from ledgerloom.operators.enrichment import route
from ledgerloom.sources.messages import parse_events
from ledgerloom.streaming.state import rocksdb_state


def test_a_condition_on_an_event_does_not_parse_the_message_again(spark):
    messages = spark.createDataFrame([('{"eventId": "E1", "sourceType": "ENTERPRISE"}',), ("{not json",), (None,)], "value string")
    events = parse_events(messages, keep_text=True)
    kept = route(events).filter("route != 'dead_letter'").select("route", "event_id")
    assert [tuple(r) for r in kept.collect()] == [("org", "E1")]
    assert events.filter("event_id is null").count() == 2
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_messages_come_in_two_halves_that_all_tasks_write(spark, tmp_path):
    files = streaming_queries._in_two_batches(spark, spark.range(1000).select(F.col("id").cast("string").alias("value")), f"{tmp_path}/in")
    assert len(glob.glob(f"{tmp_path}/in/part-*")) == 2 * files >= spark.sparkContext.defaultParallelism
    assert spark.read.text(f"{tmp_path}/in").count() == 1000


def test_stores_of_an_executor_share_a_bound_of_memory(spark, tmp_path):
    """Each store would have buffers of its own outside the heap, up to 128 MB, and an executor has hundreds of stores."""
    prefix = "spark.sql.streaming.stateStore.rocksdb."
    with rocksdb_state(spark):
        assert spark.conf.get(f"{prefix}boundedMemoryUsage") == "true"
        assert int(spark.conf.get(f"{prefix}maxMemoryUsageMB")) <= 400
        assert int(spark.conf.get(f"{prefix}writeBufferSizeMB")) <= 2
        spark.range(1000).write.parquet(f"{tmp_path}/in")
        query = (spark.readStream.schema("id long").parquet(f"{tmp_path}/in").groupBy("id").count().writeStream.outputMode("update")
                 .format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    assert spark.conf.get(f"{prefix}boundedMemoryUsage", "unset") == "unset"
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1000
