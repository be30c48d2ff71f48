"""Hourly summaries kept up to date by a stream of facts, however late a fact arrives.

A batch is summed up by hour on its own, and its sums are folded into the stored rows of the hours it touches. No
watermark decides what is too late and no state grows with the stream: what an hour holds so far is
its stored row. Each row remembers the last batch it took in, so a batch that is run again counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.periods import day_of
from ledgerloom.operators.rollups import grain_keys, rollup
from ledgerloom.operators.upsert import fold
from ledgerloom.schemas import AVERAGE, TOTAL
from ledgerloom.session import configure

_MARKS = ["stream_id", "batch_id"]


def fold_batch(batch: DataFrame, subject: str, path: str, batch_id: int, stream_id: str) -> None:
    """Add a batch of facts to the hourly table; only the days that it touches are read and written."""
    keys = grain_keys(subject, "hour")
    sums = rollup(batch, subject, "hour").withColumns({
        "txn_day": day_of("txn_hour"), "stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id).cast("bigint")})

    def combined(old: DataFrame, new: DataFrame) -> DataFrame:
        other = F.col("stream_id") != stream_id
        refused = F.when(other, F.raise_error(F.lit("the hourly table belongs to another stream")))
        known = old.withColumn("_taken", F.coalesce(refused.cast("boolean"), F.col("batch_id") == batch_id))
        fresh = new.join(known.filter("_taken").select(*keys), keys, "left_anti")
        rows = known.drop("_taken").unionByName(fresh)
        merged = rows.groupBy("txn_day", *keys).agg(
            *[F.max(c).alias(c) for c in ("counterparty_name", "counterparty_type", *_MARKS)], F.sum("txn_count").alias("txn_count"),
            *[F.sum(c).cast(TOTAL).alias(c) for c in ("total_amount", "total_fees", "total_net_amount")],
            F.min("min_amount").alias("min_amount"), F.max("max_amount").alias("max_amount"))
        return merged.withColumn("avg_amount", (F.col("total_amount") / F.col("txn_count")).cast(AVERAGE))

    fold(sums, path, "txn_day", combined)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """The hourly table without its own columns."""
    return spark.read.parquet(path).drop("txn_day", *_MARKS)


def start_hourly(facts: DataFrame, subject: str, path: str, checkpoint: str, available_now: bool = False,
                 trigger: str = "15 minutes") -> StreamingQuery:
    """Fold every batch of the fact stream into the table, which belongs to this stream alone."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = configure(batch.sparkSession)
        facts_of_batch = batch.persist()
        try:
            fold_batch(facts_of_batch, subject, path, batch_id, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        finally:
            facts_of_batch.unpersist()

    configure(facts.sparkSession)
    writer = facts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
