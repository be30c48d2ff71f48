"""High-water marks of the pipelines.

The stored form is a log that only grows: every run appends one row per
pipeline, and the latest row counts. A crash can therefore never lose a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.domains import FIRST_MARK, PIPELINES
from ledgerloom.functions.periods import ts_lit
from ledgerloom.schemas import PIPELINE_MARKS


def initial_marks(spark: SparkSession, names: tuple[str, ...] = PIPELINES) -> DataFrame:
    rows = [(name,) for name in names]
    return spark.createDataFrame(rows, "pipeline_name string").select(
        "pipeline_name", ts_lit(FIRST_MARK).alias("last_processed_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit(0).cast("bigint").alias("records_processed"),
    )


def seed_marks(existing: DataFrame) -> DataFrame:
    """Existing marks plus a first mark for every pipeline that has none; repeating it changes nothing."""
    missing = initial_marks(existing.sparkSession).join(existing, "pipeline_name", "left_anti")
    return existing.unionByName(missing)


def marks_for(existing: DataFrame, names: tuple[str, ...] = PIPELINES) -> DataFrame:
    """Mark of each named pipeline, the default one where nothing is stored."""
    wanted = existing.sparkSession.createDataFrame([(n,) for n in names], "pipeline_name string")
    return wanted.join(existing.select("pipeline_name", "last_processed_at"), "pipeline_name", "left").select(
        "pipeline_name", F.coalesce("last_processed_at", ts_lit(FIRST_MARK)).alias("last_processed_at"))


def advance_marks(marks: DataFrame, progress: DataFrame, run_at) -> DataFrame:
    """Marks after a run.

    ``progress`` has one row per pipeline that ran: pipeline_name, new_mark
    (null keeps the old mark) and new_rows, which is added to the total. The
    run time is set even when nothing was new.
    """
    ran = progress.select("pipeline_name", "new_mark", "new_rows", F.lit(True).alias("ran"))
    return marks.join(ran, "pipeline_name", "left").select(
        "pipeline_name",
        F.coalesce("new_mark", "last_processed_at").alias("last_processed_at"),
        F.when(F.col("ran"), ts_lit(run_at)).otherwise(F.col("last_run_at")).alias("last_run_at"),
        (F.col("records_processed") + F.coalesce("new_rows", F.lit(0))).cast("bigint").alias("records_processed"),
    )


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Latest mark of each pipeline in the log."""
    latest = F.max_by(F.struct("last_processed_at", "last_run_at", "records_processed"),
                      F.struct("last_run_at", "records_processed")).alias("m")
    return spark.read.schema(PIPELINE_MARKS).parquet(path).groupBy("pipeline_name").agg(latest).select(
        "pipeline_name", "m.last_processed_at", "m.last_run_at", "m.records_processed")


def append_marks(marks: DataFrame, path: str) -> None:
    marks.coalesce(1).write.mode("append").parquet(path)
