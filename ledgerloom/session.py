"""Session settings and the shared working folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job here relies on. Shuffle partition counts are left
# to the cluster: AQE coalesces small ones and splits skewed join partitions.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", app: str = "ledgerloom", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a fresh
    temporary folder, remembered in the session for later calls.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    remembered = spark.conf.get("ledgerloom.local.dir", None)
    if remembered:
        return remembered
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    fresh = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("ledgerloom.local.dir", fresh)
    return fresh


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def staging_dir(spark: SparkSession, purpose: str, target: str) -> str:
    """The one working folder of a table. Each publication overwrites it, so it never outgrows one run."""
    digest = hashlib.sha256(target.rstrip("/").encode()).hexdigest()[:24]
    return f"{shared_dir(spark)}/{purpose}-{digest}"
