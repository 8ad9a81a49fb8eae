"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # P-05: malformed UTF-16 becomes U+FFFD instead of failing the query
    "spark.sql.legacy.codingErrorAction": "true",
    # HotSpot does not compile methods over 8000 bytes; wide rule predicates run
    # faster in split methods than in one that stays interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# file sizes say little about rows (compression, explode, checkpoints), so a broadcast without a hint is
# decided by sizes measured at run time, not by the planner's estimates
MEASURED_BROADCASTS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}


def configure(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "wardline", memory: str = "12g",
                  shuffle_partitions: str = "8") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session that names none gets a private one; on a cluster an
    unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="wardline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    ``DataFrame.checkpoint`` hands on the size estimate of the plan it cuts.  In a loop that joins a table with
    itself that number is squared every round, until the digits alone fill the driver.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/checkpoint-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    back = spark.read.schema(df.schema).parquet(folder)
    back._folder = folder
    return back


def forget(*frames: DataFrame) -> None:
    """Remove the files of ``checkpoint`` tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
