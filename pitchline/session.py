"""Session helpers: a tuned local session and fault-tolerant lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", app: str = "pitchline") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where driver and executors are one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="pitchline-ckpt-")
        sc.setCheckpointDir(named)
    return named or os.path.dirname(sc.getCheckpointDir())


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in reliable storage, so that a lost executor costs a re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The same for a table as large as the input, in compressed columns and folders by ``by``.

    It stays in the shared folder until that is cleared.
    """
    spark, path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # else shuffle files that nobody reads again stay until the driver collects its garbage
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
