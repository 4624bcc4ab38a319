"""What a session needs before Python runs on executors, and tables that stages leave in the shared folder."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that a Python worker gets at a time, unless the session says otherwise.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def reach(spark: SparkSession) -> SparkSession:
    """Puts this package's folder on the Python path of the workers, where they see the same folder (one machine, a shared
    installation). On other clusters the package is installed or sent with --py-files, and this changes nothing. Also bounds
    the bytes that workers get at a time, where the session doesn't, since texts may be long."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH))
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where that is unset
    and everything runs in one process (tests) a local one is set; on a cluster it is an error, as executors wouldn't see
    each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/tessera")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
