"""Session helpers: where intermediate tables live, and how Python workers find the package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package (also when the driver only changed ``sys.path``), and keep memory outside the
    heap small: Arrow batches of very long texts must fit in a worker. Settings that the session already has stay."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep) if env.get("PYTHONPATH") else []
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if size.rstrip("b").isdigit() and int(size.rstrip("b")) > 64 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    # Vectored reads of local files go through threads that each keep a native buffer as large as a column chunk.
    if spark.conf.get("parquet.hadoop.vectored.io.enabled", None) is None:
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary folder; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="crossloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under the application's id."""
    return f"{shared_dir(spark)}/crossloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application has stored on the way. Results that haven't been written read them, so call it last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/crossloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, compression: str = "") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
