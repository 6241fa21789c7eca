"""Publishing intermediate tables to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a single machine that names none (tests) a temporary folder, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_nodeloom_shared", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="nodeloom-")
            spark._nodeloom_shared = base
    return base.rstrip("/")


def publish(df: DataFrame, label: str = "graph") -> DataFrame:
    """Write and read back: cuts lineage, freezes generated ids, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
