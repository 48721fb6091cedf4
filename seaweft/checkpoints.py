"""Durable intermediate tables in the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new temporary folder if the executors are threads of this machine, as in
    tests; on a cluster, where others couldn't read it, an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seaweft-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it.

    Unlike checkpoint(), which hands on the planner's estimates (each join multiplies them, so that a loop of joins soon
    has numbers of a million digits), the table has its true size, by which Spark decides on broadcasts.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
