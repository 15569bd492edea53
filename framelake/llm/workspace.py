"""Where jobs keep what must outlive an executor, and how inputs are measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java_dir.get() if java_dir.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="framelake-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def executor_bytes(spark: SparkSession) -> int:
    """Heap of an executor, by which the sizes of what Python workers beside it hold are chosen."""
    conf, local = spark.sparkContext.getConf(), spark.sparkContext.master.startswith("local[")
    said = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(said[-1])
    return int(said[:-1]) * unit if unit else int(said) << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
