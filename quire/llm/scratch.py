"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder the session names; one of our own only where it names none on a single machine, as in tests."""
    at = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set(SETTING, at)
    return at.rstrip("/")


def write(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: its lineage ends there, so a lost executor repeats only what follows."""
    spark = df.sparkSession
    path = f"{folder(spark)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of write() that no later step reads."""
    path = getattr(df, "_quire_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
