"""Session defaults shared by the entry point, the bench and the tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(cpus: int | None = None, app: str = "quire") -> SparkSession:
    """A local session with the settings the tests rely on; a cluster's own session is used as it is."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it stands, whatever folder the driver was started in."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
