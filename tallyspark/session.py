"""Session defaults shared by tests, the benchmark and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tallyspark", cores: str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC time, ANSI casts and adaptive execution.

    On a cluster build the session with the cluster's own settings; the engine only relies on
    ``spark.sql.session.timeZone=UTC`` and on adaptive execution.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
