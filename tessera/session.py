"""Session builder shared by the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tessera", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with AQE; on a cluster, use the session the cluster gives."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
