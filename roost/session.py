"""Session settings of the jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "roost", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs and tests; on a cluster use the session the cluster gives."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ROOST_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
