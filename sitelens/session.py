"""Session defaults shared by scripts, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "sitelens") -> SparkSession:
    """A local session with the settings every operator assumes: UTC, ANSI, AQE.

    On a cluster build the session yourself; nothing in the library sets a master.
    """
    return (
        SparkSession.builder.master(os.environ.get("SITELENS_MASTER", f"local[{cores}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
