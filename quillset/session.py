"""One place that builds a session with the settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "quillset", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead.

    ANSI mode, UTC and AQE are what the operators assume. ``shuffle_partitions`` is
    small here because local data are small; AQE coalesces what is too many.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSET_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
