"""Session settings the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", name: str = "flowloom", **conf: str) -> SparkSession:
    """A local session for tests and timings.

    On a cluster the session comes from ``spark-submit``; nothing here is
    needed then, except that adaptive execution stays on (its default) so that
    skewed joins are split and small shuffles are coalesced.
    """
    parallelism = str(os.cpu_count() if cpus == "*" else cpus)
    settings = {
        "spark.sql.shuffle.partitions": parallelism,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
