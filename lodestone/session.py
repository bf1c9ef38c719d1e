"""Session helper for tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(cores: str | int = 8, app: str = "lodestone") -> SparkSession:
    """The running session, or a new one.  Under spark-submit master, memory and partitions are the submitter's; plain Python gets a local session."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # set by spark-submit
        local = {
            "spark.master": f"local[{cores}]",
            "spark.driver.memory": os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
        builder = builder.config(map=local)
    return builder.getOrCreate()
