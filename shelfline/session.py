"""Session defaults shared by tests, the bench and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from shelfline.operators.scale import scratch_dir

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "shelfline", memory: str = "12g") -> SparkSession:
    """A single-machine session; on a cluster use the session the cluster gives you.

    Intermediate tables go to the folder that the variable SHELFLINE_SHARED_DIR names, else to a scratch
    folder that is removed at the end.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", os.environ.get("SHELFLINE_SHARED_DIR") or scratch_dir())
        .config("spark.sql.shuffle.partitions", str(cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
