"""Session settings that the engine relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine; a cluster's own session only needs the UTC time zone."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyforge")
    memory = {"spark.driver.memory": os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g")}
    for key, value in (CONF | memory | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder the driver was started in.

    On a cluster the folder has to be shared, or the package installed or sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
