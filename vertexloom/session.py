"""Session for local use; on a cluster the operators take whatever session they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vertexloom")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
