"""Sessions with the settings that the engine is measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", app: str = "cairn", **conf: str) -> SparkSession:
    """A local session; on a cluster, pass the same settings to spark-submit."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
