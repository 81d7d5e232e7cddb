"""Session construction shared by the tests, the benchmark and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects of any cluster.

    Only the master and the partition count are local choices; everything else
    (UTC timestamps, adaptive execution, skew-join splitting) is what a cluster
    deployment should set too.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrygraph")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
