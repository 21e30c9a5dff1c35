"""Session factory with the settings every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Exactness and time-zone settings; they hold on a laptop and on a cluster.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "folio", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the cluster's own session to the operators."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = PINNED | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
