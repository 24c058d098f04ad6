"""Session construction and table access shared by every plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the plans assume: UTC, adaptive execution, Arrow for the NumPy kernels."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table, and bytes of a shuffle, for one task: what it sorts or hashes stays at some hundred MB at every size of the table.
ROWS, BYTES = 500_000, "8m"


def deal(df: DataFrame) -> DataFrame:
    """df, a table; the session's shuffles get a partition for each ROWS of its rows at least, and small ones are put together up to BYTES, unless the session says how far."""
    conf = df.sparkSession.conf
    most = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if conf.get(most, None) is None:
        conf.set(most, BYTES)
    need = -(-df.count() // ROWS)  # from the files' footers
    if need > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", need)
    return df
