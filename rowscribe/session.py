"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rowscribe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; an active one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Where the session names none, a folder in the warehouse is used. A local path is an
    error there unless the master is local, as executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if path.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never used path below the shared folder."""
    return f"{shared_dir(spark)}/rowscribe/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """How many ranges a global order is cut into: follows the shuffle width."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys to as many tasks as an order has ranges. For costly work
    on each row, as a compact file is read by few tasks however wide the cluster is."""
    return df.repartition(bucket_count(df.sparkSession), *keys)
