"""Session factory and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the submitted configuration wins."""
    builder = SparkSession.builder.appName("sylva")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SYLVA_DRIVER_MEMORY", "8g"),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark only, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session without one gets a temporary one, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_sylva_shared", None) or tempfile.mkdtemp(prefix="spark-sylva-")
        spark._sylva_shared = at
    return at.rstrip("/")


def tables_written(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session's operators have written and not dropped, oldest first."""
    if not hasattr(spark, "_sylva_written"):
        spark._sylva_written = []
    return spark._sylva_written


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tables_written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Drop the tables written since so many, but for the last ones; what still reads them must be done or written itself."""
    tables = tables_written(spark)
    gone = tables[since : len(tables) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        tables.remove(path)
