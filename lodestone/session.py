"""Sessions with the settings the engine is tuned for, and the folder their jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session in UTC with AQE on.

    `conf` uses underscores for dots, e.g. `spark_sql_shuffle_partitions="8"`.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_written: list[tuple[str, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, a temporary one in local sessions only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-index-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; see `release`."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again, so it is made once; see `release`."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the session's scratch tables; results not yet read are lost."""
    own = [x for x in _written if x[0] == spark.sparkContext.applicationId]
    for item in own:
        _written.remove(item)
        folder = spark._jvm.org.apache.hadoop.fs.Path(item[1])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
