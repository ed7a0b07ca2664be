"""Tables that outlive a job: written once in the folder all executors share, so nothing is asked for or computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set and all runs on one machine, a fresh one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-tables-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quire-tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "rows", compression: str | None = None) -> DataFrame:
    """``df`` written as a table and read back; without ``compression`` the session's codec is taken."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> None:
    """Deletes this application's kept tables; call it once the results that read them are written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quire-tables-{spark.sparkContext.applicationId}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
