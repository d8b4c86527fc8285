"""Where cut lineage and intermediate tables go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``df``, written once as a table in the shared folder, where a lost executor does not lose it.

    ``paths`` gathers what the caller removes when it is done; else it goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    else:
        atexit.register(_try_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _try_remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)
