"""Tables between the phases of a plan, in the folder that the cluster names in ``spark.checkpoint.dir``.

Off local masters the folder must be set, as the driver and all executors share it. Tables are deleted when the process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    path, master = conf.get("spark.checkpoint.dir"), conf.get("spark.master") or ""
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(path or '/tmp/checkpoints').rstrip('/')}/recordrank"


def folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own, deleted when the process ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for spark, path in _LEFT:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended already; what is left is the cluster's to clear
            return
