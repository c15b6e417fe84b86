"""Tables between the phases of an operator.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, which all executors and the driver share.
Where it is unset, a local master uses a folder under /tmp/checkpoints; on a cluster, where executors and driver do not share that folder, it is an error.
"""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir"):
        return path
    master = conf.get("spark.master") or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def keep(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends there and no part is computed twice.

    With ``release``, the driver's JVM collects its garbage, so that the shuffle files of the phase that has ended can go.
    """
    spark = df.sparkSession
    path = f"{root(spark).rstrip('/')}/recordrank/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if release:
        # Spark holds on to the query that ended last, and so to its shuffle files, until another one has ended
        spark.sql("SELECT 1").collect()
        time.sleep(0.1)
        spark._jvm.System.gc()
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append((spark, path))
    return out


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``keep``, but in buckets of ``column``, one for each shuffle partition, so that grouping by it needs no shuffle."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    path = f"{root(spark).rstrip('/')}/recordrank/{unique}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).format("parquet").option("path", path).saveAsTable(unique)
    out = spark.table(unique)
    out.schema  # resolved here, so the catalog's entry can go; its files stay, as the table is external
    spark.sql(f"DROP TABLE {unique}")
    out._scratch = path
    spark._jvm.System.gc()
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append((spark, path))
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes kept tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)
            _LEFT[:] = [x for x in _LEFT if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _clear() -> None:
    for spark, path in _LEFT:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already; what is left is the cluster's to clear
            return


def shards(spark: SparkSession, least: int = 64) -> int:
    """The largest power of two within the shuffle partitions: shards that write to each other send as many messages as its square."""
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (n.bit_length() - 1)
