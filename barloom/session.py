"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees, from ``spark.checkpoint.dir``.

    Only a ``local[...]`` master, where driver and executors share one machine, may fall back to a
    temporary folder; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    path = "file://" + tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame, name: str = "stage", *by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    Cuts lineage like ``checkpoint()`` but stays columnar, so later reads prune columns, and files if
    it is partitioned ``by`` columns. The files
    survive lost executors; they are deleted when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is already gone
            pass


def share(spark: SparkSession, value):
    """Broadcast an object of bounded size with its class; workers read it by ``pickle.loads(b.value)``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over a fixed number of tasks, for groups that Python workers take:
    adaptive coalescing goes by bytes and would put many costly groups of few bytes into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
