"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "gaugeline", shuffle_partitions: int | None = None,
                  **conf) -> SparkSession:
    """A session with AQE (coalescing, skew-join splitting, runtime broadcast) and UTC time."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return compiled(spark)


def compiled(spark: SparkSession) -> SparkSession:
    """Generated methods of more than 8000 bytes are never compiled by the JVM and run interpreted, row by row: such stages take
    Spark's split form instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder for written stages: what the cluster names in `spark.checkpoint.dir`. Without that setting a local
    folder is used on a local master (removed when the process ends); on a cluster, where executors do not share local
    folders, the job stops with an error instead of losing rows."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root()


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="gaugeline-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below `shared_root`."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write the table once to the shared folder and read it back. A lost executor re-reads files instead
    of re-running the job, later passes prune columns, and the true size is known to every later choice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
