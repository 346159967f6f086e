"""A session with the settings the library expects: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only a local session without it gets a temporary folder."""
    import tempfile

    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local[app]


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table of the shared folder: cuts the lineage of rounds, and survives a lost executor. With `options` of the writer."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, mb: float = 8) -> int:
    """How many tasks an exchange of df's rows should have: one for every `mb` MB of the files it reads, so that a task's sort doesn't grow with the input."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / (mb * 2**20)))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
