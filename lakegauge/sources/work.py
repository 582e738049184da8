"""Shared scratch space: frames written once and read back, so that later steps neither recompute nor disagree.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a local session without that setting
gets a temporary folder of its own; a cluster session without it is refused, since its machines share no disk.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Root of the shared scratch space of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lakegauge-")
    return _local[app]


def fresh_path(spark: SparkSession, name: str = "frame") -> str:
    """A path in the scratch space that nothing has used yet."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "frame", compression: str | None = None) -> DataFrame:
    """The same rows read back from Parquet in the scratch space: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`written` that no later step reads."""
    spark = df.sparkSession
    jvm, root = spark.sparkContext._jvm, work_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files behind frames that nothing refers to any more.  Spark deletes them when the driver's heap is
    collected, which may not happen for a whole run; jobs of many large steps call this between them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
