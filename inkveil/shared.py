"""Folders that the driver and all executors share, for tables that cut a plan's lineage; rows spread over tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    A local session without either gets a temporary folder, removed at exit; any other must name one, for a folder of
    one machine would hold only what that machine wrote.
    """
    context = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        folder = tempfile.mkdtemp(prefix="inkveil-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + folder
    return _OWN[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """The name of a fresh folder there. What it holds is deleted when the session's JVM ends, also after ``stop()``."""
    path = f"{shared_root(spark).rstrip('/')}/inkveil-{uuid.uuid4().hex}"
    system, target = file_system(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path + "/table"


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_dir` once nothing reads it any more; the others stay."""
    system, target = file_system(spark, path.removesuffix("/table"))
    system.delete(target, True)
    system.cancelDeleteOnExit(target)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage as Parquet and read it back: the lineage ends there, and a lost executor costs a
    re-read instead of a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by a key if fewer tasks than there are cores would have any, as with a file of a few row groups.

    Tasks with rows are counted first, which takes no column.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return rows
    return rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
