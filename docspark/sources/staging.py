"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Folders written and not yet released, oldest first.
_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders for the values of ``by``, and read it back.

    Later jobs start from these files, so an executor lost afterwards costs a
    re-read, and a plan used several times runs once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _folders.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _folders:
        _folders.remove(folder)


def mark() -> int:
    """A point in the list of staged tables, for ``release_since``."""
    return len(_folders)


def release(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later job reads: what was made of them is written."""
    for t in tables:
        _delete(t.sparkSession, t._folder)


def release_since(point: int, spark: SparkSession, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the tables staged since ``point`` but those in ``keep``."""
    kept = {t._folder for t in keep}
    for folder in [f for f in _folders[point:] if f not in kept]:
        _delete(spark, folder)


def spread(df: DataFrame) -> DataFrame:
    """A small table in few files is dealt out over the cores; any other stays as it is.

    Parquet is split between row groups only, so a small table is often read by
    one task, with all work that follows. Small means less than one split
    (``spark.sql.files.maxPartitionBytes``) for each core, few at most one file
    for two cores.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * split and 2 * len(df.inputFiles()) <= cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
