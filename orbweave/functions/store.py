"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on a local master that has none (tests) gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orbweave-"))
    return context.getCheckpointDir()


def _path(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def settled(df: DataFrame, *, codec: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage, survives lost executors, and tells the planner the true size.
    The table goes when the session ends; ``codec`` is how it is compressed, if not as the session says."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to as many tasks as shuffles have, or cores if those are more.

    For steps that cost far more than to move their rows: a file of one row group is one task
    otherwise, and partitions are not put together by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


class Scratch:
    """Settled tables of one computation; those that are not kept go at its end.

    What a computation returns must read none of the tables that go: it is settled apart,
    with :func:`settled`, before the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def settled(self, df: DataFrame) -> DataFrame:
        folder = f"{shared_dir(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.folders.append(folder)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def __exit__(self, *_) -> None:
        for folder in self.folders:
            path, files = _path(self.spark, folder)
            files.delete(path, True)
