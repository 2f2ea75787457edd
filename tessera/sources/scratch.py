"""Cuts lineage through the folder that all executors share, and replaces tables so that none is lost."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, whose executors are this process, may have none set: it gets one."""
    name = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        name = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", name)
    return name


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes the rows and reads them back: what follows neither recomputes them nor depends on the executors that made them."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """A table in a folder that is replaced as a whole.

    The new rows are written beside it and take its place by renaming. Whenever a writer is lost, the old or the new table
    is whole, and the next use of the store finishes or undoes what was begun.
    """

    def __init__(self, spark: SparkSession, path: str):
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.spark, self.path = spark, path
        self.now, self.next, self.old = path_of(path), path_of(f"{path}-next"), path_of(f"{path}-old")
        self.done = path_of(f"{path}-next/_SUCCESS")
        self.files = self.now.getFileSystem(spark._jsc.hadoopConfiguration())
        self._recover()

    def _recover(self) -> None:
        if not self.files.exists(self.now):
            if self.files.exists(self.done):
                self.files.rename(self.next, self.now)
            elif self.files.exists(self.old):
                self.files.rename(self.old, self.now)
        for stale in (self.next, self.old):
            if self.files.exists(stale):
                self.files.delete(stale, True)

    def read(self) -> DataFrame | None:
        """The rows; none before the first write. Any other failure to read is raised."""
        return self.spark.read.parquet(self.path) if self.files.exists(self.now) else None

    def replace(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}-next")
        if self.files.exists(self.now) and not self.files.rename(self.now, self.old):
            raise OSError(f"can't move {self.path}")
        if not self.files.rename(self.next, self.now):
            raise OSError(f"can't replace {self.path}")
        self.files.delete(self.old, True)
