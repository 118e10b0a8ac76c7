"""Intermediate tables in the folder that all executors share, and small files beside them.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local
session without that setting (tests, a laptop) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any file system that Spark reads."""
    fs, at = _file(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and moved, so that readers see the old content or the new."""
    fs, new = _file(spark, path + ".new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    sc, fs_ = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
    how = sc._gateway.new_array(fs_.Options.Rename, 1)
    how[0] = fs_.Options.Rename.OVERWRITE
    context = fs_.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(fs_.Path(path)), how)


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
        self.n, self.id = 0, uuid.uuid4().hex[:6]
        self.tables: list[DataFrame] = []

    def path(self, name: str) -> str:
        """A new one, also where the folder holds tables of an earlier run."""
        self.n += 1
        return f"{self.root}/{self.n:03d}-{self.id}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_scratch_path", None):
                fs, at = _file(self.spark, t._scratch_path)
                fs.delete(at, True)
                t._scratch_path = None

    def keep_only(self, *tables: DataFrame) -> None:
        """Frees all others; for when what is returned reads only these."""
        self.drop(*[t for t in self.tables if not any(t is k for k in tables)])
        self.tables = list(tables)
