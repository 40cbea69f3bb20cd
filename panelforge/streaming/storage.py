"""Shared storage for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is named, one machine that holds driver and executors (``local[n]``) gets one temporary folder for the
    session; a cluster is refused, as its executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody else writes to, on shared storage."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written as Parquet to shared storage and read again: lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_evenly(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, in equal parts for every core: for small tables that are read in many passes.

    A small table lies in one or two files, which as many cores would read, the others waiting.
    """
    return stored(df.repartition(df.sparkSession.sparkContext.defaultParallelism), name)


# ---- small files of a table's own, by Hadoop's file systems -------------------------------

def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, p = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file at or below ``path``."""
    fs, p = _files(spark, path)
    out = []
    if fs.exists(p):
        found = fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _files(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that exists is an error."""
    fs, p = _files(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)
