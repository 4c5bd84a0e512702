"""Small text files on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_bytes(spark: SparkSession, where: str) -> bytes:
    fs, path = _at(spark, where)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(spark: SparkSession, where: str) -> str:
    return read_bytes(spark, where).decode()


def write_bytes(spark: SparkSession, where: str, data: bytes) -> None:
    fs, path = _at(spark, where)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_text(spark: SparkSession, where: str, text: str) -> None:
    write_bytes(spark, where, text.encode())


def list_folder(spark: SparkSession, where: str) -> list[str]:
    fs, path = _at(spark, where)
    return sorted(f.getPath().toString() for f in fs.listStatus(path))


def make_folder(spark: SparkSession, where: str) -> None:
    fs, path = _at(spark, where)
    fs.mkdirs(path)


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = _at(spark, where)
    return fs.exists(path)


def delete(spark: SparkSession, where: str) -> None:
    fs, path = _at(spark, where)
    fs.delete(path, True)


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one of this process where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:  # kept here: a session does not let this setting be changed
            _OWN.append("file://" + tempfile.mkdtemp(prefix="rounds-"))
        at = _OWN[0]
    return at.rstrip("/")


def round_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def close() -> None:
        with contextlib.suppress(Exception):
            delete(spark, root)

    atexit.register(close)
    return root


def written(df: DataFrame, where: str, *, group_bytes: int | None = None) -> DataFrame:
    """The frame as a Parquet table at a path: its lineage is cut and it outlives a lost executor. group_bytes: of a row group, for rows that are large."""
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
