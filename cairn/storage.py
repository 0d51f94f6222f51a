"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: set[str] = set()


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, in a folder of this application that goes when Python ends in good order.

    A local master that leaves the setting unset gets a temporary folder. Results are read from these tables, so they must outlast any query;
    release() drops them earlier. What a killed application leaves stands under its id.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(release, spark, folder)
    return f"{folder}/table-{uuid.uuid4().hex}"


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Deletes all tables that this application has written for itself; no DataFrame made before may be used afterwards."""
    for f in [folder] if folder else list(_folders):
        with contextlib.suppress(Exception):  # the session has ended
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _folders.discard(f)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file at path, of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        out.close()


def materialize(df: DataFrame) -> DataFrame:
    """df as a written table: its plan is cut, and no lost executor makes it anew."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
