"""What the corpus operators share: the shared folder, staged tables and a few columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.storage import release
from cairn.storage import shared_path as shared_dir
from cairn.storage import write_bytes  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but these; a class for Java's and Python's regular expressions.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: While stage() writes: bytes of an Arrow batch that a task hands to Python, of which growing buffers make several times as many, and rows that a
#: scan decodes at once, whose texts lie in one array that doubles as it grows.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "256"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """SMALL holds for what runs inside; rows of this kind of table are kilobytes long."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_passing: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are deleted at the end, but those that outlive it; what is read afterwards may not come from them."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            release(spark, path)


def stage(df: DataFrame, spark: SparkSession | None = None, codec: str = "snappy", outlive: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and no later loss repeats the work. With outlive it stays when the innermost passing() ends."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    for made in _passing[-2:-1] if outlive else _passing[-1:]:
        made.append(path)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """text with A-Z alone in lower case. lower() is quick and the same thing where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def arrow_schema(schema):
    """The Arrow schema that a grouped Arrow function must return for a Spark schema or its DDL; what it is given may have large types instead."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column; Spark compares names without case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def give_back() -> None:
    """Returns to the system what this process no longer uses: a task's Python worker stays for the next task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function over a partition's batches that gives memory back when the partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
