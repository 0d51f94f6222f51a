"""Whole-table operators: row numbers, projection, gathering, setting, checked casts, tests of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from cairn.functions.numeric import is_finite
from cairn.schema import ROW_ID
from cairn.storage import materialize

#: Rows that one task sorts, some 100 bytes each, and those that aren't worth a task of their own.
SORT_ROWS, LEAST_ROWS = 1 << 18, 1 << 14


def with_row_id(df: DataFrame, order: list | None = None, name: str = ROW_ID) -> DataFrame:
    """df with consecutive numbers from 0 in the given order, or as it lies.

    Rows are sorted by range, in partitions of SORT_ROWS that don't spill, and written; a partition's rows are numbered where they are, after
    the counts of the partitions before. The window sees one row a partition.
    """
    if order:
        n = df.count()
        parts = max(1, -(-n // SORT_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    df = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = materialize(sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before")))
    out = df.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row a partition, 16 bytes
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows (tens of bytes each); with more of them a join by shuffle is no longer skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clone(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; an error names those that are missing."""
    if gone := [n for n in names if n not in df.columns]:
        raise KeyError(f"no such columns: {', '.join(gone)}")
    return df.select(*names)


def add_column(df: DataFrame, name: str, values: DataFrame, key: str = ROW_ID) -> DataFrame:
    """df with the column `name` of values, matched by key; every row must have its value, and none may be over."""
    ours, theirs = "_ours", "_theirs"
    both = df.withColumn(ours, F.lit(True)).join(values.select(key, F.col(name), F.lit(True).alias(theirs)), key, "full")
    if not both.where(F.col(ours).isNull() | F.col(theirs).isNull()).isEmpty():
        raise ValueError(f"the new column {name} has not as many rows as the table")
    return both.drop(ours, theirs)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def gather(df: DataFrame, positions: DataFrame, key: str = ROW_ID) -> DataFrame:
    """The rows of df in the order of positions (pos, row): reordered, repeated or left out. A row that df lacks is an error."""
    out = positions.select("pos", F.col("row").alias(key)).join(df.withColumn("_has", F.lit(True)), key, "left")
    return out.withColumn("_has", F.when(F.col("_has").isNull(), F.raise_error(F.lit("a gathered row is out of range"))).otherwise(True)).where("_has").drop("_has")


def get_row(df: DataFrame, row: int, columns: list[str] | None = None, key: str = ROW_ID) -> DataFrame:
    return df.where(F.col(key) == row).select(*(columns or df.columns))


def set_row(df: DataFrame, row: int, values: dict[str, float], key: str = ROW_ID) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.when(F.col(key) == row, checked(F.lit(v), kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def checked(x: Column, kind: DataType) -> Column:
    """x as kind; an error if it is out of range, or has a fraction that an integer type would lose (but for 10 epsilon)."""
    if isinstance(kind, DoubleType):
        return x.cast(kind)
    if isinstance(kind, FloatType):
        over = is_finite(x.cast("double")) & (F.abs(x.cast("double")) > 3.4028234663852886e38)
        return F.when(over, F.raise_error(F.lit("out of range for float")).cast("float")).otherwise(x.cast("float"))
    whole = F.round(x.cast("double"))
    lost = F.abs(x.cast("double") - whole) > 10 * 2.220446049250313e-16
    return F.when(lost, F.raise_error(F.lit("a fraction would be lost")).cast(kind)).otherwise(whole.cast(kind))


def parse(x: Column, kind: str, strict: bool = True) -> Column:
    """Text as a number; NULL instead of an error if not strict."""
    return x.cast(kind) if strict else x.try_cast(kind)


def every(name: str, value: float, tolerance: float = 1e-10) -> Column:
    """Whether all values equal value; true for no rows, false as soon as one is NaN."""
    c = F.col(name).cast("double")
    return F.coalesce(F.bool_and(~F.isnan(c) & (F.abs(c - value) < tolerance)), F.lit(True))


def some(name: str, value: float, tolerance: float = 1e-10) -> Column:
    """Whether any value equals value; false for no rows."""
    c = F.col(name).cast("double")
    return F.coalesce(F.bool_or(~F.isnan(c) & (F.abs(c - value) < tolerance)), F.lit(False))
