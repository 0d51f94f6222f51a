"""Row and band filters. Boxes and balls are closed; a cell of a partition is half open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cairn.functions.numeric import is_finite
from cairn.schema import BAND_COEFFICIENTS, POSITION, bands_of, rest_columns

COMPARE: dict[str, Callable[[Column, float], Column]] = {
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "eq": lambda c, v: c == v, "neq": lambda c, v: c != v,
}


def by_value(df: DataFrame, column: str, comparison: str, value: float) -> DataFrame:
    """NaN compares with nothing: such a row stays only under neq."""
    c = F.col(column)
    test = COMPARE[comparison](c, value)
    if isinstance(df.schema[column].dataType, (FloatType, DoubleType)):
        test = (test | F.isnan(c)) if comparison == "neq" else (test & ~F.isnan(c))
    return df.where(test)


def finite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows whose values, of the floating columns or those named, are all finite."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    for c in names:
        df = df.where(is_finite(c))
    return df


def box(df: DataFrame, lo=(-float("inf"),) * 3, hi=(float("inf"),) * 3) -> DataFrame:
    for c, a, b in zip(POSITION, lo, hi, strict=True):
        df = df.where(F.col(c).between(a, b) & ~F.isnan(c))
    return df


def sphere(df: DataFrame, center=(0.0, 0.0, 0.0), radius: float = 1.0) -> DataFrame:
    return df.where(sum((F.col(c) - m) * (F.col(c) - m) for c, m in zip(POSITION, center, strict=True)) <= radius * radius)


def in_cell(lo, hi) -> Column:
    """Whether a position lies in the half-open box."""
    return F.expr(" AND ".join(f"{c} >= {a!r}D AND {c} < {b!r}D" for c, a, b in zip(POSITION, lo, hi, strict=True)))


def bands(df: DataFrame, keep: int) -> DataFrame:
    """The harmonics up to band `keep`: coefficients beyond go, and the rest move together, channel by channel."""
    have = bands_of(df.columns)
    if have <= keep:
        return df
    old, new = BAND_COEFFICIENTS[have], BAND_COEFFICIENTS[keep]
    moved = [F.col(f"f_rest_{j * old + k}").alias(f"f_rest_{j * new + k}") for j in range(3) for k in range(new)]
    rest = set(rest_columns(have))
    return df.select(*[c for c in df.columns if c not in rest], *moved)


def set_lod(df: DataFrame, level: float) -> DataFrame:
    return df.withColumn("lod", F.lit(float(level)).cast("float"))


def surroundings_and_scene(tables: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tables all of whose rows have lod -1, and the others, in order."""
    from cairn.operators.table import every

    env = [("lod" in t.columns) and bool(t.agg(every("lod", -1.0).alias("e")).first().e) for t in tables]
    return [t for t, e in zip(tables, env, strict=True) if e], [t for t, e in zip(tables, env, strict=True) if not e]


def levels(df: DataFrame, wanted: list[int]) -> DataFrame:
    return df.where(F.col("lod").isin([float(x) for x in wanted])) if wanted else df
