"""Bounds of positions and of oriented splats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import quaternion
from cairn.functions.numeric import is_finite
from cairn.schema import POSITION, SCALE


def extents(columns: list[str]) -> list[Column]:
    """min_c and max_c of each column's values that aren't NaN."""
    return [f(F.when(~F.isnan(c), F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]


def widest(columns: list[str]) -> tuple[Column, Column]:
    """The place of the column with the largest extent, the first of equals, and that extent; from min_c and max_c."""
    sizes = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in columns]
    top, at = F.greatest(*sizes), F.lit(len(columns) - 1)
    for k in reversed(range(len(columns) - 1)):
        at = F.when(sizes[k] == top, k).otherwise(at)
    return at, top


def half_sizes() -> list[Column]:
    """How far an oriented splat of one standard deviation reaches along each axis: what its eight corners do, in closed form."""
    m, s = quaternion.matrix(quaternion.unit()), [F.exp(c) for c in SCALE]
    return [sum((F.abs(m[i][j]) * s[j] for j in range(1, 3)), F.abs(m[i][0]) * s[0]) for i in range(3)]


def oriented(df: DataFrame, *keys: str) -> DataFrame:
    """min_x to max_z over the splats of each group; corners that aren't finite don't count."""
    ends = {}
    for c, h in zip(POSITION, half_sizes(), strict=True):
        ends |= {f"_lo_{c}": F.col(c) - h, f"_hi_{c}": F.col(c) + h}
    out = df.select(*keys, *[v.alias(k) for k, v in ends.items()])
    aggs = []
    for c in POSITION:
        aggs += [F.min(F.when(is_finite(f"_lo_{c}"), F.col(f"_lo_{c}"))).alias(f"min_{c}"), F.max(F.when(is_finite(f"_hi_{c}"), F.col(f"_hi_{c}"))).alias(f"max_{c}")]
    return out.groupBy(*keys).agg(*aggs)


def union(bounds: DataFrame, *keys: str) -> DataFrame:
    """The bounds around bounds."""
    return bounds.groupBy(*keys).agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for c in POSITION for n, f in (("min", F.min), ("max", F.max))])
