"""Rigid transforms with one scale: narrow, one projection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import harmonics, quaternion
from cairn.schema import BAND_COEFFICIENTS, POSITION, ROTATION, SCALE, bands_of


def euler_quaternion(degrees) -> tuple[float, float, float, float]:
    """Turns about the fixed axes x, then y, then z."""
    q = (1.0, 0.0, 0.0, 0.0)
    for axis, angle in enumerate(degrees):
        h = math.radians(angle) / 2
        r = [math.cos(h), 0.0, 0.0, 0.0]
        r[axis + 1] = math.sin(h)
        w, x, y, z = r
        W, X, Y, Z = q
        q = (w * W - x * X - y * Y - z * Z, w * X + x * W + y * Z - z * Y, w * Y - x * Z + y * W + z * X, w * Z + x * Y - y * X + z * W)
    return q


def rotation_matrix(q) -> np.ndarray:
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def transform(df: DataFrame, translation=(0.0, 0.0, 0.0), rotation=(1.0, 0.0, 0.0, 0.0), scale: float = 1.0) -> DataFrame:
    """Positions are scaled, turned and moved, orientations turned, log scales raised by ln scale, harmonics turned.

    Each part needs all its columns and is left out otherwise. Column types stay.
    """
    r = rotation_matrix(rotation)
    unit = np.asarray(rotation, float) / np.linalg.norm(rotation)
    has, new = set(df.columns), {}
    if has >= set(POSITION):
        for i, c in enumerate(POSITION):
            new[c] = sum((F.col(p) * float(scale * r[i, j]) for j, p in enumerate(POSITION)), F.lit(float(translation[i])))
    if has >= set(ROTATION):
        new |= dict(zip(ROTATION, quaternion.unit(quaternion.multiply([F.lit(float(v)) for v in unit], ROTATION)), strict=True))
    if has >= set(SCALE):
        new |= {c: F.col(c) + math.log(scale) for c in SCALE}
    if n := bands_of(df.columns):
        m, k = harmonics.rotations(r, n), BAND_COEFFICIENTS[n]
        for j in range(3):
            for i in range(k):
                new[f"f_rest_{j * k + i}"] = sum((F.col(f"f_rest_{j * k + c}") * float(m[i, c]) for c in range(k) if abs(m[i, c]) > 1e-15), F.lit(0.0))
    kinds = dict(df.dtypes)
    return df.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col(c) for c in df.columns])
