"""The columns of a Gaussian table, what they mean, and checks on them.

x y z are world positions, scale_* natural logarithms of axis sizes, rot_* a quaternion with w first, f_dc_* the constant
harmonic (colour = 0.5 + f_dc * SH_C0), opacity a logit, f_rest_k the higher harmonics, channel by channel. lod is a level, -1 for surroundings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

SH_C0 = 0.28209479177387814
POSITION, SCALE, ROTATION, COLOR = ["x", "y", "z"], ["scale_0", "scale_1", "scale_2"], ["rot_0", "rot_1", "rot_2", "rot_3"], ["f_dc_0", "f_dc_1", "f_dc_2"]
GAUSSIAN = [*POSITION, *SCALE, *COLOR, "opacity", *ROTATION]
#: Coefficients a channel by number of bands.
BAND_COEFFICIENTS = {0: 0, 1: 3, 2: 8, 3: 15}
GAUSSIAN_SCHEMA = StructType([StructField(c, FloatType(), False) for c in GAUSSIAN])
ROW_ID = "row_id"

#: The scalar types of PLY headers, as (numpy type, Spark type). Unsigned types are widened.
PLY_TYPES = {
    "char": ("i1", ByteType()), "uchar": ("u1", ShortType()), "short": ("<i2", ShortType()), "ushort": ("<u2", IntegerType()),
    "int": ("<i4", IntegerType()), "uint": ("<u4", LongType()), "float": ("<f4", FloatType()), "double": ("<f8", DoubleType()),
}
PLY_TYPES |= {a: PLY_TYPES[b] for a, b in {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}.items()}
_BYTES = {ByteType: 1, ShortType: 2, IntegerType: 4, LongType: 8, FloatType: 4, DoubleType: 8}


def rest_columns(bands: int) -> list[str]:
    return [f"f_rest_{k}" for k in range(3 * BAND_COEFFICIENTS[bands])]


def bands_of(columns: list[str]) -> int:
    """The bands that the f_rest columns make up, by the first that is missing: 9 are one, 24 two, 45 three, any other number none."""
    have, k = set(columns), 0
    while k < 45 and f"f_rest_{k}" in have:
        k += 1
    return {9: 1, 24: 2, 45: 3}.get(k, 0)


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in GAUSSIAN if c not in df.columns]


def validate(df: DataFrame) -> DataFrame:
    """df, or an error that names what keeps it from being a Gaussian table: missing columns, or no row."""
    if gone := missing_columns(df):
        raise ValueError(f"not a Gaussian table: it lacks {', '.join(gone)}")
    if df.isEmpty():
        raise ValueError("not a Gaussian table: it has no rows")
    return df


def element_bytes(field: StructField) -> int:
    """Bytes of a value: of the type it had in a PLY file, if that is known, or of its own."""
    kind = (field.metadata or {}).get("ply_type")
    if kind:
        import numpy as np

        return np.dtype(PLY_TYPES[kind][0]).itemsize
    return _BYTES[type(field.dataType)]


def total_bytes(df: DataFrame) -> int:
    return df.count() * sum(element_bytes(f) for f in df.schema.fields if type(f.dataType) in _BYTES)
