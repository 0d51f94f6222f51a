"""The line items seen as splats: every test table has them, so every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.table import with_row_id
from cairn.schema import SH_C0

#: The columns that a splat is made of, in order. Flags, status and date come after them; they would only order line items that are the same splat.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_splats(lineitem: DataFrame) -> DataFrame:
    """A splat a line item, numbered in the order of all its columns."""
    d = lambda c: F.col(c).cast("double")
    dc = lambda c: (d(c) % 256 / 255 - 0.5) / SH_C0
    columns = {
        "x": d("l_quantity") - 25.5, "y": d("l_extendedprice") / 1e3 - 50.0, "z": d("l_partkey") % 97 - 48.0,
        "scale_0": d("l_discount") * 10 - 3, "scale_1": d("l_tax") * 10 - 3, "scale_2": d("l_linenumber") / 10 - 3,
        "f_dc_0": dc("l_partkey"), "f_dc_1": dc("l_suppkey"), "f_dc_2": dc("l_orderkey"), "opacity": d("l_discount") * 40 - 2,
        "rot_0": d("l_quantity") / 50 - 0.5, "rot_1": d("l_discount") * 10 - 0.5, "rot_2": 0.4 - d("l_tax") * 10, "rot_3": d("l_linenumber") / 10,
        "lod": F.when(F.col("l_linenumber") == 7, -1.0).otherwise(d("l_linenumber") % 3),
    }
    numbered = with_row_id(lineitem.select(*ORDER), ORDER)
    return numbered.select("row_id", *[v.alias(k) for k, v in columns.items()])


_VIEWS: dict[tuple[str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splats of a test folder, their line items sorted and written once a session; numbers and splats are made where they are read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VIEWS:
        _VIEWS[key] = lineitem_splats(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return _VIEWS[key]


SQL = """
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS row_id,
  l_quantity - 25.5e0 AS x, l_extendedprice / 1e3 - 5e1 AS y, CAST(l_partkey % 97 AS DOUBLE) - 48e0 AS z,
  l_discount * 1e1 - 3e0 AS scale_0, l_tax * 1e1 - 3e0 AS scale_1, CAST(l_linenumber AS DOUBLE) / 1e1 - 3e0 AS scale_2,
  (CAST(l_partkey % 256 AS DOUBLE) / 255e0 - 0.5e0) / 0.28209479177387814e0 AS f_dc_0,
  (CAST(l_suppkey % 256 AS DOUBLE) / 255e0 - 0.5e0) / 0.28209479177387814e0 AS f_dc_1,
  (CAST(l_orderkey % 256 AS DOUBLE) / 255e0 - 0.5e0) / 0.28209479177387814e0 AS f_dc_2,
  l_discount * 4e1 - 2e0 AS opacity,
  l_quantity / 5e1 - 0.5e0 AS rot_0, l_discount * 1e1 - 0.5e0 AS rot_1, 0.4e0 - l_tax * 1e1 AS rot_2, CAST(l_linenumber AS DOUBLE) / 1e1 AS rot_3,
  CASE WHEN l_linenumber = 7 THEN -1e0 ELSE CAST(l_linenumber % 3 AS DOUBLE) END AS lod
FROM lineitem
"""
