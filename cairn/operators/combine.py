"""Tables one after another, with the columns of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_schema(tables: list[DataFrame]) -> dict[str, str]:
    """Names and types in order of first appearance; one name under two types is an error."""
    out: dict[str, str] = {}
    for t in tables:
        for name, kind in t.dtypes:
            if out.setdefault(name, kind) != kind:
                raise TypeError(f"column {name} is {out[name]} in one table and {kind} in another")
    return out


def combine(tables: list[DataFrame]) -> DataFrame | None:
    """All rows, table by table. A column that a table lacks is 0 in its rows; NULLs of its own stay. No table gives None."""
    if not tables:
        return None
    schema, out = merged_schema(tables), None
    for t in tables:
        t = t.select(*[F.col(n) if n in t.columns else F.lit(0).cast(k).alias(n) for n, k in schema.items()])
        out = t if out is None else out.unionByName(t)
    return out
