"""Formats by suffix. Longer suffixes go first: lod-meta.json before meta.json, .compressed.ply before .ply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import datasources, sinks

READ = {".ksplat": "ksplat", ".splat": "splat", ".sog": "sog", "meta.json": "sog", ".ply": "ply", ".spz": "spz", ".lcc": "lcc"}
WRITE = {".csv": "csv", "lod-meta.json": "lod", ".sog": "sog", "meta.json": "sog-files", ".compressed.ply": "compressed-ply", ".ply": "ply", ".splat": "splat"}


def by_suffix(path: str, known: dict[str, str]) -> str:
    for suffix, kind in known.items():
        if path.lower().endswith(suffix):
            return kind
    raise ValueError(f"{path}: no such format; known are {', '.join(known)}")


def read(spark: SparkSession, path: str, lods: list[int] = ()) -> DataFrame:
    kind = by_suffix(path, READ)
    if kind == "ply":
        return datasources.read_ply(spark, path)
    datasources.register(spark)
    reader = spark.read.format(kind)
    return (reader.option("lods", ",".join(map(str, lods))) if lods else reader).load(path)


def write(df: DataFrame, path: str, environment: DataFrame | None = None, iterations: int = 10, bundle: bool = True, chunk_count: int = 64, chunk_extent: float = 16.0, overwrite: bool = True) -> None:
    kind = by_suffix(path, WRITE)
    if kind == "csv":
        sinks.write_csv(df, path, overwrite=overwrite)
    elif kind == "lod":
        df = df if "lod" in df.columns else df.withColumn("lod", F.lit(0.0).cast("float"))
        sinks.write_lod(df, path, environment, bundle, iterations, chunk_count, chunk_extent)
    elif kind.startswith("sog"):
        sinks.write_sog(df, path, kind == "sog", iterations, overwrite=overwrite)
    elif kind == "compressed-ply":
        sinks.write_compressed_ply(df, path, overwrite=overwrite)
    elif kind == "ply":
        sinks.write_ply({"vertex": df}, path, overwrite=overwrite)
    else:
        sinks.write_splat(df, path, overwrite=overwrite)
