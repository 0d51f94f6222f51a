"""Lookups: codebooks, palettes and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.table import few


#: A palette's usual bound; 65536 rows of 45 numbers are 24 MB.
PALETTE_ROWS = 1 << 16


def by_codebook(df: DataFrame, labels: list[str], codebook: list[float]) -> DataFrame:
    """The label columns replaced by the codebook's values; the codebook has at most 65536 of them."""
    if len(codebook) > 1 << 16:
        raise ValueError("a codebook of more than 65536 values is a table: join it")
    book = F.array(*[F.lit(float(v)) for v in codebook])
    return df.withColumns({c: F.get(book, F.col(c).cast("int")) for c in labels})


def by_palette(df: DataFrame, palette: DataFrame, label: str = "label") -> DataFrame:
    """df with the palette's other columns; a label that it lacks gives zeros. A palette of at most PALETTE_ROWS rows is broadcast, a longer one joined by shuffle."""
    out = df.join(few(palette, PALETTE_ROWS), label, "left")
    return out.fillna(0, [c for c in palette.columns if c != label])


def bucket_ranges(buckets: DataFrame, order: str = "bucket_id", size: str = "size", stretch: int = 65_536) -> DataFrame:
    """buckets with first and last, the half-open range of rows that each holds, laid end to end by their numbers.

    Sums run within stretches of numbers, then over the stretches' sums: no task sees all buckets.
    """
    own = buckets.withColumn("_stretch", F.expr(f"{order} div {stretch}"))
    sums = own.groupBy("_stretch").agg(F.sum(size).alias("_n"))
    sums = sums.select("_stretch", (F.sum("_n").over(W.orderBy("_stretch")) - F.col("_n")).alias("_before"))
    within = F.sum(size).over(W.partitionBy("_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = own.withColumn("last", within).join(sums, "_stretch").withColumn("last", F.col("last") + F.col("_before"))
    return out.withColumn("first", F.col("last") - F.col(size)).drop("_stretch", "_before")


def in_buckets(df: DataFrame, ranges: DataFrame, row: str = "row_id", width: int = 4096) -> DataFrame:
    """df with the columns of the range that holds its row. Rows and ranges meet in stretches of `width` rows, by an equal key."""
    cut = ranges.where("last > first").withColumn("_stretch", F.explode(F.expr(f"sequence(first div {width}, (last - 1) div {width})")))
    out = df.withColumn("_stretch", F.expr(f"{row} div {width}")).join(cut, "_stretch")
    return out.where((F.col(row) >= F.col("first")) & (F.col(row) < F.col("last"))).drop("_stretch")
