"""Column statistics, a row each, in a few passes over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.numeric import INF, is_finite

VERSION, BINS, GLYPHS = 1, 16, "▁▂▃▄▅▆▇█"


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v): all values of the columns as doubles. NULLs go."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.name", "p.v").where("v IS NOT NULL")


def medians(values: DataFrame, width: float = 5e-4) -> DataFrame:
    """(name, median) of long_form's finite values, exact: the mean of the middle two.

    Approximate quantiles, whose rank is off by n / 10000 at most, bracket the middle; only the bracket's distinct values are ranked, so a task
    sees a thousandth of a column.
    """
    found = values.where(is_finite("v"))
    around = found.groupBy("name").agg(F.percentile_approx("v", [0.5 - width, 0.5 + width], 10_000).alias("q"), F.count("*").alias("n"))
    cut = found.join(F.broadcast(around), "name")  # a row a column
    below = cut.groupBy("name").agg(F.count_if(F.col("v") < F.col("q")[0]).alias("below"))
    inside = cut.where(F.col("v").between(F.col("q")[0], F.col("q")[1])).groupBy("name", "n", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy("name").orderBy("v")) + F.col("below")
    ranked = inside.join(F.broadcast(below), "name").withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("m"))
    holds = lambda r: (F.col("from") <= r) & (F.col("upto") > r)
    pick = lambda r: F.max(F.when(holds(F.expr(r)), F.col("v")))
    return ranked.groupBy("name").agg(((pick("(n - 1) div 2") + pick("n div 2")) / 2).alias("median"))


def statistics(df: DataFrame, columns: list[str], exact_median: bool = True) -> DataFrame:
    """name, min, max, median, mean, stddev (of the population), nan_count, inf_count; all but the counts over finite values.

    The median is exact, or without another pass percentile_approx's.
    """
    values = long_form(df, columns)
    f = values.withColumn("f", F.when(is_finite("v"), F.col("v")))
    out = f.groupBy("name").agg(
        F.min("f").alias("min"), F.max("f").alias("max"), F.percentile_approx("f", 0.5, 10_000).alias("median"), F.avg("f").alias("mean"), F.stddev_pop("f").alias("stddev"),
        F.count_if(F.isnan("v")).alias("nan_count"), F.count_if(F.abs("v") == INF).alias("inf_count"),
    )
    if exact_median:
        out = out.drop("median").join(medians(values), "name", "left")
    return out.select("name", "min", "max", "median", "mean", "stddev", "nan_count", "inf_count")


def histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """(name, bin, n) of finite values: equal bins from least to largest, which falls in the last; one value fills bin 0."""
    values = long_form(df, columns).where(is_finite("v"))
    ends = values.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return values.join(F.broadcast(ends), "name").groupBy("name", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # a row a column


def bars(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """(name, histogram): a glyph a bin, by its share of the fullest; an empty bin has the lowest."""
    top = len(GLYPHS) - 1
    by_bin = counts.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.max("n").alias("most"))
    glyph = lambda b: F.substring(F.lit(GLYPHS), F.ceil(F.coalesce(F.element_at("m", b), F.lit(0)) * top / F.col("most")).cast("int") + 1, F.lit(1))
    return by_bin.select("name", F.concat(*[glyph(F.lit(b).cast("long")) for b in range(bins)]).alias("histogram"))


def summary(df: DataFrame, columns: list[str] | None = None, exact_median: bool = True) -> DataFrame:
    """statistics and bars, and the version and row count besides."""
    names = columns or [c for c, k in df.dtypes if k in ("float", "double", "int", "bigint", "smallint", "tinyint")]
    rows = df.count()
    out = statistics(df, names, exact_median).join(bars(histogram(df, names)), "name", "left")
    return out.select(F.lit(VERSION).alias("version"), F.lit(rows).cast("long").alias("row_count"), "*")
