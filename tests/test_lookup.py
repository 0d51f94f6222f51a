import pytest
from pyspark.sql import functions as F

from cairn.operators import lookup


@pytest.mark.parametrize("stretch", [65_536, 3])
def test_buckets(spark, stretch):
    sizes = [3, 0, 5, 1, 0, 4, 2]
    ranges = lookup.bucket_ranges(spark.createDataFrame(list(enumerate(sizes)), "bucket_id long, size long"), stretch=stretch)
    want = [k for k, n in enumerate(sizes) for _ in range(n)]
    got = lookup.in_buckets(spark.range(20).select(F.col("id").alias("row_id")), ranges, width=2).orderBy("row_id").collect()
    assert [r.bucket_id for r in got] == want


def test_palette_and_codebook(spark):
    df = spark.createDataFrame([(0, 1), (1, 9)], "row_id long, label long")
    got = lookup.by_palette(df, spark.createDataFrame([(1, 0.5)], "label long, c double")).orderBy("row_id").collect()
    assert [r.c for r in got] == [0.5, 0.0]
    assert [r.label for r in lookup.by_codebook(df, ["label"], [float(k) for k in range(10)]).orderBy("row_id").collect()] == [1.0, 9.0]
    with pytest.raises(ValueError):
        lookup.by_codebook(df, ["label"], [0.0] * 70_000)
