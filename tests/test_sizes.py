"""What must not grow with a table: what comes to the driver, what a task holds, and how often a table is written."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import codecs, files, sinks


def test_files_are_put_together_by_tasks(spark, tmp_path, monkeypatch):
    """Blocks of single-file formats don't come to the driver."""
    df = spark.range(20_000).select(F.col("id").alias("row_id"), *[(F.col("id") % 97 + k).cast("float").alias(c) for k, c in enumerate(sinks.GAUSSIAN)])
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("rows came to the driver"))
    shuffled = df.repartition(7, F.xxhash64("row_id"))
    sinks.write_csv(shuffled, f"{tmp_path}/a.csv")
    sinks.write_splat(shuffled, f"{tmp_path}/a.splat")
    sinks.write_ply({"vertex": shuffled}, f"{tmp_path}/a.ply")
    x = np.arange(20_000) % 97
    assert [float(line.split(",")[0]) for line in (tmp_path / "a.csv").read_text().splitlines()[1:]] == x.tolist()
    assert codecs.read_splat((tmp_path / "a.splat").read_bytes())["x"].tolist() == x.tolist()
    assert codecs.read_ply((tmp_path / "a.ply").read_bytes())[0]["vertex"]["x"].tolist() == x.tolist()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "a.ply", "a.splat"]
    with pytest.raises(FileExistsError):
        files.write_tables(spark, f"{tmp_path}/a.ply", [b"x"], overwrite=False)


def test_splats_are_written_once_in_small_sorts(spark, tmp_path, monkeypatch):
    from cairn import splats
    from cairn.operators import table

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    written, write = [], table.materialize
    monkeypatch.setattr(table, "materialize", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(table, "SORT_ROWS", 500)
    got = splats.lineitem_splats(rows).orderBy("row_id").select("row_id", "y", "scale_2").collect()
    n = rows.count()
    assert [w.count() for w in written] == [n, -(-n // 500)]  # the rows, and a row a partition
    assert written[0].groupBy(F.shiftright("_at", 33)).count().agg(F.max("count")).first()[0] < 1500
    own = sorted((r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice) for r in rows.collect())
    assert [tuple(r) for r in got] == [(k, r[5] / 1e3 - 50.0, r[1] / 10 - 3.0) for k, r in enumerate(own)]


def test_hierarchy_writes_rows_once(spark, monkeypatch):
    """Levels above the tasks' don't write the rows again, and what is carried comes back."""
    from cairn.operators import trees

    df = spark.range(3000).select(F.col("id").alias("row_id"), *[(F.xxhash64("id", F.lit(k)) % 1000).cast("double").alias(c) for k, c in enumerate("xyz")], (F.col("id") % 3).alias("lod"))
    written, write = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda d: written.append(write(d)) or written[-1])
    nodes, rows = trees.bounding_hierarchy(df, leaf=100, task_rows=200, carry=("lod",))
    assert sum(w.count() >= 3000 for w in written) == 2  # as they come, and with their leaves
    assert rows.where("lod <> row_id % 3").isEmpty() and rows.count() == 3000
    _, want = trees.bounding_hierarchy(df, leaf=100)
    assert sorted(rows.select("row_id", "node").collect()) == sorted(want.collect())


def test_chunk_round_trip_joins_no_rows(spark, monkeypatch):
    """Rows are never joined with themselves: every join has the chunks' bounds on one side."""
    from cairn import queries

    df = queries.QUERIES["chunk_roundtrip"](spark, "/root/testdata/sf0.001")
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    wide = [k for k in range(leaves.size()) if "l_extendedprice" in leaves.apply(k).toString()]
    assert len(wide) == 1 and df.first().asDict() == {"n": 6000, "positions": True, "scales": True}


def test_leaves_stop_where_their_sql_does(spark, monkeypatch):
    """A hierarchy that goes deeper than the SQL gives the nodes at its last level."""
    from conftest import DATA
    from oracle import duck, same

    from cairn import queries

    monkeypatch.setattr(queries, "_LEVELS", 3)
    same(queries.QUERIES["bvh_leaves"](spark, DATA), queries.ORACLES["bvh_leaves"].replace(queries._split(16), queries._split(3)), duck(DATA))


@pytest.mark.parametrize("name", ["ksplat0_decode", "ksplat1_decode", "ksplat2_decode", "spz2_decode", "spz3_decode", "lcc_decode", "lcc_one_level"])
def test_files_are_read_by_rows(spark, monkeypatch, name):
    """Sections, planes and streams are cut into parts of rows, short units are read together, and the files are made by tasks, in more than one block."""
    from conftest import DATA
    from oracle import duck, same

    from cairn import queries, queries_formats
    from cairn.sources import datasources

    monkeypatch.setattr(queries_formats, "_MADE", 1700)
    parts, back = [], queries_formats._back

    def cut(s, path, **options):
        out = back(s, path, rows="1024", **options)
        kind = {"ksplat": datasources.KsplatSource, "spz": datasources.SpzSource, "lcc": datasources.LccSource}[path.rpartition(".")[2]]
        source = kind(options | {"path": path, "rows": "1024"})
        parts.extend(p.rows for p in source.reader(source.schema()).partitions())
        return out

    monkeypatch.setattr(queries_formats, "_back", cut)
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], duck(DATA))
    n = 6000 // (1 + (name == "lcc_one_level"))
    assert sum(parts) == n and max(parts) <= 1024 + 500 and n // 1024 <= len(parts) <= n // 1024 + 2


def test_order_by_given_values_and_packing_in_doubles(spark, tmp_path):
    """Rows are placed by the values given, not by those rounded to floats, and offsets in a chunk aren't rounded to floats either."""
    from cairn.operators import chunks, order

    r = np.random.default_rng(3)
    # the edge between two cells of y, missed by less than a float tells
    edge = 512 * (100.0 / 1024)
    ys = [0.0, 100.0, *(edge + (1 - 2 * (k % 2)) * 1e-9 for k in range(300))]
    rows = [(k, 1.0, y, 1.0, *([0.5] * (len(sinks.GAUSSIAN) - 3))) for k, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in sinks.GAUSSIAN))
    assert sinks.GAUSSIAN[:3] == ["x", "y", "z"]
    sinks.write_compressed_ply(df, f"{tmp_path}/a.compressed.ply")
    place = {x.row_id: x.position for x in order.morton_order(df).collect()}
    assert max(place[k] for k in range(3, 302, 2)) < min(place[k] for k in range(2, 302, 2))
    # of a packed table: codes as double arithmetic gives them
    y = np.sort(r.integers(0, 10_000, 256)).astype(np.float32) / np.float32(100) - np.float32(50)
    flat = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "position long, y float").select("position", "y", *[F.lit(0.5).cast("float").alias(c) for c in sinks.GAUSSIAN if c != "y"])
    ready = chunks.prepared(flat)
    got = [x.packed_position >> 11 & 1023 for x in chunks.pack(ready, chunks.chunk_bounds(ready)).orderBy("position").collect()]
    d = y.astype(np.float64)
    assert got == np.floor((d - d[0]) / (d[-1] - d[0]) * 1023 + 0.5).astype(int).tolist() and dict(ready.dtypes)["y"] == "double"


def test_random_hex_of_numbers_never_repeats(spark):
    """4096 rows and as many texts of three digits: drawn by themselves, a third of them would be missing."""
    from cairn.functions import numeric

    n, different, least, most = spark.range(4096).select(numeric.random_hex(3, of="id").alias("h")).agg(F.count("h"), F.count_distinct("h"), F.min(F.length("h")), F.max(F.length("h"))).first()
    assert (n, different, least, most) == (4096, 4096, 3, 3)
    a, b = (spark.range(50).select(numeric.random_hex(12, of="id").alias("h")).collect() for _ in range(2))
    assert a != b and all(len(r.h) == 12 and set(r.h) <= set("0123456789abcdef") for r in a)


def test_nearest_ships_no_pairs(spark, monkeypatch):
    """No table of queries by cells is made: what is written has a row a query or a candidate at most. Sums are added in order, as in SQL."""
    from cairn.operators import neighbors

    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    written, write = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda d: written.append(write(d)) or written[-1])
    got = {t.id: (t.c, t.distance2) for t in neighbors.nearest(df, df.withColumnRenamed("id", "c"), "id", "c", F.col("v"), F.reverse("v")).collect()}
    assert max(w.count() for w in written) == 1500
    apart = x.astype(np.float64)[:, None] - x.astype(np.float64)[None, :, ::-1]
    d = np.zeros((1500, 1500))
    for k in range(16):
        d += apart[:, :, k] ** 2
    assert all(got[k] == (d[k].argmin(), d[k].min()) for k in range(1500))
