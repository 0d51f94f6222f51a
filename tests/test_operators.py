import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cairn.operators import bounds, clustering, filters, neighbors, order, summary, table, transform, trees
from cairn.operators.combine import combine
from cairn.plans import actions as A
from cairn.schema import GAUSSIAN, POSITION, bands_of, missing_columns, rest_columns, total_bytes, validate


def gaussians(spark, n, seed=0, bands=0, spread=10.0):
    r = np.random.default_rng(seed)
    names = [*GAUSSIAN, *rest_columns(bands)]
    data = r.normal(size=(n, len(names)))
    data[:, :3] *= spread
    rows = [(i, *map(float, v)) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in names)).repartition(3), data


def test_row_ids_are_consecutive_and_stable(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = table.with_row_id(df, ["k"]).collect()
    assert sorted((r.row_id, r.k) for r in got) == [(i, i) for i in range(1000)]
    assert sorted(r.row_id for r in table.with_row_id(df).collect()) == list(range(1000))
    assert table.with_row_id(df.limit(0), ["k"]).collect() == []


def test_gather_rejects_what_is_out_of_range(spark):
    df, _ = gaussians(spark, 10)
    p = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "pos long, row long")
    assert [r.row_id for r in table.gather(df, p).orderBy("pos").collect()] == [3, 3, 0]
    with pytest.raises(Exception, match="out of range"):
        table.gather(df, spark.createDataFrame([(0, 10)], "pos long, row long")).collect()


def test_checked_casts(spark):
    one = lambda v, k: spark.createDataFrame([(v,)], "v double").select(table.checked(F.col("v"), k).alias("v")).first().v
    assert one(3.0, IntegerType()) == 3
    for bad in (3.5, 3e10, math.nan):
        with pytest.raises(Exception):
            one(bad, IntegerType())
    with pytest.raises(KeyError):
        table.clone(spark.range(1), ["nope"])


def test_every_and_some_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert tuple(df.agg(table.every("v", 1), table.some("v", 1)).first()) == (True, False)
    nan = spark.createDataFrame([(math.nan,), (1.0,)], "v double")
    assert tuple(nan.agg(table.every("v", 1), table.some("v", 1)).first()) == (False, True)


def test_schema(spark):
    df, _ = gaussians(spark, 3, bands=2)
    assert bands_of(df.columns) == 2 and bands_of([f"f_rest_{k}" for k in range(10)]) == 0 and missing_columns(df.drop("x")) == ["x"]
    assert total_bytes(df.select("x", "y")) == 48
    validate(df)
    for bad in (df.drop("x"), df.limit(0)):
        with pytest.raises(ValueError):
            validate(bad)


def test_filter_bands_remaps_channels(spark):
    df, data = gaussians(spark, 5, bands=3)
    got = filters.bands(df, 2)
    assert bands_of(got.columns) == 2 and filters.bands(df, 3) is df and bands_of(filters.bands(df, 0).columns) == 0
    row = got.where("row_id = 2").first()
    assert [row[f"f_rest_{j * 8 + k}"] for j in range(3) for k in range(8)] == [data[2, 14 + j * 15 + k] for j in range(3) for k in range(8)]


def test_transform_and_back(spark):
    df, data = gaussians(spark, 50, bands=3)
    q = transform.euler_quaternion((20, -35, 80))
    out = transform.transform(transform.transform(df, (0, 0, 0), q, 2.0), (0, 0, 0), (q[0], -q[1], -q[2], -q[3]), 0.5).orderBy("row_id").toPandas()
    assert np.allclose(out[POSITION], data[:, :3]) and np.allclose(out["scale_0"], data[:, 3]) and np.allclose(out[rest_columns(3)], data[:, 14:])
    n = data[:, 10:14] / np.linalg.norm(data[:, 10:14], axis=1, keepdims=True)
    assert np.allclose(np.abs((out[[f"rot_{k}" for k in range(4)]].to_numpy() * n).sum(1)), 1)
    part = transform.transform(df.select("row_id", "x"), (1, 1, 1))
    assert part.columns == ["row_id", "x"] and part.where("row_id = 0").first().x == data[0, 0]


def test_combine(spark):
    a, b = spark.createDataFrame([(1, None)], "p int, q int"), spark.createDataFrame([(2.5,)], "r double")
    assert sorted(map(tuple, combine([a, b]).collect())) == [(0, 0, 2.5), (1, None, 0.0)]
    assert combine([]) is None and combine([a]).columns == ["p", "q"]
    with pytest.raises(TypeError):
        combine([a, spark.createDataFrame([("x",)], "p string")])


def morton_model(p, rows, ties=256):
    """The recursive definition."""
    if not len(rows):
        return rows
    v = p[rows]
    lo, hi = np.nanmin(v, 0), np.nanmax(v, 0)
    if not np.isfinite(hi - lo).all() or not (hi - lo).any():
        return rows
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.where(hi > lo, np.minimum(1023, np.maximum(0, (v - lo) * (1024 / (hi - lo)))), 0)
    c = np.nan_to_num(c).astype(int)
    code = np.array([sum(((x >> k & 1) << 3 * k) | ((y >> k & 1) << 3 * k + 1) | ((z >> k & 1) << 3 * k + 2) for k in range(10)) for x, y, z in c])
    at = np.argsort(code, kind="stable")
    rows, code = rows[at], code[at]
    parts = np.split(np.arange(len(rows)), np.nonzero(np.diff(code))[0] + 1)
    return np.concatenate([morton_model(p, rows[k], ties) if len(k) > ties else rows[k] for k in parts])


@pytest.mark.parametrize("kind", ["plain", "outlier", "equal", "nan", "flat", "nested"])
def test_morton_order(spark, kind):
    r = np.random.default_rng(5)
    p = r.normal(size=(900, 3))
    if kind == "outlier":
        p[17] = 1e7
    elif kind == "equal":
        p[:] = 2.5
    elif kind == "nan":
        p[5, 1] = math.nan
    elif kind == "flat":
        p[:, 2] = 0
    elif kind == "nested":
        p = np.concatenate([r.normal(size=(400, 3)) * 10.0 ** -(6 * k) + k % 2 for k in range(3)])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "row_id long, x double, y double, z double")
    got = [x.row_id for x in order.morton_order(df).orderBy("position").collect()]
    assert got == morton_model(p, np.arange(len(p))).tolist()


def test_visibility(spark):
    df, data = gaussians(spark, 40)
    score = 1 / (1 + np.exp(-data[:, 9])) * np.exp(data[:, 3:6].sum(1))
    assert [r.row_id for r in order.by_visibility(df, limit=7).collect()] == np.argsort(-score)[:7].tolist()


def test_oriented_bounds_are_those_of_the_corners(spark):
    df, d = gaussians(spark, 60)
    lo, hi = np.full(3, np.inf), np.full(3, -np.inf)
    for v in d:
        m = transform.rotation_matrix(v[10:14])
        for s in np.array(np.meshgrid(*[[-1, 1]] * 3)).reshape(3, -1).T:
            corner = v[:3] + m @ (s * np.exp(v[3:6]))
            lo, hi = np.minimum(lo, corner), np.maximum(hi, corner)
    got = bounds.oriented(df).first()
    assert np.allclose([got[f"min_{c}"] for c in POSITION], lo) and np.allclose([got[f"max_{c}"] for c in POSITION], hi)


def test_summary(spark):
    v = [1.0, 2.0, 3.0, 10.0, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    row = summary.summary(df).first()
    assert (row.row_count, row.min, row.max, row.median, row["mean"], row.nan_count, row.inf_count) == (7, 1, 10, 2.5, 4, 1, 2)
    assert row["stddev"] == pytest.approx(np.std([1, 2, 3, 10])) and len(row.histogram) == 16 and row.histogram[0] == "█"
    assert summary.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), ["v"]).collect()[0].bin == 0


def test_nearest(spark, monkeypatch):
    r = np.random.default_rng(8)
    q, c = r.normal(size=(40, 5)), r.normal(size=(70, 5))
    c[9] = c[3]
    Q, C = (spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], f"{n} long, {n}v array<double>") for n, x in (("q", q), ("c", c)))
    d = ((q[:, None] - c) ** 2).sum(2)
    for lot in (65536, 16):
        monkeypatch.setattr(neighbors, "LOT_POINTS", lot)
        got = {x.q: (x.c, x.distance2) for x in neighbors.nearest(Q, C, "q", "c", F.col("qv"), F.col("cv")).collect()}
        assert all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min()) for i in range(40))
    odd = {x.q: x.c for x in neighbors.nearest(Q, C, "q", "c", F.col("qv"), F.col("cv"), F.col("c") % 2 == 1).collect()}
    assert all(odd[i] == 2 * d[i, 1::2].argmin() + 1 for i in range(40))
    none = neighbors.nearest(Q, C.limit(0), "q", "c", F.col("qv"), F.col("cv")).first()
    assert none.c == -1 and none.distance2 == math.inf


def test_kmeans_inertia_falls(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(k * 5, 1, (100, 2)) for k in range(4)])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>")
    last = np.inf
    for rounds in (1, 2, 5):
        centers, labels = clustering.kmeans(df, clustering.seeded_centers(df, 4), rounds)
        label = {p.id: p.label for p in labels.collect()}
        inertia = sum(((x[i] - centers[k]) ** 2).sum() for i, k in label.items())
        assert inertia <= last + 1e-9
        last = inertia
    centers, labels = clustering.cluster(df.limit(3), 10)
    assert len(centers) == 3 and sorted(p.label for p in labels.collect()) == [0, 1, 2]


def test_codebook(spark):
    df, data = gaussians(spark, 700)
    book, codes = clustering.codebook(df, ["scale_0", "scale_1"], 8)
    got = {r.row_id: r for r in codes.collect()}
    assert len(book) == 256 and (np.diff(book) >= 0).all()
    error = [abs(book[got[i][c]] - data[i, 3 + k]) for i in range(700) for k, c in enumerate(["scale_0", "scale_1"])]
    assert np.mean(error) < 0.02
    assert [clustering.palette_size(n) for n in (1, 900, 1024, 2048, 3000, 65536, 10**7)] == [1, 900, 1024, 2048, 2048, 65536, 65536]


@pytest.mark.parametrize("task_rows", [65_536, 800])
def test_hierarchy(spark, task_rows):
    df, data = gaussians(spark, 3000)
    nodes, rows = trees.bounding_hierarchy(df, leaf=200, task_rows=task_rows)
    size = {r.node: r for r in nodes.collect()}
    leaf = {r.row_id: r.node for r in rows.collect()}
    assert len(leaf) == 3000 and size[1].n == 3000
    for n, r in size.items():
        own = data[[i for i, k in leaf.items() if k >> (k.bit_length() - n.bit_length()) == n], :3]
        assert len(own) == r.n and np.allclose([r[f"min_{c}"] for c in POSITION], own.min(0)) and np.allclose([r[f"max_{c}"] for c in POSITION], own.max(0))
        assert r.leaf == (r.n <= 200)
        if not r.leaf:
            axis = (own.max(0) - own.min(0)).argmax()
            left = [data[i, axis] for i, k in leaf.items() if k >> (k.bit_length() - n.bit_length() - 1) == 2 * n]
            assert len(left) == r.n // 2 and max(left) <= np.sort(own[:, axis])[r.n // 2]


def test_large_node_medians(spark):
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=3000), 1)
    v[:1200] = 0.5
    df = spark.createDataFrame([(i, float(x), 1, 3000) for i, x in enumerate(v)], "row_id long, v double, node long, n long")
    want = sorted((x, i) for i, x in enumerate(v))[1500]
    for few in (10, 10**6):
        got = trees._medians(df, "row_id", few).first()
        assert (got.cut_v, got.cut_key) == want


def test_octree(spark):
    df, data = gaussians(spark, 2000)
    nodes, rows = trees.octree(df, points=50, depth=5)
    cell = {r.row_id: r.cell for r in rows.collect()}
    lo, hi = data[:, :3].min(0) - 1e-4, data[:, :3].max(0) + 1e-4
    for i, c in cell.items():
        a, b, path = lo.copy(), hi.copy(), ""
        for _ in c:
            mid = (a + b) / 2
            up = data[i, :3] >= mid
            path += str(up[0] * 1 + up[1] * 2 + up[2] * 4)
            a, b = np.where(up, mid, a), np.where(up, b, mid)
        assert path == c
    for r in nodes.collect():
        n = sum(c.startswith(r.cell) for c in cell.values()) if r.leaf else None
        assert not r.leaf or n == r.n and (r.n <= 50 or r.depth == 5)
    near = trees.octree_query(df, F.expr("x * x + y * y + z * z < 100"), 5)
    assert near.count() == ((data[:, :3] ** 2).sum(1) < 100).sum()


def test_lod_plan(spark):
    df, data = gaussians(spark, 2500, spread=20.0)
    df = df.withColumn("lod", (F.col("row_id") % 3).cast("double"))
    rows, files, tree = trees.lod_plan(df, chunk_rows=300, extent=15.0)
    assert rows.count() == 2500 and files.levels == 3
    for lod in range(3):
        at, size = 0, 0
        own = [(files.places[p], p) for p in sorted(files.places, key=lambda p: trees.depth_first(p[0])) if p[1] == lod]
        name = 0
        for (file, offset, n), _ in own:
            assert files.names[file] == f"{lod}_{name}.sog" and offset == size
            size += n
            if size > 300:
                size, name = 0, name + 1
            at += n
        assert at == (df.where(F.col("lod") == lod).count())

    def check(node):
        if "children" in node:
            for c in node["children"]:
                assert all(a <= b for a, b in zip(node["bound"]["min"], c["bound"]["min"])) and all(a >= b for a, b in zip(node["bound"]["max"], c["bound"]["max"]))
                check(c)
        else:
            assert node["lods"]

    check(tree)


def test_files_roll_after_they_overflow(spark):
    def roll(rows):
        counts = spark.createDataFrame([(k, 0.0, n, trees.depth_first(k)) for k, n in rows], "node long, lod double, n long, order long")
        return {r.node: (r.file, r.offset, r.n) for r in trees.roll_files(counts, 100).collect()}

    got = roll([(2, 60), (3, 60), (4, 10), (5, 10)])
    assert [got[k] for k in (4, 5, 2, 3)] == [(0, 60, 10), (0, 70, 10), (0, 0, 60), (0, 80, 60)]
    assert sorted([2, 3, 4, 5], key=trees.depth_first) == [2, 4, 5, 3]
    assert roll([(2, 101), (3, 5)])[3] == (1, 0, 5)
    assert trees.texture_size(1000) == (32, 32)


def test_actions(spark):
    df, data = gaussians(spark, 200, bands=1)
    plan = A.Plan([A.Translate((1, 2, 3)), A.FilterBox((-5, -5, -5), (5, 5, 5)), A.FilterBands(0), A.Lod(2), A.Param("a", "b"), A.FilterRows(F.col("row_id") % 2 == 0), A.Rotate((0, 0, 90))])
    out = plan(df)
    p = data[:, :3] + [1, 2, 3]
    keep = [i for i in range(0, 200, 2) if (np.abs(p[i]) <= 5).all()]
    assert sorted(r.row_id for r in out.collect()) == keep and out.first().lod == 2 and plan.params == {"a": "b"} and bands_of(out.columns) == 0


def _nearest_by_hand(queries, candidates):
    out = []
    for qid, v in queries:
        best = (math.inf, 0, -1)
        for cid, w in candidates:
            if w is not None and all(x is not None and math.isfinite(x) for x in w) and all(map(math.isfinite, v)):
                d = sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
                best = min(best, (d, cid is None, cid if cid is not None else 0), key=lambda t: (round(t[0], 9), t[1], t[2]))
        out.append((qid, None if best[1] else best[2], round(best[0], 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("lot", [4, 16384])
def test_nearest_with_repeated_and_null_ids(spark, monkeypatch, lot):
    monkeypatch.setattr(neighbors, "LOT_POINTS", lot)
    monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 3)
    r = np.random.default_rng(lot)
    points = [(int(i) if i % 11 else None, list(map(float, v))) for i, v in zip(r.integers(0, 40, 300), r.integers(-6, 6, (300, 3)), strict=True)]
    points += [(5, [math.nan, 0.0, 0.0]), (6, [0.0, math.inf, 0.0])]
    asked = [(k % 50, list(map(float, v))) for k, v in enumerate(r.normal(0, 5, (120, 3)))] + [(1, points[0][1]), (99, [math.nan, 0.0, 0.0])]
    q, c = spark.createDataFrame(asked, "q long, v array<double>"), spark.createDataFrame(points, "c long, w array<double>")
    got = neighbors.nearest(q, c, "q", "c", F.col("v"), F.col("w")).collect()
    assert sorted(((x.q, x.c, round(x.distance2, 6)) for x in got), key=repr) == _nearest_by_hand(asked, points)
    none = neighbors.nearest(q, c, "q", "c", F.col("v"), F.col("w"), F.lit(False)).collect()
    assert len(none) == len(asked) and {(x.c, x.distance2) for x in none} == {(-1, math.inf)}


def test_nearest_of_far_points_is_exact():
    r = np.random.default_rng(1)
    points = 1e6 + r.normal(size=(500, 4))
    x = 1e6 + r.normal(size=(200, 4))
    at, d = neighbors.nearest_of(x, points)
    want = ((x[:, None] - points[None]) ** 2).sum(2)
    assert at.tolist() == want.argmin(1).tolist() and np.allclose(d, want.min(1))
    assert neighbors.nearest_of(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1.0], [-1.0, 0]]))[0].tolist() == [0]


def test_add_column_of_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0)], "row_id long, x double")
    values = spark.createDataFrame([(0, 5.0), (1, None)], "row_id long, y double")
    assert sorted(map(tuple, table.add_column(df, "y", values).collect())) == [(0, None, 5.0), (1, 2.0, None)]
    for other in (values.limit(1), values.union(spark.createDataFrame([(2, 1.0)], "row_id long, y double"))):
        with pytest.raises(ValueError, match="not as many rows"):
            table.add_column(df, "y", other)


def test_empty_cluster_gets_a_point(spark):
    points = spark.createDataFrame([(k, [float(k // 10) * 100 + k % 10]) for k in range(30)], "id long, v array<double>")
    start = np.array([[0.0], [1e9], [2e9]])
    assert sorted(clustering.kmeans(points, start, 10)[0][:, 0])[-2:] == [1e9, 2e9]
    got, labels = clustering.kmeans(points, start, 10, seed=1)
    assert got.max() < 300 and labels.select("label").distinct().count() == 3
    assert np.array_equal(got, clustering.kmeans(points.repartition(5), start, 10, seed=1)[0])
