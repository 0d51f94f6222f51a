"""Column expressions against numpy and Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import color, harmonics, morton, numeric, packing, quaternion
from cairn.operators.transform import euler_quaternion, rotation_matrix


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]


def test_logs(spark):
    got = values(spark, [(0.0,), (1.0,), (0.5,), (-1.0,)], "v double", numeric.ln("v"), numeric.logit("v"), numeric.logit_open("v"), numeric.inverse_sigmoid("v"))
    assert got[0][0] == -math.inf and got[0][1] == pytest.approx(math.log(1e-6 / (1 - 1e-6))) and got[0][3] == -math.inf
    assert got[1][0] == 0 and got[1][2] == math.inf and got[1][3] == math.inf
    assert got[2][1:] == (0, 0, 0) and math.isnan(got[3][0])


def test_normalize(spark):
    got = values(spark, [(-1.0, 0.0, 1.0), (2.0, 0.0, 1.0), (0.25, 0.0, 1.0), (5e-6, 0.0, 9e-6)], "v double, a double, b double", numeric.normalize("v", "a", "b"))
    assert [g[0] for g in got] == [0, 1, 0.25, 0]


def test_half(spark):
    bits = list(range(0, 65536, 97)) + [0x7C00, 0xFC00, 0x7E00, 1, 0x8000]
    got = values(spark, [(b,) for b in bits], "b int", numeric.half("b"))
    want = np.array(bits, np.uint16).view(np.float16).astype(float)
    assert np.array_equal([g[0] for g in got], want, equal_nan=True)


def test_lcg(spark):
    s, want = numeric.LCG_SEED, []
    for _ in range(500):
        s = (numeric.LCG_A * s + numeric.LCG_C) % numeric.LCG_M
        want.append(s / (numeric.LCG_M - 1))
    assert [r.value for r in numeric.lcg_table(spark, 500).orderBy("i").collect()] == want


def test_packing(spark):
    got = values(spark, [(1.0, 1.0, 1.0), (1.0, 0.0, 0.0), (-3.0, 0.5, 9.0)], "x double, y double, z double", packing.pack_11_10_11("x", "y", "z"), packing.pack_8888("x", "y", "z", "x"))
    assert got[0] == (0xFFFFFFFF, 0xFFFFFFFF) and got[1] == (0xFFE00000, 0xFF0000FF) and got[2][0] == (512 << 11) | 2047


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50))
def test_codes_come_back(spark, codes):
    x, y, z = packing.unpack_11_10_11("c")
    r, g, b, a = packing.unpack_8888("c")
    got = values(spark, [(c,) for c in codes], "c long", packing.pack_11_10_11(x, y, z), packing.pack_8888(r, g, b, a))
    assert got == [(c, c) for c in codes]


def unit_quaternions(n, seed=0):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


@pytest.mark.parametrize("form,tolerance", [("three", 1e-3), ("sog", 5e-3)])
def test_quaternions_come_back(spark, form, tolerance):
    q = unit_quaternions(200)
    cols = quaternion.unpack_smallest_three(quaternion.pack_smallest_three()) if form == "three" else quaternion.unpack_sog(*quaternion.pack_sog())
    got = np.array(values(spark, [tuple(map(float, r)) for r in q], "rot_0 double, rot_1 double, rot_2 double, rot_3 double", *cols))
    assert np.all(1 - np.abs((got * q).sum(1)) < tolerance)


def test_quaternion_product_and_matrix(spark):
    a, b = unit_quaternions(20, 1), unit_quaternions(20, 2)
    names = ["w", "x", "y", "z", "W", "X", "Y", "Z"]
    got = values(spark, [tuple(map(float, (*p, *q))) for p, q in zip(a, b)], ", ".join(f"{'a' if k < 4 else 'b'}{n.lower()} double" for k, n in enumerate(names)), *quaternion.multiply(["aw", "ax", "ay", "az"], ["bw", "bx", "by", "bz"]), *[c for r in quaternion.matrix(["aw", "ax", "ay", "az"]) for c in r])
    for p, q, g in zip(a, b, got):
        assert np.allclose(rotation_matrix(g[:4]), rotation_matrix(p) @ rotation_matrix(q)) and np.allclose(np.reshape(g[4:], (3, 3)), rotation_matrix(p))


def test_special_quaternions(spark):
    got = values(spark, [(0, 0, 0, 100)], "r int, g int, b int, a int", *quaternion.unpack_sog("r", "g", "b", "a"))
    assert got == [(0, 0, 0, 1)]
    assert values(spark, [(0.0, 0.0, 0.0, 0.0)], "rot_0 double, rot_1 double, rot_2 double, rot_3 double", *quaternion.unit()) == [(1, 0, 0, 0)]


def test_color_bytes(spark):
    got = values(spark, [(b,) for b in range(256)], "b int", color.harmonic_to_byte(color.byte_to_harmonic("b")), color.to_byte(color.dc_to_color(color.byte_to_dc("b"))))
    assert [g[1] for g in got] == list(range(256)) and [g[0] for g in got] == list(range(256))


def test_morton(spark):
    got = values(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1023, 1023, 1023), (5, 0, 3)], "x long, y long, z long", morton.interleave("x", "y", "z"))
    assert [g[0] for g in got] == [1, 2, 4, 2**30 - 1, 0b001100101 & 0 | (1 | 1 << 6) | (4 | 4 << 3)]
    cells = values(spark, [(math.nan, 0.0, 1.0), (1.0, 0.0, 1.0), (0.5, 0.5, 0.5), (-2.0, 0.0, 1.0)], "v double, a double, b double", morton.cell("v", "a", "b"))
    assert [c[0] for c in cells] == [0, 1023, 0, 0]


@pytest.mark.parametrize("band", [1, 2, 3])
def test_harmonic_rotations(band):
    a, b = (rotation_matrix(q) for q in unit_quaternions(2, band))
    A, B, AB = (harmonics.rotation(m, band) for m in (a, b, a @ b))
    assert np.allclose(A @ A.T, np.eye(len(A))) and np.allclose(A @ B, AB) and np.allclose(harmonics.rotation(np.eye(3), band), np.eye(len(A)))
    if band == 1:
        r = a
        assert np.allclose(A, [[r[1, 1], -r[1, 2], r[1, 0]], [-r[2, 1], r[2, 2], -r[2, 0]], [r[0, 1], -r[0, 2], r[0, 0]]])


def test_euler():
    assert np.allclose(rotation_matrix(euler_quaternion((90, 0, 0))) @ [0, 1, 0], [0, 0, 1])
    z, x = rotation_matrix(euler_quaternion((0, 0, 30))), rotation_matrix(euler_quaternion((40, 0, 0)))
    assert np.allclose(rotation_matrix(euler_quaternion((40, 0, 30))), z @ x)


def test_crc(spark):
    assert spark.range(1).select(F.crc32(F.encode(F.lit("123456789"), "utf-8"))).first()[0] == 0xCBF43926


def test_random_hex(spark):
    got = [r[0] for r in spark.range(50).select(numeric.random_hex(8)).collect()]
    assert len(set(got)) == 50 and all(len(g) == 8 and int(g, 16) >= 0 for g in got)
