"""Queries of the formats and functions that the test tables don't hold: files made of row numbers by rule, so that SQL knows what they decode to."""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.functions import color, numeric, packing, quaternion
from cairn.operators import bounds, clustering, filters, table, trees
from cairn.plans import actions as A
from cairn.queries import query, r6
from cairn.schema import POSITION, ROTATION, bands_of, element_bytes, rest_columns, validate
from cairn.sources import codecs
from cairn.sources.files import write_file, write_tables

_H = "0.7071067811865476e0"


#: Rows, or units of rows, that are made at once.
_MADE = 1 << 16


def _made(s, n: int, block, per: int = _MADE):
    """block(first, end) of all stretches of n numbers, in order: a table that tasks make."""
    steps = -(-n // per)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.record_batch([pa.array([block(k * per, min(n, (k + 1) * per))], pa.binary())], names=["block"])

    return s.sparkSession.range(0, steps, 1, max(1, min(steps, 1024))).mapInArrow(run, "block binary")


def _file(s, name: str, parts: list) -> str:
    from cairn.storage import shared_path

    path = f"{shared_path(s.sparkSession)}/{name}"
    write_tables(s.sparkSession, path, parts)
    return path


def _back(s, path: str, **options):
    from cairn.sources import datasources, registry
    from cairn.storage import materialize

    datasources.register(s.sparkSession)
    reader = s.sparkSession.read.format(registry.by_suffix(path, registry.READ))
    for k, v in options.items():
        reader = reader.option(k, v)
    return materialize(reader.load(path))


def _byte(k: int, salt: int, rows: np.ndarray) -> np.ndarray:
    """The byte that row k's field `salt` holds; SQL has the same rule."""
    return ((rows * (2 * salt + 7) + 13 * salt) % 251 + k).astype(np.uint8)


_B = lambda salt, k=0: f"((row_id * {2 * salt + 7} + {13 * salt}) % 251 + {k})"
_LOGIT = lambda b: f"ln(greatest(1e-6, least(1 - 1e-6, {b} / 255e0)) / (1 - greatest(1e-6, least(1 - 1e-6, {b} / 255e0))))"
_R4 = lambda e, name: f"round(CAST({e} AS FLOAT)::DOUBLE, 4) + 0 AS {name}"  # noqa: E731  what readers give is float
_D4 = lambda e, name: f"round({e}, 4) + 0 AS {name}"


def _r4(c, name):
    return (F.round(F.col(c).cast("double"), 4) + 0.0).alias(name)


def _plane(width: int, salt: int, zipped: bool):
    """Rows of so many bytes, whose fields are numbered from a first salt on."""

    def block(first: int, end: int) -> bytes:
        rows = np.arange(first, end, dtype=np.int64)
        data = np.stack([_byte(0, salt + k, rows) for k in range(width)], 1).tobytes()
        return gzip.compress(data, 1) if zipped else data

    return block


def _spz(s, version: int, degree: int, zipped: bool = False) -> list:
    """Header and planes; of a zipped file each block is a member of its own."""
    n, rest = s.count(), 3 * codecs.BAND_COEFFICIENTS[degree]
    planes = ((9, 0), (1, 9), (3, 10), (3, 13), (3 if version == 2 else 4, 16), (rest, 20))
    head = struct.pack("<IIIBBBB", codecs.SPZ_MAGIC, version, n, degree, 12, 0, 0)
    return [gzip.compress(head, 1) if zipped else head, *[_made(s, n, _plane(w, salt, zipped)) for w, salt in planes if w]]


_FIX = lambda a: f"(CASE WHEN {a} >= 8388608 THEN {a} - 16777216 ELSE {a} END / 4096.0)"
_SPZ = ", ".join([_R4(_FIX(f"({_B(3 * k)} + {_B(3 * k + 1)} * 256 + {_B(3 * k + 2)} * 65536)"), c) for k, c in enumerate(POSITION)] + [_R4(_LOGIT(_B(9)), "opacity"), _R4(f"({_B(10)} / 255e0 - 0.5e0) / 0.15e0", "f_dc_0"), _R4(f"{_B(15)} / 16e0 - 10", "scale_2")])
_XYZ = [f"({_B(16 + k)} / 127.5e0 - 1)" for k in range(3)]


@query(f"SELECT row_id, {_SPZ}, " + ", ".join(_R4(e, f"rot_{k + 1}") for k, e in enumerate(_XYZ)) + f", {_R4('sqrt(greatest(0, 1 - ' + ' - '.join(f'{e} * {e}' for e in _XYZ) + '))', 'rot_0')}, {_R4(f'({_B(20 + 4)} - 128) / 128e0', 'f_rest_4')} FROM splats")
def spz2_decode(s):
    """SPZ of version 2 with one band, in gzip. Coefficients lie by coefficient, then channel: f_rest_4 is the second of the second channel, the fifth byte."""
    back = _back(s, _file(s, "a.spz", _spz(s, 2, 1, zipped=True)))
    assert set(rest_columns(1)) <= set(back.columns)
    return back.select("row_id", *[_r4(c, c) for c in (*POSITION, "opacity", "f_dc_0", "scale_2", *ROTATION, "f_rest_4")])


def _spz3_sql() -> str:
    code = f"({_B(16)} + {_B(17)} * 256 + {_B(18)} * 65536 + {_B(19)} * 16777216)"
    three = ", ".join(f"(CASE WHEN (code >> {s}) & 512 > 0 THEN -1e0 ELSE 1e0 END) * ((code >> {s}) & 511) / 511e0 * {_H} AS t{k}" for k, s in enumerate((20, 10, 0)))
    top = "sqrt(greatest(0, 1 - t0 * t0 - t1 * t1 - t2 * t2))"
    out = ", ".join(_R4(f"CASE WHEN i = {k} THEN {top} WHEN i > {k} THEN t{min(k, 2)} ELSE t{max(k - 1, 0)} END", f"rot_{k}") for k in range(4))
    return f"SELECT row_id, {out} FROM (SELECT row_id, code >> 30 AS i, {three} FROM (SELECT row_id, {code}::BIGINT AS code FROM splats))"


@query(_spz3_sql())
def spz3_decode(s):
    """Rotations of SPZ version 3, without gzip."""
    return _back(s, _file(s, "b.spz", _spz(s, 3, 0))).select("row_id", *[_r4(c, c) for c in ROTATION])


_KS_CAP, _KS_FIRST = 256, 3


def _ksplat_records(before: int, mode: int, degree: int):
    """Records of a section whose first row is `before`."""
    width, number = 3 * codecs.BAND_COEFFICIENTS[degree], "<f4" if mode == 0 else "<f2"

    def block(first: int, end: int) -> bytes:
        rows = np.arange(before + first, before + end, dtype=np.int64)
        p = np.stack([(rows * (2 * j + 7) + 13 * j) % 65521 for j in range(3)], 1)
        sc = np.stack([((rows + j) % 64 + 1) / 64.0 for j in range(3)], 1)
        q = np.stack([((rows * 3 + j) % 33 - 16) / 16.0 for j in range(4)], 1)
        c = np.stack([_byte(0, j, rows) for j in range(4)], 1)
        parts = [(p / 64.0 - 512).astype("<f4") if mode == 0 else p.astype("<u2"), sc.astype(number), q.astype(number), c]
        if width:
            h = np.stack([_byte(0, 10 + j, rows) for j in range(width)], 1)
            parts.append({0: (h / 64.0).astype("<f4"), 1: (h / 64.0).astype("<f2"), 2: h}[mode])
        return np.concatenate([x.view(np.uint8).reshape(len(rows), -1) for x in parts], 1).tobytes()

    return block


def _ksplat_centers(k: int):
    def block(first: int, end: int) -> bytes:
        at = np.arange(first, end)
        return np.stack([at * 1.0 + k * 1000, at * -2.0, np.full(len(at), 0.5)], 1).astype("<f4").tobytes()

    return block


def _ksplat(s, mode: int, degree: int) -> list:
    """Two sections, of a third and the rest of all rows; buckets of _KS_CAP rows, the last of each section partly full."""
    n = s.count()
    sizes = [n // _KS_FIRST, n - n // _KS_FIRST]
    head = bytearray(codecs.KSPLAT_HEADER + 2 * codecs.KSPLAT_SECTION)
    struct.pack_into("<BBxxI", head, 0, 0, 1, 2)
    struct.pack_into("<I", head, 16, n)
    struct.pack_into("<H", head, 20, mode)
    struct.pack_into("<ff", head, 36, -2.0, 2.0)
    body, first = [], 0
    for k, m in enumerate(sizes):
        full, part = divmod(m, _KS_CAP)
        buckets, partial = full + (part > 0), int(part > 0)
        at = codecs.KSPLAT_HEADER + k * codecs.KSPLAT_SECTION
        struct.pack_into("<4I", head, at, m, m, _KS_CAP, buckets)
        struct.pack_into("<fH", head, at + 16, 8.0, 12)
        struct.pack_into("<I", head, at + 24, 0)
        struct.pack_into("<IIH", head, at + 32, full, partial, degree)
        body += [np.array([part] * partial, "<u4").tobytes(), _made(s, buckets, _ksplat_centers(k)), _made(s, m, _ksplat_records(first, mode, degree))]
        first += m
    return [bytes(head), *body]


_IN = f"(SELECT count(*) // {_KS_FIRST} FROM splats)"
_KS = f"SELECT row_id, CASE WHEN row_id < {_IN} THEN 0 ELSE 1 END AS k, row_id - CASE WHEN row_id < {_IN} THEN 0 ELSE {_IN} END AS own FROM splats"
_KP = [f"((row_id * {2 * j + 7} + {13 * j}) % 65521)" for j in range(3)]
_KREST = [_R4(f"ln(((row_id + {j}) % 64 + 1) / 64e0)", f"scale_{j}") for j in range(3)] + [_R4(f"((row_id * 3 + {j}) % 33 - 16) / 16e0", f"rot_{j}") for j in range(4)]
_KREST += [_R4(f"({_B(1)} / 255e0 - 0.5e0) / 0.28209479177387814e0", "f_dc_1"), _R4(_LOGIT(_B(3)), "opacity")]
_KCOLUMNS = [*POSITION, "scale_0", "scale_1", "scale_2", *ROTATION, "f_dc_1", "opacity"]


@query("SELECT row_id, " + ", ".join([*(_R4(f"{e} / 64e0 - 512", c) for e, c in zip(_KP, POSITION, strict=True)), *_KREST]) + ", " + ", ".join(_R4(f"{_B(10 + j)} / 64e0", f"f_rest_{i}") for j, i in ((0, 0), (4, 4), (8, 8))) + " FROM splats")
def ksplat0_decode(s):
    """KSPLAT without compression, two sections, one band: its coefficients lie channel by channel."""
    back = _back(s, _file(s, "a.ksplat", _ksplat(s, 0, 1)))
    return back.select("row_id", *[_r4(c, c) for c in (*_KCOLUMNS, "f_rest_0", "f_rest_4", "f_rest_8")])


_CENTER = [f"(own // {_KS_CAP} + k * 1000)", f"(own // {_KS_CAP}) * -2.0", "0.5e0"]


def _ks_packed(extra: str = "") -> str:
    place = [_R4(f"({e} - 32767) * (4e0 / 32767) + {c}", n) for e, c, n in zip(_KP, _CENTER, POSITION, strict=True)]
    return f"SELECT row_id, {', '.join([*place, *_KREST])}{extra} FROM ({_KS})"


@query(_ks_packed())
def ksplat1_decode(s):
    """KSPLAT of 16-bit numbers: positions are offsets from the centre of their bucket, of which each section's last is partly full."""
    return _back(s, _file(s, "b.ksplat", _ksplat(s, 1, 0))).select("row_id", *[_r4(c, c) for c in _KCOLUMNS])


# of two bands the second's five coefficients of a channel follow all of the first's nine
_KS2 = {0: 0, 2: 2, 3: 9, 8: 3, 15: 18, 23: 23}


@query(_ks_packed(", " + ", ".join(_R4(f"-2 + {_B(10 + j)} / 255e0 * 4", f"f_rest_{i}") for i, j in _KS2.items())))
def ksplat2_decode(s):
    """KSPLAT of bytes: harmonics of two bands between the file's bounds, band by band, then channel by channel."""
    return _back(s, _file(s, "c.ksplat", _ksplat(s, 2, 2))).select("row_id", *[_r4(c, c) for c in (*_KCOLUMNS, *(f"f_rest_{i}" for i in _KS2))])


_LCC_UNIT = 500


def _lcc_size(u, lod: int, n: int):
    """Rows of units u at a level."""
    return (np.clip(n - np.asarray(u) * _LCC_UNIT, 0, _LCC_UNIT) + 1 - lod) // 2


def _lcc_index(n: int):
    def block(first: int, end: int) -> bytes:
        u = np.arange(first, end)
        r = np.zeros(len(u), [("x", "<i2"), ("y", "<i2"), ("lods", [("points", "<i4"), ("offset", "<i8"), ("size", "<i4")], 2)])
        r["x"], r["y"] = u % 100, u // 100 % 30_000
        for lod in range(2):
            m = _lcc_size(u, lod, n)
            r["lods"]["points"][:, lod], r["lods"]["size"][:, lod] = m, m * codecs.LCC_RECORD.itemsize
            r["lods"]["offset"][:, lod] = (u * _LCC_UNIT + lod * _lcc_size(u, 0, n)) * codecs.LCC_RECORD.itemsize
        return r.tobytes()

    return block


def _lcc_records(first: int, end: int) -> bytes:
    """Of rows of whole units; the last may be shorter."""
    rows = np.arange(first, end, dtype=np.int64)
    rows = rows[np.lexsort((rows, rows % 2, rows // _LCC_UNIT))]
    r = np.zeros(len(rows), codecs.LCC_RECORD)
    r["p"] = np.stack([rows % 1000, rows // 1000, -rows % 77], 1)
    r["color"] = np.stack([_byte(1, j, rows) for j in range(4)], 1)
    r["scale"] = (rows * 2654435761) % (1 << 32)
    r["rotation"] = (rows * 40503) % (1 << 32)
    return r.tobytes()


def _lcc(s, n: int) -> str:
    """meta.lcc, index.bin and data.bin of units of _LCC_UNIT rows with levels 0 and 1: a unit's odd rows are its level 1."""
    from cairn.storage import shared_path

    folder = shared_path(s.sparkSession)
    meta = {"totalLevel": 2, "attributes": [{"name": "scale", "min": [0.01, 0.02, 0.04], "max": [1.0, 2.0, 4.0]}]}
    write_tables(s.sparkSession, f"{folder}/index.bin", [_made(s, -(-n // _LCC_UNIT), _lcc_index(n))])
    write_tables(s.sparkSession, f"{folder}/data.bin", [_made(s, n, _lcc_records, 128 * _LCC_UNIT)])
    write_file(f"{folder}/meta.lcc", iter([json.dumps(meta).encode()]))
    return f"{folder}/meta.lcc"


_LS = "((row_id * 2654435761::HUGEINT) % 4294967296)::BIGINT"
_LT = "((row_id * 40503::HUGEINT) % 4294967296)::BIGINT"
_MIX = lambda lo, hi, bits, shift: f"ln({lo}e0 * (1 - ((code >> {shift}) & {(1 << bits) - 1}) / {(1 << bits) - 1}e0) + {hi}e0 * ((code >> {shift}) & {(1 << bits) - 1}) / {(1 << bits) - 1}e0)"
_LTHREE = ", ".join(f"(((turn >> {k}) & 1023) / 1023e0 - 0.5e0) * 1.4142135623730951e0 AS t{j}" for j, k in enumerate((0, 10, 20)))
_LTOP = "sqrt(greatest(0, 1 - t0 * t0 - t1 * t1 - t2 * t2))"


def _lcc_sql(where: str = "") -> str:
    rot = ", ".join(_R4(f"CASE WHEN i = {k} THEN {_LTOP} WHEN i > {k} THEN t{min(k, 2)} ELSE t{max(k - 1, 0)} END", f"rot_{k}") for k in range(4))
    scale = ", ".join(_R4(_MIX(lo, hi, b, sh), f"scale_{k}") for k, (lo, hi, b, sh) in enumerate((("0.01", "1.0", 11, 0), ("0.02", "2.0", 10, 11), ("0.04", "4.0", 11, 21))))
    alpha = f"-ln((255 - {_B(3, 1)}) / ({_B(3, 1)} * 1e0))"
    return f"""SELECT (row_id % 1000)::DOUBLE AS x, (row_id // 1000)::DOUBLE AS y, (row_id % 2)::DOUBLE AS lod, {scale}, {rot}, {_R4(alpha, 'opacity')} FROM (
      SELECT *, turn >> 30 AS i, {_LTHREE} FROM (SELECT row_id, {_LS} AS code, {_LT} AS turn FROM splats {where}))"""


_LCOLUMNS = ["scale_0", "scale_1", "scale_2", *ROTATION, "opacity"]


@query(_lcc_sql())
def lcc_decode(s):
    """All levels of an LCC scene; data.bin holds this package's own records."""
    back = _back(s, _lcc(s, s.count()))
    return back.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "lod")], *[_r4(c, c) for c in _LCOLUMNS])


@query(_lcc_sql("WHERE row_id % 2 = 1"))
def lcc_one_level(s):
    """The index's byte ranges of one level alone are read."""
    back = _back(s, _lcc(s, s.count()), lods="1")
    return back.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "lod")], *[_r4(c, c) for c in _LCOLUMNS])


# packed numbers without files


@query(f"SELECT row_id, " + ", ".join(_D4(f"CASE WHEN tag < 252 THEN {float(k == 3)}e0 WHEN tag - 252 = {k} THEN sqrt(greatest(0, 1 - a0 * a0 - a1 * a1 - a2 * a2)) WHEN tag - 252 > {k} THEN a{min(k, 2)} ELSE a{max(k - 1, 0)} END", f"rot_{k}") for k in range(4)) + " FROM (SELECT row_id, 248 + row_id % 8 AS tag, " + ", ".join(f"({_B(k)} / 255e0 - 0.5e0) * 1.4142135623730951e0 AS a{k}" for k in range(3)) + " FROM splats)")
def sog_quat_unpack(s):
    b = lambda k: (F.col("row_id") * (2 * k + 7) + 13 * k) % 251
    q = quaternion.unpack_sog(b(0), b(1), b(2), F.lit(248) + F.col("row_id") % 8)
    return s.select("row_id", *[(F.round(c, 4) + 0.0).alias(f"rot_{k}") for k, c in enumerate(q)])


@query(f"SELECT row_id, " + ", ".join(_D4(f"{lo}e0 * (1 - ((code >> {sh}) & {(1 << b) - 1}) / {(1 << b) - 1}e0) + {hi}e0 * ((code >> {sh}) & {(1 << b) - 1}) / {(1 << b) - 1}e0", f"s{k}") for k, (lo, hi, b, sh) in enumerate((("-1.0", "1.0", 11, 0), ("0.0", "5.0", 10, 11), ("2.0", "3.0", 11, 21)))) + f" FROM (SELECT row_id, {_LS} AS code FROM splats)")
def lcc_scale_unpack(s):
    code = ((F.col("row_id").cast("decimal(38,0)") * 2654435761) % (1 << 32)).cast("long")
    out = packing.unpack_lcc_scale(code, (-1.0, 0.0, 2.0), (1.0, 5.0, 3.0))
    return s.select("row_id", *[(F.round(c, 4) + 0.0).alias(f"s{k}") for k, c in enumerate(out)])


@query(f"SELECT row_id, {', '.join(_D4(f'CASE WHEN i = {k} THEN {_LTOP} WHEN i > {k} THEN t{min(k, 2)} ELSE t{max(k - 1, 0)} END', f'rot_{k}') for k in range(4))} FROM (SELECT *, turn >> 30 AS i, {_LTHREE} FROM (SELECT row_id, {_LT} AS turn FROM splats))")
def lcc_rotation_unpack(s):
    q = quaternion.unpack_lcc((F.col("row_id") * 40503) % (1 << 32))
    return s.select("row_id", *[(F.round(c, 4) + 0.0).alias(f"rot_{k}") for k, c in enumerate(q)])


@query("SELECT row_id, CASE WHEN p <= 0 THEN 'low' WHEN p >= 1 THEN 'high' ELSE printf('%.5f', ln(p / (1 - p))) END AS v, CAST(greatest(0, least(255, round(p * 255))) AS BIGINT) AS b FROM (SELECT row_id, (row_id % 1007 - 3) / 1000e0 AS p FROM splats)")
def inverse_sigmoid_and_byte(s):
    p = s.select("row_id", ((F.col("row_id") % 1007 - 3) / 1000.0).alias("p"))
    v = numeric.inverse_sigmoid("p")
    named = F.when(v == -float("inf"), "low").when(v == float("inf"), "high").otherwise(F.format_string("%.5f", v))
    return p.select("row_id", named.alias("v"), color.to_byte("p").alias("b"))


# tables


@query("SELECT row_id, round(x, 6) + 0 AS x, row_id * 3 AS tripled FROM splats")
def add_and_drop_columns(s):
    """A column is added by row number, others go."""
    added = table.add_column(s, "tripled", s.select("row_id", (F.col("row_id") * 3).alias("tripled")))
    return table.drop_columns(added, *[c for c in s.columns if c not in ("row_id", "x")]).select("row_id", r6("x", "x"), "tripled")


@query("SELECT row_id, CAST(row_id % 100 AS INTEGER) AS small, CAST(row_id AS VARCHAR) || '.5' AS t, row_id + 0.5e0 AS parsed, NULL::DOUBLE AS bad FROM splats")
def checked_cast_and_parse(s):
    from pyspark.sql.types import IntegerType

    t = F.concat(F.col("row_id").cast("string"), F.lit(".5"))
    return s.select("row_id", table.checked((F.col("row_id") % 100).cast("double"), IntegerType()).alias("small"), t.alias("t"), table.parse(t, "double").alias("parsed"), table.parse(F.concat(t, F.lit("x")), "double", strict=False).alias("bad"))


@query("SELECT 16::BIGINT AS columns, 120::BIGINT AS row_bytes, count(*) AS n, 120 * count(*) AS bytes, 0::BIGINT AS bands FROM splats")
def column_facts(s):
    """How many columns there are, their bytes, and the bands of harmonics: from the schema and a count."""
    wide = [f for f in validate(s).schema.fields if f.name != "row_id"]
    size = sum(map(element_bytes, wide))
    return s.agg(F.lit(len(s.columns)).cast("long").alias("columns"), F.lit(size).cast("long").alias("row_bytes"), F.count("*").alias("n"), (F.lit(size) * F.count("*")).cast("long").alias("bytes"), F.lit(bands_of(s.columns)).cast("long").alias("bands"))


@query("SELECT row_id, 2e0 AS lod, round(y, 6) + 0 AS y FROM splats WHERE x * y > 0 AND row_id % 3 <> 1")
def row_predicate(s):
    """Any condition as an action, a parameter that leaves the table as it is, and a level for all rows."""
    plan = A.Plan([A.FilterRows(lambda df: df["x"] * df["y"] > 0), A.Param("a", "b"), A.FilterRows(F.col("row_id") % 3 != 1), A.Lod(2.0)])
    out = plan(s)
    if plan.params != {"a": "b"}:
        raise AssertionError("the parameter is lost")
    return out.select("row_id", F.col("lod").cast("double").alias("lod"), r6("y", "y"))


@query("SELECT lod, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS axis, round(greatest(a, b, c), 6) + 0 AS size FROM (SELECT lod, max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c FROM splats GROUP BY lod)")
def widest_axis(s):
    ends = s.groupBy("lod").agg(*bounds.extents(POSITION))
    at, size = bounds.widest(POSITION)
    return ends.select("lod", at.alias("axis"), r6(size, "size"))


@query("SELECT n, CASE WHEN n < 1024 THEN greatest(1, n) ELSE 1024 * least(64, pow(2, floor(log2(n // 1024)))::BIGINT) END AS size FROM (SELECT row_id * 37 AS n FROM splats)")
def palette_sizes(s):
    n = F.col("row_id") * 37
    sizes = F.udf(lambda v: clustering.palette_size(v), "long")
    return s.select(n.alias("n"), sizes(n).alias("size"))


@query("SELECT file, level, count(*) AS units, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unit % 3 AS level, n, (sum(n) OVER (PARTITION BY unit % 3 ORDER BY unit) - n) // 1000 AS file FROM (SELECT row_id // 100 AS unit, 100 AS n FROM splats WHERE row_id // 100 < (SELECT count(*) // 100 FROM splats) GROUP BY 1)) GROUP BY ALL")
def lod_rolling(s):
    """Units of 100 rows are laid into files: the tenth makes one grow beyond 999, and the next begins anew."""
    counts = s.groupBy(F.expr("row_id div 100").alias("unit")).agg(F.count("*").alias("n")).where("n = 100").select(F.col("unit").alias("node"), (F.col("unit") % 3).cast("double").alias("lod"), "n")
    placed = trees.roll_files(counts, chunk_rows=999, by="node")
    return placed.groupBy("file", F.col("lod").cast("long").alias("level")).agg(F.count("*").alias("units"), F.sum("n").alias("n"))


@query("SELECT count(*) AS n, count(*) AS different, 12::BIGINT AS least, 12::BIGINT AS most FROM splats")
def random_hex_digits(s):
    """Twelve random digits a row, which are shuffled row numbers: no two rows share theirs."""
    h = s.select(numeric.random_hex(12, of="row_id").alias("h")).where("h RLIKE '^[0-9a-f]{12}$'")
    return h.agg(F.count("*").alias("n"), F.count_distinct("h").alias("different"), F.min(F.length("h")).cast("long").alias("least"), F.max(F.length("h")).cast("long").alias("most"))


assert filters and ROTATION
