"""Quaternions (w, x, y, z) as four columns, and their packed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.numeric import clamp, col
from cairn.schema import ROTATION

SQRT2 = math.sqrt(2.0)


def columns(q) -> list[Column]:
    return [col(c) for c in q]


def norm(q=ROTATION) -> Column:
    w, x, y, z = columns(q)
    return F.sqrt(w * w + x * x + y * y + z * z)


def unit(q=ROTATION, otherwise=(1.0, 0.0, 0.0, 0.0)) -> list[Column]:
    """q over its length; `otherwise` for a quaternion of length 0."""
    n = norm(q)
    return [F.when(n > 0, c / F.when(n > 0, n)).otherwise(d) for c, d in zip(columns(q), otherwise, strict=True)]


def multiply(a, b) -> list[Column]:
    """The product a b: b's rotation, then a's."""
    (w, x, y, z), (W, X, Y, Z) = columns(a), columns(b)
    return [w * W - x * X - y * Y - z * Z, w * X + x * W + y * Z - z * Y, w * Y - x * Z + y * W + z * X, w * Z + x * Y - y * X + z * W]


def matrix(q) -> list[list[Column]]:
    """The rotation of a unit quaternion, by rows."""
    w, x, y, z = columns(q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def largest(q) -> Column:
    """The place of the component that is largest by absolute value, the first of equals."""
    a = [F.abs(c) for c in columns(q)]
    top = F.greatest(*a)
    return F.when(a[0] == top, 0).when(a[1] == top, 1).when(a[2] == top, 2).otherwise(3)


def others(q) -> list[Column]:
    """The three components besides the largest, in order, signed so that the largest is positive."""
    i, c = largest(q), columns(q)
    sign = F.when(F.element_at(F.array(*c), i + 1) < 0, -1.0).otherwise(1.0)
    return [sign * F.when(i <= k, c[k + 1]).otherwise(c[k]) for k in range(3)]


def restore(index, three) -> list[Column]:
    """The unit quaternion of which three are the components besides that at index."""
    a = columns(three)
    top = F.sqrt(F.greatest(F.lit(0.0), 1 - (a[0] * a[0] + a[1] * a[1] + a[2] * a[2])))
    i = col(index)
    pick = lambda k: F.when(i == k, top).otherwise(F.when(i > k, a[min(k, 2)]).otherwise(a[max(k - 1, 0)]))
    return [pick(k) for k in range(4)]


def pack_smallest_three(q=ROTATION) -> Column:
    """Two bits of place and three times ten of the other components, in a long."""
    q = unit(q)
    out = largest(q).cast("long")
    for c in others(q):
        out = F.shiftleft(out, 10).bitwiseOR(clamp(F.floor((c * (SQRT2 * 0.5) + 0.5) * 1023 + 0.5), 0, 1023).cast("long"))
    return out


def unpack_smallest_three(code) -> list[Column]:
    code = col(code)
    three = [(F.shiftright(code, s).bitwiseAND(1023) / 1023.0 - 0.5) * SQRT2 for s in (20, 10, 0)]
    return restore(F.shiftright(code, 30).bitwiseAND(3), three)


def pack_sog(q=ROTATION) -> list[Column]:
    """Four bytes: the other components cut to 8 bits, then 252 and the place."""
    q = unit(q)
    return [*(clamp(F.floor(255 * (c * SQRT2 * 0.5 + 0.5)), 0, 255).cast("long") for c in others(q)), (largest(q) + 252).cast("long")]


def unpack_sog(r, g, b, a) -> list[Column]:
    """As pack_sog wrote it; a tag below 252 gives (0, 0, 0, 1)."""
    tag = col(a) - 252
    q = restore(tag, [(col(c) / 255.0 - 0.5) * SQRT2 for c in (r, g, b)])
    return [F.when(tag >= 0, c).otherwise(d) for c, d in zip(q, (0.0, 0.0, 0.0, 1.0), strict=True)]


def unpack_lcc(code) -> list[Column]:
    """Three times ten bits from the low end, then two bits of place."""
    code = col(code)
    return restore(F.shiftright(code, 30).bitwiseAND(3), [(F.shiftright(code, s).bitwiseAND(1023) / 1023.0 - 0.5) * SQRT2 for s in (0, 10, 20)])


def unpack_spz2(x, y, z) -> list[Column]:
    """Three bytes for x, y, z; w is what makes it a unit, and positive."""
    a = [col(c) / 127.5 - 1.0 for c in (x, y, z)]
    return [F.sqrt(F.greatest(F.lit(0.0), 1 - (a[0] * a[0] + a[1] * a[1] + a[2] * a[2]))), *a]


def unpack_spz3(code) -> list[Column]:
    """Two bits of place, and for the other components, the last lowest, nine bits of size under one of sign."""
    code = col(code)
    three = []
    for s in (20, 10, 0):
        v = F.shiftright(code, s)
        size = v.bitwiseAND(511) / 511.0 * (SQRT2 / 2)
        three.append(F.when(v.bitwiseAND(512) != 0, -size).otherwise(size))
    return restore(F.shiftright(code, 30).bitwiseAND(3), three)
