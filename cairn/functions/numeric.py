"""Scalar functions. Logarithms of 0 are -Infinity, not NULL, and nothing here raises on numbers."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def ln(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.ln(x)).when(x == 0, -INF).otherwise(F.when(x.isNotNull(), NAN))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def logit(p, eps: float = 1e-6) -> Column:
    """The inverse of sigmoid, of p kept eps from 0 and 1."""
    p = clamp(p, eps, 1 - eps)
    return F.ln(p / (1 - p))


def logit_open(p, eps: float = 1e-7) -> Column:
    """As logit, but only the lower end is kept away from: 1 gives Infinity."""
    p = F.greatest(F.lit(eps), col(p))
    return F.when(p >= 1, INF).otherwise(F.ln(p / F.when(p < 1, 1 - p)))


def inverse_sigmoid(p) -> Column:
    """As logit, up to both ends: 0 gives -Infinity, 1 Infinity."""
    p = col(p)
    return F.when(p <= 0, -INF).when(p >= 1, INF).otherwise(F.ln(p / F.when(p < 1, 1 - p)))


def symlog(v) -> Column:
    v = col(v)
    return F.signum(v) * F.log1p(F.abs(v))


def symexp(v) -> Column:
    v = col(v)
    return F.signum(v) * F.expm1(F.abs(v))


def lerp(a, b, t) -> Column:
    return col(a) * (1 - col(t)) + col(b) * col(t)


def normalize(x, lo, hi) -> Column:
    """x between lo and hi as 0 to 1; all 0 if they are less than 1e-5 apart."""
    x, lo, hi = col(x), col(lo), col(hi)
    return F.when(x <= lo, 0.0).when(x >= hi, 1.0).when(hi - lo < 1e-5, 0.0).otherwise((x - lo) / F.when(hi - lo >= 1e-5, hi - lo))


def is_finite(x) -> Column:
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) < INF)


def fixed24(lo, mid, hi, fraction_bits: int) -> Column:
    """Three bytes as a signed fixed-point number."""
    v = col(lo).cast("long") + col(mid) * 256 + col(hi) * 65536
    return F.when(v >= 1 << 23, v - (1 << 24)).otherwise(v) / float(1 << fraction_bits)


def half(bits) -> Column:
    """Sixteen bits as a half-precision number: subnormals, infinities and NaN too."""
    b = col(bits).cast("long")
    e, m = F.shiftright(b, 10).bitwiseAND(31), b.bitwiseAND(1023)
    v = F.when(e == 31, F.when(m == 0, INF).otherwise(NAN)).when(e == 0, m * 2.0**-24).otherwise((1 + m / 1024.0) * F.pow(F.lit(2.0), e - 15))
    return F.when(b.bitwiseAND(1 << 15) != 0, -v).otherwise(v)


def random_hex(digits: int, of=None) -> Column:
    """So many random hexadecimal digits, at most 32; another row, another text, but for chance.

    With `of`, a column of different whole numbers from 0 below 16 ** digits (at most 15 digits), no two rows have the same text: the numbers are
    shuffled by four rounds of a Feistel network whose keys are drawn for each call.
    """
    if of is None:
        return F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, digits)
    if digits > 15:
        raise ValueError("at most 15 digits of a number")
    bits = 2 * digits
    mask = (1 << bits) - 1
    left, right = F.shiftright(col(of).cast("long"), bits), col(of).cast("long").bitwiseAND(mask)
    for _ in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(secrets.randbits(62))).bitwiseAND(mask))
    return F.lower(F.lpad(F.hex(F.shiftleft(left, bits).bitwiseOR(right)), digits, "0"))


#: The generator's multiplier, increment, modulus and first seed.
LCG_A, LCG_C, LCG_M, LCG_SEED = 1103515245, 12345, 2**31, 42


def lcg_state(n: int, seed: int = LCG_SEED) -> int:
    """The state after n steps, by doubling: any task can begin anywhere in the sequence."""
    a, c, at, add = LCG_A, LCG_C, 1, 0
    while n:
        if n & 1:
            at, add = at * a % LCG_M, (add * a + c) % LCG_M
        a, c, n = a * a % LCG_M, (a + 1) * c % LCG_M, n >> 1
    return (at * seed + add) % LCG_M


def lcg_table(spark, n: int, seed: int = LCG_SEED):
    """(i, value) for the first n values, 0 to 1; each partition jumps to its own first state."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            i = np.asarray(b.column(0))
            out, s = np.empty(len(i)), None
            for k, x in enumerate(i.tolist()):
                s = (LCG_A * s + LCG_C) % LCG_M if s is not None and k and x == i[k - 1] + 1 else lcg_state(x + 1, seed)
                out[k] = s / (LCG_M - 1)
            yield pa.record_batch([b.column(0), pa.array(out)], names=["i", "value"])

    return spark.range(n).mapInArrow(run, "i long, value double")
