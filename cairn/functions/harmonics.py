"""Rotation of spherical harmonics of bands 1 to 3.

The matrices are found where they are needed, on the driver: a rotated function at a direction is the function at the direction
turned back, so B(d) M = B(R'd) over many directions d, solved by least squares.
"""

from __future__ import annotations

import numpy as np

from cairn.schema import BAND_COEFFICIENTS

#: The real basis's factors, by band and order, as Gaussian splatting uses them.
C1 = 0.4886025119029199
C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)
#: Where each band's coefficients lie within a channel.
BLOCKS = {1: slice(0, 3), 2: slice(3, 8), 3: slice(8, 15)}


def basis(d: np.ndarray, band: int) -> np.ndarray:
    """The band's functions at unit directions, a row each."""
    x, y, z = d.T
    if band == 1:
        cols = [-C1 * y, C1 * z, -C1 * x]
    elif band == 2:
        cols = [C2[0] * x * y, C2[1] * y * z, C2[2] * (2 * z * z - x * x - y * y), C2[3] * x * z, C2[4] * (x * x - y * y)]
    else:
        r = 4 * z * z - x * x - y * y
        cols = [C3[0] * y * (3 * x * x - y * y), C3[1] * x * y * z, C3[2] * y * r, C3[3] * z * (2 * z * z - 3 * x * x - 3 * y * y), C3[4] * x * r, C3[5] * z * (x * x - y * y), C3[6] * x * (x * x - 3 * y * y)]
    return np.stack(cols, 1)


def rotation(matrix: np.ndarray, band: int) -> np.ndarray:
    """The band's matrix: coefficients after the rotation from those before."""
    d = np.random.default_rng(0).normal(size=(96, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return np.linalg.lstsq(basis(d, band), basis(d @ matrix, band), rcond=None)[0]


def rotations(matrix: np.ndarray, bands: int) -> np.ndarray:
    """One block-diagonal matrix for the coefficients of a channel."""
    out = np.zeros((BAND_COEFFICIENTS[bands],) * 2)
    for b in range(1, bands + 1):
        out[BLOCKS[b], BLOCKS[b]] = rotation(matrix, b)
    return out
