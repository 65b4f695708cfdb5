"""Cell identifiers of points on a cube-projected sphere with a Hilbert curve.

The published construction: the direction of a point picks a face of the cube;
the face coordinates go through a quadratic transform to 30 bits each, and the
Hilbert position of the pair, with the face before and a final 1 after, is the
64-bit leaf cell. The token is the hexadecimal number without trailing zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the curve: position to (i, j) quadrant for each orientation, and the change of orientation.
_POS_TO_IJ = np.array([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]])
_POS_TO_ORIENTATION = np.array([1, 0, 0, 3])
_IJ_TO_POS = np.argsort(_POS_TO_IJ, axis=1)
_LEVELS = 30


def cell_ids(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Leaf cells as unsigned 64-bit numbers."""
    lon, lat = np.radians(np.asarray(lon, dtype=float)), np.radians(np.asarray(lat, dtype=float))
    p = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    axis = np.argmax(np.abs(p), axis=0)
    n = np.arange(p.shape[1])
    face = np.where(p[axis, n] < 0, axis + 3, axis)
    x, y, z = p
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    st = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(w)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(w)))
    ij = [np.clip(np.floor(st(w) * 2**_LEVELS), 0, 2**_LEVELS - 1).astype(np.int64) for w in (u, v)]
    orientation = (face & 1).astype(np.int64)
    pos = face.astype(np.uint64)
    for level in range(_LEVELS - 1, -1, -1):
        quadrant = (((ij[0] >> level) & 1) << 1) | ((ij[1] >> level) & 1)
        k = _IJ_TO_POS[orientation, quadrant]
        pos = (pos << np.uint64(2)) | k.astype(np.uint64)
        orientation = orientation ^ _POS_TO_ORIENTATION[k]
    return (pos << np.uint64(1)) | np.uint64(1)


def cell_token(ids: np.ndarray) -> list[str]:
    return [f"{int(i):016x}".rstrip("0") or "X" for i in ids]


def cell_center(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of the middle of leaf cells."""
    ids = np.asarray(ids, dtype=np.uint64)
    face = (ids >> np.uint64(61)).astype(np.int64)
    orientation = face & 1
    i, j = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    for level in range(_LEVELS - 1, -1, -1):
        k = ((ids >> np.uint64(2 * level + 1)) & np.uint64(3)).astype(np.int64)
        quadrant = _POS_TO_IJ[orientation, k]
        i, j = (i << 1) | (quadrant >> 1), (j << 1) | (quadrant & 1)
        orientation = orientation ^ _POS_TO_ORIENTATION[k]
    uv = lambda s: np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)
    u, v = uv((i + 0.5) / 2**_LEVELS), uv((j + 0.5) / 2**_LEVELS)
    one = np.ones(len(ids))
    x = np.choose(face, [one, -u, -u, -one, v, v])
    y = np.choose(face, [u, one, -v, -v, -one, u])
    z = np.choose(face, [v, v, one, -u, -u, -one])
    return np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))


@F.pandas_udf(StringType())
def _tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lon, lat in batches:
        known = (lon.notna() & lat.notna()).to_numpy()
        out = np.full(len(lon), None, dtype=object)
        if known.any():
            out[known] = cell_token(cell_ids(lon.to_numpy()[known], lat.to_numpy()[known]))
        yield pd.Series(out)


def cell(lon: Column, lat: Column) -> Column:
    """Token of the leaf cell of a point; NULL without a point."""
    return _tokens(lon, lat)
