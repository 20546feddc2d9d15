"""Tables laid out by pixel, and cones as ranges of pixels that prune them before any trigonometry.

Nested pixel numbers keep what is near on the sky near in order, so a cone is a few
ranges of them. A table sorted by its pixel has narrow ranges in the statistics of
its row groups, and a range that is a comparison of the stored column reaches the scan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ring and longitude of the southern corner of each of the twelve base pixels.
RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
TURN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _vectors(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors (n, 3) of places in base pixels, x and y in 0..1."""
    ring = np.take(RING, face) - x - y
    width = np.where(ring < 1, ring, np.where(ring > 3, 4 - ring, 1.0))
    z = np.where(ring < 1, 1 - width**2 / 3, np.where(ring > 3, width**2 / 3 - 1, (2 - ring) * 2 / 3))
    phi = math.pi / 4 * (np.take(TURN, face) * width + x - y) / np.where(width > 0, width, 1.0)
    r = np.sqrt(np.maximum(0.0, 1 - z * z))
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], -1)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(-1)) / 2))


def pixel_frames(pix: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres (unit vectors) of nested pixels, and a radius (radians) that certainly holds each."""
    face, rest = pix >> (2 * order), pix & ((1 << 2 * order) - 1)
    x, y = np.zeros(len(pix)), np.zeros(len(pix))
    for i in range(order):
        x += ((rest >> 2 * i) & 1) << i
        y += ((rest >> (2 * i + 1)) & 1) << i
    n = float(1 << order)
    centre = _vectors(face, (x + 0.5) / n, (y + 0.5) / n)
    # the boundary is sampled, not only its corners, and given a tenth more
    ends = [(a, b) for t in (0.0, 0.25, 0.5, 0.75, 1.0) for a, b in ((t, 0.0), (t, 1.0), (0.0, t), (1.0, t))]
    radius = np.max([_angle(centre, _vectors(face, (x + a) / n, (y + b) / n)) for a, b in ends], 0)
    return centre, 1.1 * radius


def disc_ranges(lon: float, lat: float, radius: float, order: int, most: int = 64) -> list[tuple[int, int]]:
    """Half-open ranges of nested pixels of ``order`` that hold every position within ``radius`` degrees, ``most`` at most.

    Pixels are split where the disc's edge may pass, down to ``order``; whole ones are taken as they are, so ranges are of
    mixed orders. Where there are too many, the closest ones are joined: the cover grows, the disc stays covered.
    """
    a, d = math.radians(lon), math.radians(lat)
    at = np.array([math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)])
    r, pix, found = math.radians(radius), np.arange(12, dtype=np.int64), []
    for o in range(order + 1):
        centre, size = pixel_frames(pix, o)
        far = _angle(centre, at)
        pix, inside = pix[far <= r + size], (far + size <= r)[far <= r + size]
        whole = pix if o == order else pix[inside]
        found += [(int(p) << 2 * (order - o), int(p + 1) << 2 * (order - o)) for p in whole]
        pix = (pix[~inside][:, None] * 4 + np.arange(4)).ravel()
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[i : i + 2] = [[out[i][0], out[i + 1][1]]]
    return [(lo, hi) for lo, hi in out]


def within_ranges(pix: Column, ranges: list[tuple[int, int]]) -> Column:
    """The stored pixel lies in one of the ranges; plain comparisons, which scans take as filters."""
    out = F.lit(False)
    for i, (lo, hi) in enumerate(ranges):
        here = (pix >= lo) & (pix < hi)
        out = here if i == 0 else out | here
    return out


def cone_cell(lon: float, lat: float, radius: float, order: int, finer: int = 4) -> int | None:
    """the pixel of ``order`` that certainly holds the whole cone, else None."""
    cells = {p >> 2 * finer for lo, hi in disc_ranges(lon, lat, radius, order + finer, 1 << 20) for p in ({lo, hi - 1} if hi - lo < 1 << 2 * finer else range(lo, hi, 1 << 2 * finer))}
    return cells.pop() if len(cells) == 1 else None


def write_clustered(df: DataFrame, path: str, pix: str, files: int, by: list[str] | None = None, row_group: int = 32 << 20, then: list[str] | None = None) -> None:
    """``df`` as Parquet in order of ``pix``, in about ``files`` ranges (a folder for each value of ``by``, which must be few, such as roles).

    A range of pixels then meets few files and row groups, whose statistics are narrow. ``then`` orders rows of one pixel.
    """
    order = [*(by or []), pix, *(then or [])]
    w = df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", row_group)
    (w.partitionBy(*by) if by else w).parquet(path)


def read_cone(spark: SparkSession, path: str, pix: str, lon: float, lat: float, radius: float, order: int, most: int = 64) -> DataFrame:
    """The rows of a clustered table that may lie in a cone: what the scan's filters leave; the exact distance is the caller's."""
    return spark.read.parquet(path).filter(within_ranges(F.col(pix), disc_ranges(lon, lat, radius, order, most)))


def training_rows(spark: SparkSession, path: str, roles: list[str], z: tuple[float, float], role_col: str = "role", z_col: str = "z") -> DataFrame:
    """Rows of some roles in a half-open redshift range: folders and row groups of others are not read."""
    return spark.read.parquet(path).filter(F.col(role_col).isin(roles) & (F.col(z_col) >= z[0]) & (F.col(z_col) < z[1]))
