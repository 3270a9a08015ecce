"""Map projections and boxes as column expressions; planar point-in-polygon and rectangle clipping as NumPy kernels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = 2 * FLATTENING - FLATTENING**2
ECC = math.sqrt(E2)


@dataclass(frozen=True)
class Box:
    xmin: float
    xmax: float
    ymin: float
    ymax: float

    def padded(self, degrees: float) -> Box:
        return Box(self.xmin - degrees, self.xmax + degrees, self.ymin - degrees, self.ymax + degrees)


EAST_AFRICA = Box(27.0, 44.5, -5.0, 17.5)
#: Map windows of single markers.
WINDOWS = {
    "k13:675:V": Box(28.0, 37.0, -4.0, 5.0), "k13:comb": Box(28.0, 48.0, -4.6, 18.0),
    "k13:622:I": Box(32.0, 45.0, 4.0, 17.0), "k13:561:H": Box(28.0, 32.0, -4.0, 0.0),
}


def window_of(mutation: str) -> Box:
    if mutation not in WINDOWS:
        raise ValueError(f"no map window for {mutation!r}; known are {sorted(WINDOWS)}")
    return WINDOWS[mutation]


def _q(sin_lat):
    """Authalic q of a sine of latitude, for columns and floats."""
    ln = F.ln if isinstance(sin_lat, Column) else math.log
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat * sin_lat) - ln((1 - ECC * sin_lat) / (1 + ECC * sin_lat)) / (2 * ECC))


def laea_km(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Ellipsoidal Lambert azimuthal equal-area coordinates in km around (lon0, lat0)."""
    qp = _q(1.0)
    phi0 = math.radians(lat0)
    beta0 = math.asin(_q(math.sin(phi0)) / qp)
    rq = A * math.sqrt(qp / 2)
    d = A * math.cos(phi0) / math.sqrt(1 - E2 * math.sin(phi0) ** 2) / (rq * math.cos(beta0))
    beta = F.asin(_q(F.sin(F.radians(lat))) / qp)
    turn = F.radians(lon - lon0)
    sin_b, cos_b = F.sin(beta), F.cos(beta)
    b = rq * F.sqrt(2 / (1 + math.sin(beta0) * sin_b + math.cos(beta0) * cos_b * F.cos(turn)))
    return b * d * cos_b * F.sin(turn) / 1000, b / d * (math.cos(beta0) * sin_b - math.sin(beta0) * cos_b * F.cos(turn)) / 1000


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator (EPSG 3857) in metres."""
    return A * F.radians(lon), A * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def inside(x: np.ndarray, y: np.ndarray, rings: list) -> np.ndarray:
    """Which points lie in a polygon (even-odd over all its rings); points on an edge count as inside."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        r = np.asarray([(p["x"], p["y"]) for p in ring] if len(ring) and not isinstance(ring[0], (tuple, list, np.ndarray)) else ring, float)
        if len(r) < 3:
            continue
        if (r[0] != r[-1]).any():
            r = np.vstack([r, r[:1]])
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            edge |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
            spans = (ay > y) != (by > y)
            if by != ay:
                odd ^= spans & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd | edge


def clip_ring(ring: list[tuple[float, float]], box: Box) -> list[tuple[float, float]]:
    """A ring cut to a rectangle, side by side; an empty list if nothing remains."""
    for axis, bound, sign in ((0, box.xmin, 1), (0, box.xmax, -1), (1, box.ymin, 1), (1, box.ymax, -1)):
        out: list[tuple[float, float]] = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ka, kb = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if ka >= 0:
                out.append(a)
            if ka * kb < 0:
                f = ka / (ka - kb)
                out.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
        ring = out
        if not ring:
            break
    return ring
