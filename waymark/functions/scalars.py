"""Scalar functions on angles, geodesy, weights, vectors and codes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
EARTH_RADIUS = 6378137.0


def wrap_angle(a: Column) -> Column:
    """The angle in [-pi, pi]."""
    return a - F.lit(2 * math.pi) * F.round(a / (2 * math.pi))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x held between lo and hi."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def finite(*columns: Column) -> Column:
    """Whether none is null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def cell(x: Column, size: float) -> Column:
    """Index of the cell of that size that holds x."""
    return F.floor(x / size).cast("long")


def cell_center(i: Column, size: float) -> Column:
    """Centre of a cell."""
    return (i + 0.5) * size


def enu_from_lat_lon(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north of an origin, equirectangular."""
    east = F.radians(lon - lon0) * EARTH_RADIUS * math.cos(math.radians(lat0))
    return east, F.radians(lat - lat0) * EARTH_RADIUS


def lat_lon_from_enu(east: Column, north: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Inverse of enu_from_lat_lon."""
    return lat0 + F.degrees(north / EARTH_RADIUS), lon0 + F.degrees(east / (EARTH_RADIUS * math.cos(math.radians(lat0))))


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a WGS-84 position."""
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    return (
        (n + alt) * F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        (n + alt) * F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        (n * (1 - e2) + alt) * F.sin(F.radians(lat)),
    )


def enu_from_lla(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> tuple[Column, Column, Column]:
    """East, north and up of an origin, by way of earth-centred coordinates."""
    x, y, z = ecef(lat, lon, alt)
    x0, y0, z0 = ecef(F.lit(lat0), F.lit(lon0), F.lit(alt0))
    dx, dy, dz = x - x0, y - y0, z - z0
    sa, ca, so, co = (f(math.radians(v)) for v in (lat0, lon0) for f in (math.sin, math.cos))
    return -so * dx + co * dy, -sa * co * dx - sa * so * dy + ca * dz, ca * co * dx + ca * so * dy + sa * dz


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a position."""
    n = 2.0**zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    return x.cast("long"), y.cast("long")


def metres_per_pixel(lat: Column, zoom: int, tile: int = 256) -> Column:
    """Ground size of a tile's pixel."""
    return F.cos(F.radians(lat)) * (2 * math.pi * EARTH_RADIUS) / (tile * 2.0**zoom)


def huber_weight(r: Column, delta: float) -> Column:
    """1 within delta, then delta / |r|."""
    return F.when(F.abs(r) <= delta, 1.0).otherwise(delta / F.abs(r))


def dcs_weight(chi2: Column, k: float) -> Column:
    """Dynamic covariance scaling, at most 1."""
    return F.least(F.lit(1.0), F.pow(2 * k / (k + chi2), 2))


def arc_step(arc: Column, turn: Column) -> tuple[Column, Column]:
    """Displacement along an arc of that length and turn; straight for turns under 1e-5."""
    straight = F.abs(turn) < 1e-5
    safe = F.when(straight, 1.0).otherwise(turn)
    return F.when(straight, arc).otherwise(arc * F.sin(safe) / safe), F.when(straight, 0.0).otherwise(arc * (1 - F.cos(safe)) / safe)


def pose_quality(match: Column, ratio: Column, coverage: Column, rmse: Column, worst: float) -> Column:
    """Blend of match, inlier ratio, coverage and residual, 0 to 1."""
    return clamp(0.25 * match + 0.35 * ratio + 0.2 * coverage + 0.2 * F.exp(-rmse / worst), 0, 1)


def gap_confidence(gap: Column, least: float) -> Column:
    """Logistic confidence of a gap between best and second."""
    return 1 / (1 + F.exp(-20 * (gap - least)))


def distance_kernel(d: Column, sigma: float, most: float) -> Column:
    """exp of the clipped distance over sigma."""
    return F.exp(-clamp(d, 0, most) / sigma)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if sizes differ or a norm is 1e-9 or less."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    bad = (F.size(a) != F.size(b)) | (na <= 1e-9) | (nb <= 1e-9)
    return F.when(bad, 0.0).otherwise(clamp(dot(a, b) / F.when(bad, 1.0).otherwise(na * nb), -1, 1))


def sign_bits(v: Column) -> Column:
    """One 64-bit word of the signs of an array's first 64 numbers."""
    return F.aggregate(F.slice(v, 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def lsh_code(word: Column, table: int, bits: int = 8, width: int = 64) -> Column:
    """Bits of a word at places 17 + 37 table + 11 b (modulo width), as one integer."""
    # 17, 37, 11.
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, (17 + 37 * table + 11 * b) % width).bitwiseAND(F.lit(1).cast("long")), b))
    return out


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    """24-bit colour."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def confidence_of_scores(scores: Column) -> Column:
    """Largest score if they look like probabilities, else the softmax weight of the largest."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    top = F.array_max(scores)
    soft = 1 / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when((F.array_min(scores) >= 0) & (top <= 1) & (total > 0.5) & (total < 1.5), top).otherwise(soft)


def middle_two_mean(*speeds: Column) -> Column:
    """Mean of the middle two of four numbers."""
    s = F.array_sort(F.array(*speeds))
    return (s[1] + s[2]) / 2


def trust(counter: Column, least: float, worst: float) -> Column:
    """Trust that decays with staleness down to a least value."""
    return least + (1 - least) * clamp(1 - counter / worst, 0, 1)


def with_clock_offset(stamp: Column, sensor: Column, offsets: dict[str, int], default: int = 0) -> Column:
    """A stamp moved by the offset of its sensor's clock."""
    moved = F.lit(default)
    for name, offset in offsets.items():
        moved = F.when(sensor == name, F.lit(offset)).otherwise(moved)
    return stamp + moved


def scaled_intrinsics(camera: tuple[float, float, float, float], size: tuple[int, int], width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """fx, fy, cx, cy of a camera that was calibrated at a size, for images of another; null for an empty image."""
    across, down = F.when(width > 0, width / size[0]), F.when(height > 0, height / size[1])
    fx, fy, cx, cy = camera
    return fx * across, fy * down, cx * across, cy * down
