"""Rigid transforms with unit quaternions as Column expressions.

A quaternion is a tuple of columns (w, x, y, z), a vector one of (x, y, z).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]


def named(prefix: str = "") -> Quaternion:
    """The columns qw, qx, qy, qz after a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("qw", "qx", "qy", "qz"))


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    """Product of two quaternions."""
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def conjugate(q: Quaternion) -> Quaternion:
    """Inverse of a unit quaternion."""
    return q[0], -q[1], -q[2], -q[3]


def normalize(q: Quaternion) -> Quaternion:
    """Unit quaternion; the identity if the norm is 1e-12 or less."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    bad = n <= 1e-12
    return tuple(F.when(bad, 1.0 if k == 0 else 0.0).otherwise(c / F.when(bad, 1.0).otherwise(n)) for k, c in enumerate(q))


def rotate(q: Quaternion, v: Vector) -> Vector:
    """A vector turned by a unit quaternion."""
    w, x, y, z = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx


def yaw(q: Quaternion) -> Column:
    """Heading of a unit quaternion."""
    w, x, y, z = q
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def angle(q: Quaternion) -> Column:
    """Angle of rotation of a unit quaternion."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(q[0])))


def relative(a: tuple[Quaternion, Vector], b: tuple[Quaternion, Vector]) -> tuple[Quaternion, Vector]:
    """Pose b seen from pose a."""
    inverse = conjugate(a[0])
    return multiply(inverse, b[0]), rotate(inverse, tuple(y - x for x, y in zip(a[1], b[1], strict=True)))


def compose(a: tuple[Quaternion, Vector], b: tuple[Quaternion, Vector]) -> tuple[Quaternion, Vector]:
    """Pose a, then b within it."""
    return multiply(a[0], b[0]), tuple(x + y for x, y in zip(a[1], rotate(a[0], b[1]), strict=True))


#: Coordinate modes of written trajectories: half turns before and after a rotation, from east-north-up to north-east-down and from a body's forward-left-up to forward-right-down.
MODES: dict[str, tuple[tuple | None, tuple | None]] = {"as_is": (None, None), "enu_to_ned": ((0.0, 0.5**0.5, 0.5**0.5, 0.0), None), "enu_flu_to_ned_frd": ((0.0, 0.5**0.5, 0.5**0.5, 0.0), (0.0, 1.0, 0.0, 0.0))}


def in_mode(q: Quaternion, v: Vector, mode: str) -> tuple[Quaternion, Vector]:
    """A pose in one of MODES."""
    before, after = (None if m is None else tuple(map(F.lit, m)) for m in MODES[mode])
    if before is not None:
        q, v = multiply(before, q), (v[1], v[0], -v[2])
    return (q if after is None else multiply(q, after)), v


def slerp(a: Quaternion, b: Quaternion, t: Column) -> Quaternion:
    """Spherical interpolation the short way; linear when the quaternions nearly agree."""
    d = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    c = F.least(F.lit(1.0), F.abs(d))
    near = c > 0.9995
    theta = F.acos(F.when(near, 0.5).otherwise(c))
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
    wb = F.when(near, t).otherwise(F.sin(t * theta) / F.sin(theta)) * sign
    return normalize(tuple(wa * x + wb * y for x, y in zip(a, b, strict=True)))


def exp(w: Vector) -> Quaternion:
    """Quaternion of a rotation vector."""
    n = F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    small = n < 1e-9
    k = F.when(small, 0.5).otherwise(F.sin(n / 2) / F.when(small, 1.0).otherwise(n))
    return F.cos(n / 2), w[0] * k, w[1] * k, w[2] * k


def log(q: Quaternion) -> Vector:
    """Rotation vector of a unit quaternion."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    n = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    small = n < 1e-9
    k = sign * F.when(small, 2.0).otherwise(2 * F.atan2(n, F.abs(q[0])) / F.when(small, 1.0).otherwise(n))
    return q[1] * k, q[2] * k, q[3] * k


def is_rigid(q: Quaternion, v: Vector, tolerance: float = 1e-3) -> Column:
    """Whether all parts are finite and the quaternion has length one."""
    from waymark.functions.scalars import finite

    n = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return finite(*q, *v) & (F.abs(n - 1) < tolerance)
