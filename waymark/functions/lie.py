"""Rotations and rigid motions as NumPy arrays, many at once.

Rotations are (..., 3, 3), motions (..., 4, 4). A motion's logarithm is (rotation, translation),
six numbers. These serve the operators that keep a small dense state per key; columns use
``waymark.functions.pose``.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1e-9
_ONE = np.eye(3)


def hat(v: np.ndarray) -> np.ndarray:
    """The matrix of the cross product with v."""
    v = np.asarray(v, float)
    if v.ndim == 1:  # the same for one, without the cost of many small arrays
        x, y, z = v.tolist()
        return np.array([[0.0, 0.0 - z, y], [z, 0.0, 0.0 - x], [0.0 - y, x, 0.0]])
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 2, 1], out[..., 0, 2], out[..., 1, 0] = v[..., 0], v[..., 1], v[..., 2]
    return out - np.swapaxes(out, -1, -2)


def _series(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sin(a)/a, (1 - cos(a))/a^2, (a - sin(a))/a^3, also near zero."""
    near = angle < 1e-4
    a = np.where(near, 1.0, angle)
    square = angle * angle
    return (
        np.where(near, 1 - square / 6, np.sin(a) / a),
        np.where(near, 0.5 - square / 24, (1 - np.cos(a)) / (a * a)),
        np.where(near, 1 / 6 - square / 120, (a - np.sin(a)) / (a * a * a)),
    )


def rotation(v: np.ndarray) -> np.ndarray:
    """The rotation about v by its length."""
    v = np.asarray(v, float)
    k = hat(v)
    if v.ndim == 1:
        angle = np.sqrt((v * v).sum())
        square = angle * angle
        first, second = (1 - square / 6, 0.5 - square / 24) if angle < 1e-4 else (np.sin(angle) / angle, (1 - np.cos(angle)) / square)
        return _ONE + first * k + second * (k @ k)
    first, second, _ = _series(np.linalg.norm(v, axis=-1))
    return _ONE + first[..., None, None] * k + second[..., None, None] * (k @ k)


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """The vector whose rotation() is r, of a length up to pi."""
    r = np.asarray(r, float)
    skew = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], axis=-1) / 2
    sine = np.linalg.norm(skew, axis=-1)
    cosine = (np.trace(r, axis1=-2, axis2=-1) - 1) / 2
    angle = np.arctan2(sine, cosine)
    out = skew * np.where(sine > _SMALL, angle / np.where(sine > _SMALL, sine, 1), 1.0)[..., None]
    turned = (sine <= 1e-6) & (cosine < 0)  # half a turn: the axis is the long column of r + 1
    if np.any(turned):
        half = (r + np.eye(3)) / 2
        column = np.argmax(np.diagonal(half, axis1=-2, axis2=-1), axis=-1)
        axis = np.take_along_axis(half, column[..., None, None], axis=-1)[..., 0]
        axis = axis / np.maximum(np.linalg.norm(axis, axis=-1, keepdims=True), _SMALL)
        axis = axis * np.where(np.sum(axis * skew, axis=-1, keepdims=True) < 0, -1, 1)
        out = np.where(turned[..., None], axis * angle[..., None], out)
    return out


def _left(v: np.ndarray) -> np.ndarray:
    """What turns a motion's translation part of the logarithm into its translation."""
    _, second, third = _series(np.linalg.norm(v, axis=-1))
    k = hat(v)
    return np.eye(3) + second[..., None, None] * k + third[..., None, None] * (k @ k)


def motion(x: np.ndarray) -> np.ndarray:
    """The rigid motion of a logarithm (rotation, translation)."""
    x = np.asarray(x, float)
    return compose(rotation(x[..., :3]), np.einsum("...ij,...j->...i", _left(x[..., :3]), x[..., 3:]))


def motion_vector(m: np.ndarray) -> np.ndarray:
    """The logarithm of a rigid motion."""
    v = rotation_vector(m[..., :3, :3])
    return np.concatenate([v, np.linalg.solve(_left(v), m[..., :3, 3][..., None])[..., 0]], axis=-1)


def compose(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The motion that turns by r, then shifts by t."""
    out = np.zeros((*np.shape(r)[:-2], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = r, t, 1
    return out


def inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of rigid motions."""
    back = np.swapaxes(m[..., :3, :3], -1, -2)
    return compose(back, -np.einsum("...ij,...j->...i", back, m[..., :3, 3]))


def orthonormal(m: np.ndarray) -> np.ndarray:
    """The motions with their rotation part made a rotation again (the nearest one)."""
    u, _, vt = np.linalg.svd(m[..., :3, :3])
    sign = np.ones((*m.shape[:-2], 3))
    sign[..., 2] = np.linalg.det(u @ vt)
    return compose(u @ (sign[..., None] * vt), m[..., :3, 3])


def planar(x: np.ndarray, y: np.ndarray, yaw: np.ndarray, z: np.ndarray | float = 0.0) -> np.ndarray:
    """Motions in the plane, at height z."""
    x, y, yaw, z = np.broadcast_arrays(*(np.asarray(a, float) for a in (x, y, yaw, z)))
    zero = np.zeros_like(yaw)
    return compose(rotation(np.stack([zero, zero, yaw], axis=-1)), np.stack([x, y, z], axis=-1))


def yaw_of(m: np.ndarray) -> np.ndarray:
    """Heading of motions or rotations."""
    return np.arctan2(m[..., 1, 0], m[..., 0, 0])


def wrap(angle: np.ndarray) -> np.ndarray:
    """Angles into [-pi, pi)."""
    return np.mod(np.asarray(angle) + np.pi, 2 * np.pi) - np.pi


def from_quaternion(q: np.ndarray) -> np.ndarray:
    """Rotations of quaternions (w, x, y, z), which are normalised first."""
    q = np.asarray(q, float)
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    w, k = q[..., 0], hat(q[..., 1:])
    return np.eye(3) + 2 * w[..., None, None] * k + 2 * (k @ k)
