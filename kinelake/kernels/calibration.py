"""Moments from which a phone's orientation in the vehicle follows, mergeable and of fixed size.

Levelling turns the mean gravity down; the yaw is the angle in whose direction the levelled
acceleration follows the reference best. Both are functions of the mean gravity and of the second
moments of (acceleration without gravity, reference): turning a vector turns its moments. No sample is
kept, and partial moments of any split of the rows add up.
"""

from __future__ import annotations

import math

import numpy as np

STEPS = 72
#: Layout of a state: rows with gravity, their sums, valid rows, and means and centred products of (x, y, z, reference).
SIZE = 1 + 3 + 1 + 4 + 16


def moments(gravity: np.ndarray, accel: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The state of some rows (n x 3, n x 3, n); rows with gaps count where they can."""
    down = gravity[np.isfinite(gravity).all(axis=1)]
    both = np.column_stack([accel - gravity, reference])
    both = both[np.isfinite(both).all(axis=1)]
    mean = both.mean(axis=0) if len(both) else np.zeros(4)
    return np.concatenate([[len(down)], down.sum(axis=0), [len(both)], mean, ((both - mean).T @ (both - mean)).ravel()])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of both parts' rows."""
    out = a + b
    n, m = a[4], b[4]
    if n and m:
        step = b[5:9] - a[5:9]
        out[5:9] = a[5:9] + step * (m / (n + m))
        out[9:] = a[9:] + b[9:] + (np.outer(step, step) * (n * m / (n + m))).ravel()
    return out


def levelling(gravity: np.ndarray) -> np.ndarray:
    """The smallest rotation that takes the direction to (0, 0, -1)."""
    size = float(np.linalg.norm(gravity))
    if size <= 1e-9:
        return np.eye(3)
    x, y, z = gravity / size
    c = -z
    if c <= -1 + 1e-9:
        return np.diag([1.0, -1.0, -1.0])
    axis = np.array([[0.0, 0.0, x], [0.0, 0.0, y], [-x, -y, 0.0]])
    return np.eye(3) + axis + axis @ axis / (1 + c)


def fit(state: np.ndarray, least: int = 200, least_std: float = 1e-3, steps: int = STEPS) -> tuple[float, float, np.ndarray]:
    """(yaw in degrees, its correlation, the rotation into the vehicle's frame).

    The yaw is 0 and the correlation NaN while there are too few valid rows or the reference hardly moves.
    """
    level = levelling(state[1:4] / max(state[0], 1))
    turn = np.eye(4)
    turn[:3, :3] = level
    n = state[4]
    second = turn @ (state[9:].reshape(4, 4) / max(n, 1)) @ turn.T
    if n < least or math.sqrt(max(second[3, 3], 0.0)) < least_std:
        return 0.0, math.nan, level
    best = (-2.0, 0)
    for k in range(-(steps // 2), steps - steps // 2):
        c, s = math.cos(2 * math.pi * k / steps), math.sin(2 * math.pi * k / steps)
        spread = (c * c * second[0, 0] + 2 * c * s * second[0, 1] + s * s * second[1, 1]) * second[3, 3]
        score = round((c * second[0, 3] + s * second[1, 3]) / math.sqrt(spread), 9) if spread > 0 else -2.0
        if score > best[0] or k == -(steps // 2):
            best = (score, k)
    theta = 2 * math.pi * best[1] / steps
    c, s = math.cos(theta), math.sin(theta)
    return best[1] * 360.0 / steps, best[0], np.array([[c, s, 0.0], [-s, c, 0.0], [0.0, 0.0, 1.0]]) @ level


def ready(state: np.ndarray, least: int, least_std: float) -> bool:
    """A yaw search would find something: enough valid rows, and a reference that moves."""
    return bool(state[4] >= least and math.sqrt(max(state[24], 0.0) / state[4]) >= least_std)
