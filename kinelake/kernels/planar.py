"""A planar error-state filter over one outage: position, velocity, heading, and biases of two accelerometers and a gyro.

Sequential in time, so many keys go side by side: states may have leading dimensions, and each
step is one product over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Noise densities, initial deviations, measurement variances and gates.
ACCEL_NOISE, GYRO_NOISE, ACCEL_WALK, GYRO_WALK = 1e-3, 1e-4, 1e-5, 1e-6
INITIAL_STD = (3.0, 3.0, 0.5, 0.5, 0.05, 0.05, 0.05, 0.01)
NHC_VAR, ZUPT_VAR, VELOCITY_FLOOR, STILL_SPEED = 0.05, 0.01, 1.0, 0.5
GATE_95 = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.070, 6: 12.592}
E, N, VE, VN, H, BF, BL, BG = range(8)


def symmetric(p: np.ndarray) -> np.ndarray:
    return (p + p.swapaxes(-1, -2)) / 2


def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Matrices times vectors, over any leading dimensions."""
    return (m @ v[..., None])[..., 0]


def correction(p: np.ndarray, jacobian: np.ndarray, variance, innovation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an observation: the state's error, the covariance after it in Joseph form, and the statistic that gates compare."""
    r = np.eye(jacobian.shape[-2]) * np.asarray(variance, dtype=float)[..., None, None]
    across = p @ jacobian.swapaxes(-1, -2)
    spread = np.linalg.inv(jacobian @ across + r)
    gain = across @ spread
    rest = np.eye(p.shape[-1]) - gain @ jacobian
    after = rest @ p @ rest.swapaxes(-1, -2) + gain @ r @ gain.swapaxes(-1, -2)
    return apply(gain, innovation), after, (innovation * apply(spread, innovation)).sum(axis=-1)


class Planar:
    def __init__(self, v0, heading0, heading_sign: float = -1.0, floor: float = VELOCITY_FLOOR):
        v0, heading0 = np.broadcast_arrays(np.asarray(v0, dtype=float), np.asarray(heading0, dtype=float))
        self.x = np.zeros((*v0.shape, 8))
        self.x[..., VE], self.x[..., VN], self.x[..., H] = v0 * np.sin(heading0), v0 * np.cos(heading0), heading0
        self.p = np.broadcast_to(np.diag(np.square(INITIAL_STD)), (*v0.shape, 8, 8)).copy()
        self.sign, self.floor = heading_sign, floor
        self.noise = np.array([0, 0, ACCEL_NOISE, ACCEL_NOISE, GYRO_NOISE, ACCEL_WALK, ACCEL_WALK, GYRO_WALK]) ** 2

    def part(self, at) -> Planar:
        """The filters at ``at`` by themselves; ``put`` brings them back."""
        some = Planar.__new__(Planar)
        some.x, some.p, some.sign, some.floor, some.noise = self.x[at], self.p[at], self.sign, self.floor, self.noise
        return some

    def put(self, at, some: Planar) -> None:
        self.x[at], self.p[at] = some.x, some.p

    def _settled(self, p: np.ndarray) -> np.ndarray:
        p = symmetric(p)
        for i in (VE, VN):
            p[..., i, i] = np.maximum(p[..., i, i], self.floor)
        return p

    def step(self, forward, lateral, yaw_rate, dt: float) -> None:
        s, c = np.sin(self.x[..., H]), np.cos(self.x[..., H])
        f, lat = forward - self.x[..., BF], lateral - self.x[..., BL]
        accel = np.stack([f * s - lat * c, f * c + lat * s], axis=-1)
        move = np.broadcast_to(np.eye(8), self.p.shape).copy()
        move[..., E, VE] = move[..., N, VN] = dt
        move[..., VE, BF], move[..., VE, BL], move[..., VE, H] = -s * dt, c * dt, accel[..., 1] * dt
        move[..., VN, BF], move[..., VN, BL], move[..., VN, H] = -c * dt, -s * dt, -accel[..., 0] * dt
        move[..., H, BG] = -self.sign * dt
        self.x[..., [E, N]] += self.x[..., [VE, VN]] * dt + accel * dt * dt / 2
        self.x[..., [VE, VN]] += accel * dt
        self.x[..., H] += self.sign * (yaw_rate - self.x[..., BG]) * dt
        self.p = self._settled(move @ self.p @ move.swapaxes(-1, -2) + np.diag(self.noise * dt))

    def observe(self, jacobian: np.ndarray, variance, innovation: np.ndarray) -> np.ndarray:
        """A gated update; a rejected one leaves the state alone."""
        error, after, statistic = correction(self.p, jacobian, variance, innovation)
        taken = ~(statistic > GATE_95[innovation.shape[-1]])
        self.x = np.where(taken[..., None], self.x + error, self.x)
        self.p = np.where(taken[..., None, None], self._settled(after), self.p)
        return taken

    def _along(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Jacobian and value of a * ve + b * vn, where (a, b) turns with the heading to (b, -a)."""
        row = np.zeros((*self.x.shape[:-1], 1, 8))
        row[..., 0, VE], row[..., 0, VN], row[..., 0, H] = a, b, self.x[..., VE] * b - self.x[..., VN] * a
        return row, a * self.x[..., VE] + b * self.x[..., VN]

    def _forward(self) -> tuple[np.ndarray, np.ndarray]:
        return self._along(np.sin(self.x[..., H]), np.cos(self.x[..., H]))

    def forward_speed(self) -> np.ndarray:
        return self._forward()[1]

    def see_speed(self, mean, variance) -> np.ndarray:
        row, value = self._forward()
        return self.observe(row, variance, (mean - value)[..., None])

    def see_no_side_slip(self) -> np.ndarray:
        row, value = self._along(-np.cos(self.x[..., H]), np.sin(self.x[..., H]))
        return self.observe(row, NHC_VAR, -value[..., None])

    def see_standstill(self) -> np.ndarray:
        rows = np.zeros((*self.x.shape[:-1], 2, 8))
        rows[..., 0, VE] = rows[..., 1, VN] = 1
        return self.observe(rows, ZUPT_VAR, -self.x[..., [VE, VN]])


def lockstep(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The first rows of all keys, then the second rows, and so on; rows of a key keep their order."""
    by_key = np.argsort(codes, kind="stable")
    ordered = codes[by_key]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.arange(len(codes))
    rank = place - np.maximum.accumulate(np.where(first, place, 0))
    by_rank = by_key[np.argsort(rank, kind="stable")]
    yield from np.split(by_rank, np.cumsum(np.bincount(rank))[:-1])


def run_keys(codes, forward, lateral, yaw_rate, still, v0, heading0, dt: float, speed=None, logvar=None, heading_sign: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """(east, north, heading) at the start of each key, and after each sample. ``codes`` numbers the samples' keys from 0, as v0 and heading0 have them."""
    all_keys = Planar(v0, heading0, heading_sign)
    start, out = all_keys.x[:, [E, N, H]], np.empty((len(codes), 3))
    for rows in lockstep(codes):
        at = codes[rows]
        kf = all_keys.part(at)
        kf.step(forward[rows], lateral[rows], yaw_rate[rows], dt)
        if speed is not None and logvar is not None:
            kf.see_speed(speed[rows], np.exp(logvar[rows]))
        rests = still[rows] & (np.abs(kf.forward_speed()) < STILL_SPEED)
        for which, see in ((rests, Planar.see_standstill), (~rests, Planar.see_no_side_slip)):
            if which.any():
                some = kf.part(which)
                see(some)
                kf.put(which, some)
        all_keys.put(at, kf)
        out[rows] = kf.x[:, [E, N, H]]
    return start, out


def run(forward, lateral, yaw_rate, still, v0: float, heading0: float, dt: float, speed=None, logvar=None, heading_sign: float = -1.0) -> np.ndarray:
    """Rows (east, north, heading) of one key's start and after each sample."""
    codes = np.zeros(len(forward), dtype=np.intp)
    return np.concatenate(run_keys(codes, forward, lateral, yaw_rate, still, [v0], [heading0], dt, speed, logvar, heading_sign))
