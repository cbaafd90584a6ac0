"""A 15-state inertial filter: position, velocity, attitude, accelerometer and gyro bias errors about a nominal state.

The state is 16 numbers (position, velocity, quaternion w x y z, two biases) and a 15 x 15
covariance, so it fits a streaming key's state as two arrays. States may have leading dimensions:
many keys go side by side, and each step is one product over all of them.
"""

from __future__ import annotations

import numpy as np

from kinelake.kernels.planar import ACCEL_NOISE, ACCEL_WALK, GATE_95, GYRO_NOISE, GYRO_WALK, apply, correction, symmetric

GRAVITY = np.array([0.0, 0.0, -9.80665])
#: Chi-square limits at 99 % by degrees of freedom.
GATE_99 = {1: 6.635, 2: 9.210, 3: 11.345, 4: 13.277, 5: 15.086, 6: 16.812}
POS, VEL, ATT, BA, BG = (slice(i, i + 3) for i in range(0, 15, 3))
START = np.array([0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], dtype=float)
START_VARIANCE = np.diag(np.repeat(np.square([3.0, 0.5, 0.05, 0.05, 0.01]), 3))


def cross_matrix(v: np.ndarray) -> np.ndarray:
    x, y, z = np.moveaxis(v, -1, 0)
    o = np.zeros_like(x)
    return np.stack([o, -z, y, z, o, -x, -y, x, o], axis=-1).reshape(*v.shape[:-1], 3, 3)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    real = a[..., :1] * b[..., :1] - (a[..., 1:] * b[..., 1:]).sum(axis=-1, keepdims=True)
    rest = a[..., :1] * b[..., 1:] + b[..., :1] * a[..., 1:] + apply(cross_matrix(a[..., 1:]), b[..., 1:])
    return np.concatenate([real, rest], axis=-1)


def turn(angle: np.ndarray) -> np.ndarray:
    """Quaternion of a rotation vector."""
    size = np.linalg.norm(angle, axis=-1, keepdims=True)
    small = size < 1e-8
    half = np.where(small, angle / 2, angle / np.where(small, 1.0, size) * np.sin(size / 2))
    q = np.concatenate([np.cos(size / 2), half], axis=-1)
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


def matrix(q: np.ndarray) -> np.ndarray:
    """Body to world."""
    k = cross_matrix(q[..., 1:])
    return np.eye(3) + 2 * q[..., :1, None] * k + 2 * k @ k


class Inertial:
    def __init__(self, x: np.ndarray | None = None, p: np.ndarray | None = None):
        self.x = np.array(START if x is None else x, dtype=float)
        self.p = np.array(np.broadcast_to(START_VARIANCE, (*self.x.shape[:-1], 15, 15)) if p is None else p, dtype=float).reshape(*self.x.shape[:-1], 15, 15)

    @property
    def rotation(self) -> np.ndarray:
        return matrix(self.x[..., 6:10])

    def part(self, at) -> Inertial:
        """The filters at ``at`` by themselves; ``put`` brings them back."""
        return Inertial(self.x[at], self.p[at])

    def put(self, at, some: Inertial) -> None:
        self.x[at], self.p[at] = some.x, some.p

    def step(self, force: np.ndarray, rate: np.ndarray, dt) -> None:
        """Propagate by specific force (gravity included) and angular rate in the body frame."""
        dt = np.asarray(dt, dtype=float)[..., None]
        if (dt <= 0).any():
            raise ValueError("time must advance")
        world, f, w = self.rotation, force - self.x[..., 10:13], rate - self.x[..., 13:16]
        accel = apply(world, f) + GRAVITY
        flow = np.zeros(self.p.shape)
        flow[..., POS, VEL] = np.eye(3)
        flow[..., VEL, ATT], flow[..., VEL, BA] = -world @ cross_matrix(f), -world
        flow[..., ATT, ATT], flow[..., ATT, BG] = -cross_matrix(w), -np.eye(3)
        move = np.eye(15) + flow * dt[..., None]
        self.x[..., 0:3] += self.x[..., 3:6] * dt + accel * dt * dt / 2
        self.x[..., 3:6] += accel * dt
        self.x[..., 6:10] = product(self.x[..., 6:10], turn(w * dt))
        noise = np.repeat(np.square([0.0, ACCEL_NOISE, GYRO_NOISE, ACCEL_WALK, GYRO_WALK]), 3)
        self.p = symmetric(move @ self.p @ move.swapaxes(-1, -2) + np.diag(noise) * dt[..., None])

    def observe(self, jacobian: np.ndarray, variance, innovation: np.ndarray, gates: dict[int, float] | None = None) -> np.ndarray:
        """An update; one that a gate rejects leaves the state alone."""
        error, after, statistic = correction(self.p, jacobian, variance, innovation)
        taken = ~(statistic > gates[innovation.shape[-1]]) if gates else np.ones(statistic.shape, dtype=bool)
        moved = np.concatenate([self.x[..., 0:6] + error[..., 0:6], product(self.x[..., 6:10], turn(error[..., ATT])), self.x[..., 10:16] + error[..., 9:15]], axis=-1)
        self.x = np.where(taken[..., None], moved, self.x)
        self.p = np.where(taken[..., None, None], symmetric(after), self.p)
        return taken

    def body_velocity(self) -> tuple[np.ndarray, np.ndarray]:
        back = self.rotation.swapaxes(-1, -2)
        v = apply(back, self.x[..., 3:6])
        jacobian = np.zeros((*v.shape[:-1], 3, 15))
        jacobian[..., VEL], jacobian[..., ATT] = back, cross_matrix(v)
        return v, jacobian

    def see_no_side_slip(self, variance: float = 0.05) -> np.ndarray:
        v, jacobian = self.body_velocity()
        return self.observe(jacobian[..., 1:, :], variance, -v[..., 1:])

    def see_standstill(self, variance: float = 0.01) -> np.ndarray:
        v, jacobian = self.body_velocity()
        return self.observe(jacobian, variance, -v)

    def see_speed(self, mean, variance, trust: float = 1.0) -> np.ndarray:
        v, jacobian = self.body_velocity()
        return self.observe(jacobian[..., :1, :], np.asarray(variance) * trust, (mean - v[..., 0])[..., None], GATE_95)

    def see_position(self, position: np.ndarray, variance) -> np.ndarray:
        jacobian = np.zeros((*self.x.shape[:-1], 3, 15))
        jacobian[..., POS] = np.eye(3)
        return self.observe(jacobian, variance, position - self.x[..., 0:3], GATE_95)


def levelling(up: np.ndarray) -> np.ndarray:
    """The smallest rotation that takes the direction ``up`` to (0, 0, 1)."""
    a = up / np.linalg.norm(up, axis=-1, keepdims=True)
    c = a[..., 2]
    down = c < -1 + 1e-9
    k = cross_matrix(np.stack([a[..., 1], -a[..., 0], np.zeros_like(c)], axis=-1))
    tilted = np.eye(3) + k + k @ k / (1 + np.where(down, 0.0, c))[..., None, None]
    return np.where(down[..., None, None], np.diag([1.0, -1.0, -1.0]), tilted)


#: What became of a sample.
DROPPED, CALIBRATING, RUNNING = range(3)


class Fleet:
    """Engines of ``n`` keys side by side: each calibrates for a while on low-passed gravity, then propagates
    its samples and corrects by standstill or no side slip. ``at`` names keys, each once a call."""

    CALIBRATION_S, ALPHA, WINDOW, ACCEL_LIMIT, GYRO_LIMIT = 3.0, 0.8, 20, 0.02, 0.001

    def __init__(self, n: int):
        self.first_ns, self.last_ns, self.dropped = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.gravity, self.calibrated, self.frame = np.full((n, 3), np.nan), np.zeros(n, dtype=bool), np.tile(np.eye(3), (n, 1, 1))
        self.recent, self.held = np.zeros((n, self.WINDOW, 6)), np.zeros(n, dtype=np.int64)
        self.filter = Inertial(np.tile(START, (n, 1)))

    def sample(self, at: np.ndarray, ns: np.ndarray, accel: np.ndarray, gyro: np.ndarray) -> np.ndarray:
        """CALIBRATING, RUNNING, or DROPPED for a sample that isn't later than its key's last, which is counted."""
        known = self.first_ns[at] >= 0
        fresh = ~known | (ns > self.last_ns[at])
        self.dropped[at[~fresh]] += 1
        result = np.full(len(at), DROPPED)
        result[fresh] = self._advance(at[fresh], ns[fresh], accel[fresh], gyro[fresh], known[fresh])
        return result

    def _advance(self, at: np.ndarray, ns: np.ndarray, accel: np.ndarray, gyro: np.ndarray, known: np.ndarray) -> np.ndarray:
        dt = np.where(known, ns - self.last_ns[at], 0) / 1e9
        self.first_ns[at] = np.where(known, self.first_ns[at], ns)
        self.last_ns[at] = ns
        self.recent[at] = np.concatenate([self.recent[at, 1:], np.concatenate([accel, gyro], axis=1)[:, None]], axis=1)
        self.held[at] = np.minimum(self.held[at] + 1, self.WINDOW)
        runs = self.calibrated[at]
        if not runs.all():
            self._calibrate(at[~runs], ns[~runs], accel[~runs])
        if runs.any():
            self._run(at[runs], accel[runs], gyro[runs], dt[runs])
        return np.where(runs, RUNNING, CALIBRATING)

    def _calibrate(self, at: np.ndarray, ns: np.ndarray, accel: np.ndarray) -> None:
        before = self.gravity[at]
        self.gravity[at] = np.where(np.isnan(before), accel, self.ALPHA * before + (1 - self.ALPHA) * accel)
        done = at[(ns - self.first_ns[at]) / 1e9 >= self.CALIBRATION_S]
        self.frame[done], self.calibrated[done] = levelling(self.gravity[done]), True

    def _run(self, at: np.ndarray, accel: np.ndarray, gyro: np.ndarray, dt: np.ndarray) -> None:
        some = self.filter.part(at)
        some.step(apply(self.frame[at], accel), apply(self.frame[at], gyro), dt)
        energy = self.recent[at].var(axis=1)
        rests = (self.held[at] == self.WINDOW) & (energy[:, :3].sum(axis=1) < self.ACCEL_LIMIT) & (energy[:, 3:].sum(axis=1) < self.GYRO_LIMIT)
        for which, see in ((rests, Inertial.see_standstill), (~rests, Inertial.see_no_side_slip)):
            if which.any():
                few = some.part(which)
                see(few)
                some.put(which, few)
        self.filter.put(at, some)

    def _aid(self, at: np.ndarray, see) -> np.ndarray:
        """Which keys took the observation ``see(filter, calibrated)``; before calibration it is refused."""
        ready = self.calibrated[at]
        taken = np.zeros(len(at), dtype=bool)
        if ready.any():
            some = self.filter.part(at[ready])
            taken[ready] = see(some, ready)
            self.filter.put(at[ready], some)
        return taken

    def fix(self, at: np.ndarray, position: np.ndarray, variance: np.ndarray) -> np.ndarray:
        """Position observations."""
        return self._aid(at, lambda some, ready: some.see_position(position[ready], variance[ready]))

    def speed(self, at: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
        """A model's forward speeds."""
        return self._aid(at, lambda some, ready: some.see_speed(mean[ready], variance[ready]))


class Engine:
    """A fleet of one. Everything it remembers is in ``state()``, a list of whole numbers and one of others, so a stream can carry it from batch to batch."""

    ONE = np.zeros(1, dtype=np.intp)

    def __init__(self, state: tuple[list[int], list[float]] | None = None):
        self.fleet = fleet = Fleet(1)
        if state and state[0]:
            head, body = state
            fleet.first_ns[0], fleet.last_ns[0], fleet.dropped[0] = (int(v) for v in head)
            body = np.array(body)
            fleet.gravity[0], fleet.calibrated[0], fleet.frame[0] = body[0:3], body[3] > 0, body[4:13].reshape(3, 3)
            fleet.filter = Inertial(body[None, 13:29], body[None, 29:254])
            recent = body[254:].reshape(-1, 6)
            fleet.held[0] = len(recent)
            fleet.recent[0, fleet.WINDOW - len(recent) :] = recent

    def state(self) -> tuple[list[int], list[float]]:
        one = self.fleet
        recent = one.recent[0, one.WINDOW - one.held[0] :]
        parts = [one.gravity[0], [float(one.calibrated[0])], one.frame[0].ravel(), one.filter.x[0], one.filter.p[0].ravel(), recent.ravel()]
        return [int(one.first_ns[0]), int(one.last_ns[0]), int(one.dropped[0])], np.concatenate(parts).tolist()

    @property
    def started(self) -> bool:
        return bool(self.fleet.first_ns[0] >= 0)

    @property
    def dropped(self) -> int:
        return int(self.fleet.dropped[0])

    def sample(self, ns: int, accel: np.ndarray, gyro: np.ndarray) -> str | None:
        """CALIBRATING or RUNNING; None for a dropped sample."""
        return (None, "CALIBRATING", "RUNNING")[self.fleet.sample(self.ONE, np.array([ns]), accel[None], gyro[None])[0]]

    def fix(self, position: np.ndarray, variance: float) -> bool:
        return bool(self.fleet.fix(self.ONE, position[None], np.array([variance]))[0])

    def speed(self, mean: float, variance: float) -> bool:
        return bool(self.fleet.speed(self.ONE, np.array([mean]), np.array([variance]))[0])
