"""One receiver's fixes: their residual statistic, their quality, and the mode of navigation that follows from them.

Everything known about a receiver is one vector of fixed size, so it can stand in a stream's state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from kinelake.operators.filters import GAP_RESET_S, DriftTest

WAITING, TRACKING, DEAD_RECKONING, REACQUIRING = range(4)
MODES = ("WAITING", "TRACKING", "DEAD_RECKONING", "REACQUIRING")
TRUSTED, DEGRADED, ABSENT = "trusted", "degraded", "absent"


@dataclass(frozen=True)
class Policy:
    """Fixes are trusted within ``accuracy_m``, with ``sats`` satellites and a statistic below ``gate``.

    ``bad_run`` degraded fixes in a row, or ``gap_ms`` without a trusted one, end tracking; ``good_run`` trusted ones
    in a row end reacquisition.
    """

    accuracy_m: float = 20.0
    sats: int = 4
    gate: float | None = 4.0
    bad_run: int = 3
    good_run: int = 5
    gap_ms: int = 4_000


class Monitor:
    #: velocity (2), mean miss (2), sigma, scored, unscored; last time and place; mode, run, last trusted time, dropped fixes.
    SIZE = 14

    def __init__(self, policy: Policy, state: list[float] | None = None):
        self.policy, self.test = policy, DriftTest()
        self.t, self.place, self.mode, self.run, self.trusted, self.dropped = -math.inf, np.zeros(2), WAITING, 0, -math.inf, 0
        if state is not None:
            self.test.velocity, self.test.mean_miss = np.array(state[0:2]), np.array(state[2:4])
            self.test.sigma, self.test.scored, self.test.unscored = state[4], int(state[5]), int(state[6])
            self.t, self.place, self.mode, self.run, self.trusted, self.dropped = state[7], np.array(state[8:10]), int(state[10]), int(state[11]), state[12], int(state[13])

    def state(self) -> list[float]:
        test = self.test
        return [float(v) for v in (*test.velocity, *test.mean_miss, test.sigma, test.scored, test.unscored, self.t, *self.place, self.mode, self.run, self.trusted, self.dropped)]

    @property
    def deadline(self) -> int | None:
        """When the mode changes without a further trusted fix."""
        return int(self.trusted) + self.policy.gap_ms if self.mode in (TRACKING, REACQUIRING) else None

    def expire(self, now: float) -> tuple | None:
        """The change of mode that fell due before ``now``, as a row."""
        due = self.deadline
        if due is None or due >= now:
            return None
        self.mode, self.run = DEAD_RECKONING, 0
        return due, math.nan, ABSENT, MODES[self.mode], "gap"

    def statistic(self, t: int, place: np.ndarray) -> float:
        """NaN for fixes that only (re)start the estimate."""
        gap = (t - self.t) / 1000
        if not gap <= GAP_RESET_S:
            self.test = DriftTest(5 if math.isfinite(self.t) else 3)
            return math.nan
        return self.test.fix(place - self.place, gap)

    def fix(self, t: int, east: float, north: float, accuracy: float, sats: float) -> list[tuple]:
        """Rows (t_ms, stat, quality, mode, trigger): a mode change that fell due before this fix, and the fix itself.

        A fix no later than the last one, or without a position, is dropped and counted.
        """
        if t <= self.t or not (math.isfinite(east) and math.isfinite(north)):
            self.dropped += 1
            return []
        rows = [due] if (due := self.expire(t)) else []
        place = np.array([east, north])
        stat = self.statistic(t, place)
        self.t, self.place = t, place
        gated = self.policy.gate is not None and stat >= self.policy.gate
        good = accuracy <= self.policy.accuracy_m and sats >= self.policy.sats and not gated
        trigger = self.step(good)
        if good:
            self.trusted = t
        return [*rows, (t, stat, TRUSTED if good else DEGRADED, MODES[self.mode], trigger)]

    def step(self, good: bool) -> str | None:
        """Take a fix's quality; what changed the mode, if anything did."""
        before, self.run = self.mode, self.run + 1
        if self.mode == WAITING:
            self.mode = TRACKING if good else WAITING
            trigger = "first_fix"
        elif self.mode == TRACKING:
            self.run = 0 if good else self.run
            self.mode = DEAD_RECKONING if self.run >= self.policy.bad_run else TRACKING
            trigger = "fixes_degraded"
        elif self.mode == DEAD_RECKONING:
            self.mode = REACQUIRING if good else DEAD_RECKONING
            self.run, trigger = 1, "fix"
        else:
            self.mode = DEAD_RECKONING if not good else TRACKING if self.run >= self.policy.good_run else REACQUIRING
            trigger = "settled" if good else "fix_degraded"
        if self.mode == before:
            return None
        if self.mode != REACQUIRING:
            self.run = 0
        return trigger
