"""Keyed state with event-time timers: a phone's orientation, and the monitoring of fixes.

Both read streams with a watermark on ``ts``, keep a vector of fixed size a key whatever the number of rows, and
give what their batch twins (``operators.monitoring``) give for the rows in order. Rows no later than their key's
last one are dropped and counted. The session needs the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinelake.kernels import calibration
from kinelake.kernels.modes import Monitor, Policy
from kinelake.operators.monitoring import FIX, ORDER, SAID, key_rows, monitored_schema

STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers need, for streams started from now on."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def renew_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at_ms is not None:
        handle.registerTimer(at_ms)


class Calibrator(StatefulProcessor):
    """Adds a key's samples up as moments until a yaw can be searched, says the result once, and ignores what follows."""

    def __init__(self, kind: str, least: int, least_std: float, idle_ms: int):
        self.kind, self.least, self.least_std, self.idle_ms = kind, least, least_std, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("moments", "body array<double>, ns bigint, dropped bigint, done boolean")

    def said(self, key, body: np.ndarray, ns: int, dropped: int) -> pd.DataFrame:
        yaw, score, rotation = calibration.fit(body, self.least, self.least_std)
        gravity = (body[1:4] / body[0]).tolist() if body[0] else None
        return pd.DataFrame([(key, ns, int(body[4]), yaw, None if np.isnan(score) else score, gravity, rotation.ravel().tolist(), dropped)], columns=CALIBRATED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        body, last, dropped, done = self.kept.get() if self.kept.exists() else ([0.0] * calibration.SIZE, None, 0, False)
        if done:
            return
        names = ["ns", "grav_x", "grav_y", "grav_z", "acc_x", "acc_y", "acc_z", "reference"]
        d = pd.concat(list(rows)).sort_values(names, kind="stable")
        new = ~d["ns"].duplicated() & (d["ns"] > last if last is not None else True)
        dropped, d = dropped + int((~new).sum()), d[new]
        body, ns = np.array(body), d["ns"].to_numpy()
        values = d[names[1:]].to_numpy(dtype=float)
        valid = np.isfinite(values).all(axis=1)
        at, missing = 0, self.least - int(body[4])
        while at < len(d) and not done:
            # All rows that are certainly needed at once, then row by row until the reference has moved.
            upto = len(d) if valid[at:].sum() < missing else at + max(1, int(np.searchsorted(np.cumsum(valid[at:]), missing)) + 1 if missing > 0 else 1)
            part = values[at:upto]
            body = calibration.merge(body, calibration.moments(part[:, :3], part[:, 3:6], part[:, 6]))
            at, missing = upto, self.least - int(body[4])
            done = calibration.ready(body, self.least, self.least_std)
        last = int(ns[at - 1]) if at else last
        if last is None:
            return
        self.kept.update((body.tolist(), last, dropped, done))
        renew_timer(self.handle, None if done else last // 1_000_000 + self.idle_ms)
        if done:
            yield self.said(key[0], body, last, dropped)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle key is levelled by what there was, and forgotten."""
        body, last, dropped, _ = self.kept.get()
        self.kept.clear()
        yield self.said(key[0], np.array(body), last, dropped)

    def close(self) -> None:
        pass


CALIBRATED = ["key", "ns", "n", "yaw_deg", "score", "gravity", "rotation", "dropped"]


def calibrate(samples: DataFrame, accel: list[str], gravity: list[str], reference: str, late: str = "10 seconds", idle_ms: int = 600_000, least: int = 200, least_std: float = 1e-3) -> DataFrame:
    """(key, ns, n, yaw_deg, score, gravity, rotation, dropped) once for each key of a stream (key, ts, ns, ...), at the row at which a yaw can be searched.

    A key without samples for ``idle_ms`` of event time before that gets its levelling alone: yaw 0, no score.
    """
    kind = samples.schema["key"].dataType.simpleString()
    named = [F.col(c).cast("double").alias(n) for c, n in zip([*gravity, *accel, reference], ("grav_x", "grav_y", "grav_z", "acc_x", "acc_y", "acc_z", "reference"), strict=True)]
    rows = samples.withWatermark("ts", late).select("key", "ts", "ns", *named)
    schema = f"key {kind}, ns long, n long, yaw_deg double, score double, gravity array<double>, rotation array<double>, dropped long"
    return rows.groupBy("key").transformWithStateInPandas(Calibrator(kind, least, least_std, idle_ms), schema, "Append", "EventTime")


class FixMonitor(StatefulProcessor):
    """A monitor a key; a timer ends its mode when trusted fixes stay away."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("monitor", "body array<double>")

    def done(self, monitor: Monitor) -> None:
        self.kept.update((monitor.state(),))
        # A fix just at the deadline is in time.
        renew_timer(self.handle, None if monitor.deadline is None else monitor.deadline + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        monitor = Monitor(self.policy, self.kept.get()[0] if self.kept.exists() else None)
        out = list(key_rows(monitor, key[0], pd.concat(list(rows)).sort_values(ORDER, kind="stable")))
        self.done(monitor)
        yield pd.DataFrame(out, columns=["key", *SAID, "dropped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        monitor = Monitor(self.policy, self.kept.get()[0])
        row = monitor.expire(expiredTimerInfo.getExpiryTimeInMs())
        self.done(monitor)
        yield pd.DataFrame([(key[0], *row, monitor.dropped)] if row else [], columns=["key", *SAID, "dropped"])

    def close(self) -> None:
        pass


def monitor(fixes: DataFrame, policy: Policy = Policy(), late: str = "10 seconds") -> DataFrame:
    """The streaming twin of ``operators.monitoring.monitor_fixes``, over (key, ts, t_ms, east_m, north_m, accuracy_m, sats)."""
    kind = fixes.schema["key"].dataType.simpleString()
    rows = fixes.withWatermark("ts", late).select("ts", *FIX)
    return rows.groupBy("key").transformWithStateInPandas(FixMonitor(policy), monitored_schema(kind), "Append", "EventTime")
