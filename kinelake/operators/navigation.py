"""Positions and dead reckoning as window expressions: local frame, cumulative paths, strapdown, low-pass, window filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.nanops import col
from kinelake.functions.scalar import EARTH_RADIUS_M
from kinelake.operators.filters import by_key_in_order
from kinelake.operators.smoothing import carried


def path(key: str = "key"):
    return W.partitionBy(key).orderBy("i")


def local_enu(points: DataFrame, lat: str, lon: str, key: str = "key") -> DataFrame:
    """Adds east_m and north_m about the first point of each key, by the equirectangular projection."""
    origin = path(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lat0, lon0 = F.first(lat).over(origin), F.first(lon).over(origin)
    east = F.radians(F.col(lon) - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M
    return points.withColumn("east_m", east).withColumn("north_m", F.radians(F.col(lat) - lat0) * EARTH_RADIUS_M)


def path_length(points: DataFrame, key: str = "key", east: str = "east_m", north: str = "north_m") -> DataFrame:
    step = F.hypot(F.col(east) - F.lag(east).over(path(key)), F.col(north) - F.lag(north).over(path(key)))
    return points.withColumn("_step", step).groupBy(key).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length_m"))


def dead_reckon(steps: DataFrame, speed: Column, heading: Column, dt: float, key: str = "key") -> DataFrame:
    """Positions after each step of constant speed and heading (clockwise from north); step i gives point i + 1, point 0 is the origin."""
    so_far = path(key).rowsBetween(W.unboundedPreceding, 0)
    moved = steps.select(key, (F.col("i") + 1).alias("i"), (F.sum(speed * F.sin(heading) * dt).over(so_far)).alias("east_m"), (F.sum(speed * F.cos(heading) * dt).over(so_far)).alias("north_m"))
    origin = steps.where("i = 0").select(key, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("east_m"), F.lit(0.0).alias("north_m"))
    return moved.unionByName(origin)


def integrated_heading(rate: Column, heading0: Column, dt: float, sign: Column | float = 1.0, shifted: bool = False, key: str = "key") -> Column:
    """heading0 + sign * sum of rates * dt up to this row, or up to the one before."""
    frame = path(key).rowsBetween(W.unboundedPreceding, -1 if shifted else 0)
    return col(heading0) + sign * F.coalesce(F.sum(rate).over(frame), F.lit(0.0)) * dt


def strapdown(steps: DataFrame, dt: float, proper: bool = True, key: str = "key") -> DataFrame:
    """Double integration of forward (ax) and lateral (ay) acceleration from speed v0 and heading h0 with yaw rate gz and its sign.

    ``proper`` rotates body to world with preserved length; without it, the published
    baseline's rotation, which mixes both axes with equal signs, is reproduced.
    """
    heading = integrated_heading(F.col("gz"), F.col("h0"), dt, F.col("sign"), shifted=True, key=key)
    turned = steps.withColumn("heading", heading)
    s, c, f, lat = F.sin("heading"), F.cos("heading"), F.col("ax"), F.col("ay")
    east, north = (f * s - lat * c, f * c + lat * s) if proper else ((f + lat) * s, (f - lat) * c)
    so_far = path(key).rowsBetween(W.unboundedPreceding, 0)
    fast = turned.withColumn("ve", F.col("v0") * F.sin("h0") + F.sum(east * dt).over(so_far)).withColumn("vn", F.col("v0") * F.cos("h0") + F.sum(north * dt).over(so_far))
    return fast.select(key, (F.col("i") + 1).alias("i"), F.sum(F.col("ve") * dt).over(so_far).alias("east_m"), F.sum(F.col("vn") * dt).over(so_far).alias("north_m"), "heading")


def low_pass(samples: DataFrame, value: str, alpha: float = 0.8, key: str = "seq_id") -> DataFrame:
    """(key, row_idx, value, smoothed): exponential smoothing y = alpha * y + (1 - alpha) * x from each key's first sample.

    Rows are sorted by key and time and passed through, all keys of a batch side by side; what goes on into the next batch is one number, however
    long a key. A missing value makes the rest of its key NaN.
    """

    def step(values: np.ndarray, states: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.where(fresh, values[:, 0], alpha * states[:, 0] + (1 - alpha) * values[:, 0])[:, None]
        return y, y

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, out in carried(frames, ["x"], 1, step):
            yield d.assign(smoothed=out[:, 0])

    rows = samples.select(F.col(key).alias("key"), "row_idx", F.col(value).cast("double").alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = by_key_in_order(rows, "row_idx").mapInPandas(run, f"key {kinds['key']}, row_idx {kinds['row_idx']}, x double, smoothed double")
    return out.select(F.col("key").alias(key), "row_idx", F.col("x").alias(value), "smoothed")


def window_filter(windows: DataFrame, key: str = "key", dt: float = 2.0, q: float = 0.6, r0: float = 0.25) -> DataFrame:
    """(key, i, speed, accel): speed and acceleration by a Kalman filter over a key's windows (i, mean, logvar, v0).

    State (v, a) with covariance (pvv, pva, paa), starting at (v0, 0) and the unit matrix; measurement variance exp(logvar) + r0. Windows are sorted and passed through
    as in ``low_pass``; five numbers a key go on. A missing value makes the rest of its key NaN.
    """

    def step(values: np.ndarray, states: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, logvar, v0 = values.T
        v, a, pvv, pva, paa = (np.where(fresh, first, now) for first, now in zip((v0, 0.0, 1.0, 0.0, 1.0), states.T, strict=True))
        v = v + dt * a
        pvv, pva, paa = pvv + 2 * dt * pva + dt * dt * paa + q * q * dt**4 / 4, pva + dt * paa + q * q * dt**3 / 2, paa + q * q * dt * dt
        spread = pvv + np.exp(logvar) + r0
        miss = mean - v
        after = np.stack([v + pvv / spread * miss, a + pva / spread * miss, pvv - pvv * pvv / spread, pva - pva * pvv / spread, paa - pva * pva / spread], axis=1)
        return after[:, :2], after

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, out in carried(frames, ["mean", "logvar", "v0"], 5, step):
            yield pd.DataFrame({"key": d["key"].to_numpy(), "i": d["i"].to_numpy(), "speed": out[:, 0], "accel": out[:, 1]})

    rows = windows.select(F.col(key).alias("key"), F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in ("mean", "logvar", "v0")])
    out = by_key_in_order(rows, "i").mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, i long, speed double, accel double")
    return out.withColumnRenamed("key", key)


def rigid_align(pairs: DataFrame, key: str = "key") -> DataFrame:
    """The rotation and shift of (pe, pn) that fit (te, tn) best, from sums: theta, de, dn."""
    m = pairs.groupBy(key).agg(*[F.avg(c).alias(c) for c in ("pe", "pn", "te", "tn")], *[F.avg(F.col(a) * F.col(b)).alias(a + b) for a in ("pe", "pn") for b in ("te", "tn")])
    cov = {a + b: F.col(a + b) - F.col(a) * F.col(b) for a in ("pe", "pn") for b in ("te", "tn")}
    m = m.withColumn("theta", F.atan2(cov["petn"] - cov["pnte"], cov["pete"] + cov["pntn"]))
    s, c = F.sin("theta"), F.cos("theta")
    return m.select(key, "theta", (F.col("te") - c * F.col("pe") + s * F.col("pn")).alias("de"), (F.col("tn") - s * F.col("pe") - c * F.col("pn")).alias("dn"))

