"""Uploaded label pairs: every rule an expression, the first that fails is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SPEED, MAX_ACCEL, MAX_GYRO = 100.0, 100.0, 10.0

PAIR_SCHEMA = "array<struct<imu_window:array<array<double>>,displacement_m:double,window_duration_s:double,device_model:string,app_version:string,contract_version:string>>"
UPLOAD_SCHEMA = f"device_id_hash string, consent boolean, pairs {PAIR_SCHEMA}"


def _percentile(values: Column, q: float) -> Column:
    """Interpolated quantile of an array."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def rejection(pair: str = "pair", prefixes: tuple[str, ...] = ("1.",)) -> Column:
    """Null for an acceptable pair."""
    p, w = F.col(pair), F.col(f"{pair}.imu_window")
    version = F.lit(False)
    for prefix in prefixes:
        version = version | F.coalesce(p["contract_version"].startswith(prefix), F.lit(False))
    shaped = F.coalesce((F.size(w) > 0) & F.forall(w, lambda r: F.size(r) == 6), F.lit(False))
    finite = F.forall(w, lambda r: F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    speed = p["displacement_m"] / F.when(p["window_duration_s"] > 0, p["window_duration_s"])
    accel = F.flatten(F.transform(w, lambda r: F.transform(F.slice(r, 1, 3), F.abs)))
    gyro = F.flatten(F.transform(w, lambda r: F.transform(F.slice(r, 4, 3), F.abs)))
    return (
        F.when(~version, "contract_version")
        .when(~shaped, "shape")
        .when(~finite, "not_finite")
        .when(~F.coalesce(p["window_duration_s"] > 0, F.lit(False)), "duration")
        .when(~F.coalesce(speed.between(0.0, MAX_SPEED), F.lit(False)), "mean_speed")
        .when(F.array_max(accel) > MAX_ACCEL, "accel")
        .when(_percentile(gyro, 0.995) > MAX_GYRO, "gyro")
    )


def judged_pairs(uploads: DataFrame) -> DataFrame:
    """One row a pair: its reason, or "consent" for every pair of an upload without it."""
    rows = uploads.withColumn("pair", F.explode("pairs"))
    return rows.withColumn("reason", F.when(~F.coalesce(F.col("consent"), F.lit(False)), "consent").otherwise(rejection())).drop("pairs")


def verdicts(judged: DataFrame, by: str = "device_id_hash") -> DataFrame:
    """Accepted and rejected pairs of each upload, with the distinct reasons in order."""
    return judged.groupBy(by).agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.array_sort(F.collect_set("reason")).alias("reasons"))
