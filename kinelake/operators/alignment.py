"""Levelling and yaw alignment of sensor frames, from moments of each sequence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.nanops import finite

YAW_STEPS = 72


def level_rotation(gx: Column, gy: Column, gz: Column) -> list[list[Column]]:
    """The smallest rotation that takes the direction (gx, gy, gz) to (0, 0, -1); half a turn about x if it points up exactly."""
    size = F.sqrt(gx * gx + gy * gy + gz * gz)
    x, y, z = (F.when(size > 1e-9, c / size) for c in (gx, gy, gz))
    c = -z
    k = F.when(c > -1 + 1e-9, 1 / (1 + c))
    vx, vy = -y, x
    general = [[1 - k * vy * vy, k * vx * vy, vy], [k * vx * vy, 1 - k * vx * vx, -vx], [-vy, vx, c]]
    flip, same = [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return [[F.when(size <= 1e-9, same[i][j]).when(k.isNull(), flip[i][j]).otherwise(general[i][j]) for j in range(3)] for i in range(3)]


def rotate(matrix: list[list[Column]], vector: list[Column]) -> list[Column]:
    return [sum((m * v for m, v in zip(row, vector, strict=True)), F.lit(0.0)) for row in matrix]


def levelled(samples: DataFrame, accel: list[str], gravity: list[str], by: str = "seq_id") -> DataFrame:
    """Adds level_x, level_y, level_z: acceleration without gravity in a frame levelled by the sequence's mean gravity."""
    known = finite(gravity[0]) & finite(gravity[1]) & finite(gravity[2])
    means = samples.where(known).groupBy(by).agg(*[F.avg(c).alias(f"_g{i}") for i, c in enumerate(gravity)])
    joined = samples.join(means, by)
    turned = rotate(level_rotation(F.col("_g0"), F.col("_g1"), F.col("_g2")), [F.col(a) - F.col(g) for a, g in zip(accel, gravity, strict=True)])
    return joined.select(*samples.columns, *[c.alias(f"level_{n}") for c, n in zip(turned, "xyz", strict=True)])


def yaw_search(samples: DataFrame, x: str, y: str, reference: str, by: str = "seq_id", steps: int = YAW_STEPS, least: int = 200, least_std: float = 1e-3) -> DataFrame:
    """Per group the angle (in degrees, of ``steps`` on the circle from -180 on) in whose direction (x, y) correlates best with
    the reference; the lowest of equals. 0 with a null score for groups of too few rows or a constant reference.

    Correlations of all angles follow from one row of moments a group.
    """
    rows = samples.where(finite(x) & finite(y) & finite(reference))
    m = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"), F.covar_pop(x, reference).alias("cxr"), F.covar_pop(y, reference).alias("cyr"), F.var_pop(reference).alias("vr"))
    angles = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(math.cos(2 * math.pi * i / steps)).alias("c"), F.lit(math.sin(2 * math.pi * i / steps)).alias("s")) for i in range(-(steps // 2), steps - steps // 2)])

    def score(a: Column) -> Column:
        c, s = a["c"], a["s"]
        spread = F.greatest(c * c * F.col("vx") + 2 * c * s * F.col("cxy") + s * s * F.col("vy"), F.lit(0.0)) * F.col("vr")
        return F.when(spread > 0, (c * F.col("cxr") + s * F.col("cyr")) / F.sqrt(spread))

    scored = F.array_max(F.transform(angles, lambda a: F.struct(F.round(F.coalesce(score(a), F.lit(-2.0)), 9).alias("score"), (-a["step"]).alias("minus"))))
    usable = (F.col("n") >= least) & (F.sqrt("vr") >= least_std)
    best = m.withColumn("best", F.when(usable, scored))
    return best.select(by, "n", F.coalesce(-F.col("best.minus") * (360.0 / steps), F.lit(0.0)).alias("yaw_deg"), F.col("best.score").alias("score"))


def normalised(value: Column, mean: Column, std: Column) -> Column:
    return ((value - mean) / std).cast("float")
