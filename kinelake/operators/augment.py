"""Variants of windows to learn from, as expressions: a turn, noise, gains, a drift and a change of pace, all drawn from the window's own key.

Draws come from md5 sums of (seed, key, name), so reruns, other partitionings and other engines make the same variants.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators.features import FEATURES, time_warp
from kinelake.operators.sampling import unit


@dataclass(frozen=True)
class Strengths:
    """How far variants go. Noise and drift are in deviations of each channel over its window."""

    turn_deg: float = 12.0
    noise: float = 0.03
    gain: float = 0.05
    drift: float = 0.02
    warp: float = 0.05
    share: float = 0.9


#: A light touch for windows that are aligned and normalised already.
BATCH = Strengths(turn_deg=3.0, noise=0.03, gain=0.0, drift=0.0, warp=0.0, share=0.35)


def _between(seed: int, key: Column, name: str, reach: float) -> Column:
    return (unit(seed, key, F.lit(name)) * 2 - 1) * reach


def random_turn(seed: int, key: Column, reach_deg: float) -> list[list[Column]]:
    """A rotation about an axis uniform on the sphere, by an angle uniform within the reach on both sides."""
    z, around = _between(seed, key, "axis", 1.0), unit(seed, key, F.lit("around")) * (2 * math.pi)
    flat = F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
    x, y = flat * F.cos(around), flat * F.sin(around)
    angle = _between(seed, key, "angle", math.radians(reach_deg))
    c, s = F.cos(angle), F.sin(angle)
    v = 1 - c
    return [[c + x * x * v, x * y * v - z * s, x * z * v + y * s], [x * y * v + z * s, c + y * y * v, y * z * v - x * s], [x * z * v - y * s, y * z * v + x * s, c + z * z * v]]


def augmented(windows: DataFrame, key: str, seed: int = 0, strengths: Strengths = Strengths(), variants: int = 1) -> DataFrame:
    """(key, variant, applied, x): ``variants`` of each window x (rows of FEATURES), each left as it is with a chance of 1 - share.

    Acceleration and turn rates turn together; normal noise and a drift from 0 to its full reach at the last row are in each
    channel's population deviation over the window; channels get gains; at last the window is read at another pace. Null windows stay null.
    """
    n = len(FEATURES)
    both = windows.select(key, F.col("x").alias("_x"), F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    own = F.concat_ws("/", F.col(key).cast("string"), F.col("variant").cast("string"))
    turn = random_turn(seed, own, strengths.turn_deg)
    # Draws are columns of their own, so that each is computed once a variant and not for each value.
    drawn = {f"_r{i}{j}": turn[i][j] for i in range(3) for j in range(3)} | {f"_gain{c}": 1 + _between(seed, own, f"gain{c}", strengths.gain) for c in range(n)} | {f"_drift{c}": _between(seed, own, f"drift{c}", strengths.drift) for c in range(n)}
    rows = both.withColumns({"_own": own, "applied": unit(seed, own, F.lit("applied")) < strengths.share, "_pace": 1 + _between(seed, own, "pace", strengths.warp), **drawn})

    def turned(r: Column) -> Column:
        return F.array(*[sum((F.col(f"_r{i}{j}") * r[base + j] for j in range(3)), F.lit(0.0)) for base in (0, 3) for i in range(3)])

    def spread(c: int) -> Column:
        values = F.transform("_y", lambda r: r[c])
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size("_y")
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size("_y")) + 1e-6

    def normal(i: Column, c: int) -> Column:
        one, two = (unit(seed, F.col("_own"), F.lit(f"{name}{c}"), i) for name in ("radius", "phase"))
        return F.sqrt(-2 * F.log(1 - one)) * F.cos(2 * math.pi * two)

    def disturbed(r: Column, i: Column) -> Column:
        ramp = F.when(F.size("_y") > 1, i / (F.size("_y") - 1)).otherwise(F.lit(0.0))
        noise = [normal(i, c) * strengths.noise if strengths.noise else F.lit(0.0) for c in range(n)]
        return F.array(*[(r[c] + noise[c] * F.col(f"_s{c}")) * F.col(f"_gain{c}") + ramp * F.col(f"_drift{c}") * F.col(f"_s{c}") for c in range(n)])

    rows = rows.withColumn("_y", F.transform("_x", turned)).withColumns({f"_s{c}": spread(c) for c in range(n)})
    rows = rows.withColumn("_y", F.transform("_y", disturbed))
    paced = time_warp(F.col("_y"), F.col("_pace")) if strengths.warp else F.col("_y")
    # Exploded from an array of one, so that later conditions on x are applied to its value and not to all of the expressions again.
    return rows.select(key, "variant", "applied", F.explode(F.array(F.when(F.col("applied"), paced).otherwise(F.col("_x")))).alias("x"))


def speed_loss(rows: DataFrame, nll: bool, by: list[str] | None = None, label_sigma: str | None = None, weight: str | None = None, beta: float = 0.5, logvar_l2: float = 1e-3, clamp: tuple[float, float] = (-8.0, 6.0)) -> DataFrame:
    """The training loss of (y, mu, logvar), evaluated as one aggregation a group.

    Before ``nll`` it is the squared error with a slight pull (1e-4) of the log variance to 0; then the Gaussian negative log-likelihood, each row's
    times its variance to the power ``beta`` so that rows of large variance aren't given up on, with a pull of ``logvar_l2``.
    """
    lv = F.least(F.greatest("logvar", F.lit(clamp[0])), F.lit(clamp[1]))
    variance = F.greatest(F.exp(lv) if label_sigma is None else F.exp(lv) + F.col(label_sigma) * F.col(label_sigma), F.lit(1e-6))
    square = (F.col("y") - F.col("mu")) * (F.col("y") - F.col("mu"))
    each = F.pow(variance, F.lit(beta)) * 0.5 * (F.log(variance) + square / variance) if nll else square
    w = F.lit(1.0) if weight is None else F.col(weight)
    pull = F.lit(logvar_l2 if nll else 1e-4) * F.avg(lv * lv)
    return rows.groupBy(*(by or [])).agg((F.sum(w * each) / F.greatest(F.sum(w), F.lit(1.0)) + pull).alias("loss"))


def yaw_loss(rows: DataFrame, by: list[str] | None = None, logvar_l2: float = 1e-3) -> DataFrame:
    """The plain negative log-likelihood of yaw increments (y, mu, logvar) with the same pull."""
    return speed_loss(rows, True, by, beta=0.0, logvar_l2=logvar_l2)


def context_loss(rows: DataFrame, by: list[str] | None = None, mask: str | None = None, classes: int = 3) -> DataFrame:
    """Mean cross-entropy of (logits, label) over the first ``classes`` logits, of the rows where ``mask`` holds; 0 where none does."""
    some = F.slice("logits", 1, classes)
    most = F.array_max(some)
    total = F.aggregate(some, F.lit(0.0), lambda a, v: a + F.exp(v - most))
    each = most + F.log(total) - F.get(some, F.col("label").cast("int"))
    kept = each if mask is None else F.when(F.col(mask), each)
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("loss"))
