"""From samples to a model's input windows, a linear model's output, and a track through an outage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.nanops import finite
from kinelake.operators.alignment import levelled, rotate, yaw_search
from kinelake.operators.navigation import window_filter
from kinelake.schema import DT_S, RATE_HZ, WINDOW_ROWS

FEATURES = ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")
#: Speeds that a model may give, in m/s.
PLAUSIBLE = (0.0, 100.0)


def speed_gradient(samples: DataFrame, speed: str, by: str = "seq_id", rate: float = RATE_HZ) -> Column:
    """The yaw reference of a phone without a vehicle: change of speed a second, over both neighbours, or the one that ends have."""
    order = W.partitionBy(by).orderBy("row_idx")
    before, after = F.lag(speed).over(order), F.lead(speed).over(order)
    inner = (after - before) / 2
    return F.coalesce(inner, after - F.col(speed), F.col(speed) - before) * rate


def aligned_features(samples: DataFrame, accel: list[str], gravity: list[str], gyro: list[str], reference: str, by: str = "seq_id", least: int = 200, least_std: float = 1e-3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, row_idx, FEATURES, yaw_deg, keep): acceleration without gravity and turn rates in the vehicle's frame.

    ``gyro`` names the rates about x, y and z (roll, pitch, yaw). The frame is levelled by each
    sequence's mean gravity and turned so that its first axis follows the reference best. Rows stay where their sequence is.
    """
    # Turn rates are levelled by the same rotation, with nothing to take off.
    turns = samples.withColumns({f"_turn_{n}": F.col(g) + F.col(a) for n, g, a in zip("xyz", gyro, gravity, strict=True)})
    once = levelled(turns, accel, gravity, by)
    yaw = yaw_search(once, "level_x", "level_y", reference, by, least=least, least_std=least_std)
    both = levelled(once.withColumnsRenamed({f"level_{n}": f"_acc_{n}" for n in "xyz"}), [f"_turn_{n}" for n in "xyz"], gravity, by)
    rows = both.join(yaw.select(by, "yaw_deg"), by)
    c, s = F.cos(F.radians("yaw_deg")), F.sin(F.radians("yaw_deg"))
    matrix = [[c, s, F.lit(0.0)], [-s, c, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    out = [*rotate(matrix, [F.col(f"_acc_{n}") for n in "xyz"]), *rotate(matrix, [F.col(f"level_{n}") for n in "xyz"])]
    return rows.select(by, "row_idx", *[x.alias(n) for x, n in zip(out, FEATURES, strict=True)], "yaw_deg", *keep)


def fit_report(samples: DataFrame, accel: list[str], gravity: list[str], reference: str, by: str = "seq_id", least: int = 200, least_std: float = 1e-3) -> DataFrame:
    """(by, n, yaw_deg, score): how well each sequence's alignment follows the reference; a null score where nothing could be fitted."""
    return yaw_search(levelled(samples, accel, gravity, by), "level_x", "level_y", reference, by, least=least, least_std=least_std)


def feature_windows(rows: DataFrame, keys: list[str], means: list[float] | None = None, stds: list[float] | None = None, size: int = WINDOW_ROWS) -> DataFrame:
    """(keys, n_rows, x): each window's rows (i from 0, FEATURES) in order, normalised, as an array of ``size`` rows; short windows end in zeros before they are normalised."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.array(*FEATURES).alias("f"))))["f"].alias("rows"))
    return model_inputs(listed, keys, means, stds, size)


def model_inputs(listed: DataFrame, keys: list[str], means: list[float] | None = None, stds: list[float] | None = None, size: int = WINDOW_ROWS) -> DataFrame:
    """(keys, n_rows, x) as of ``feature_windows``, from windows whose ``rows`` (arrays of FEATURES) are listed in order."""
    means, stds = means or [0.0] * len(FEATURES), stds or [1.0] * len(FEATURES)
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(FEATURES)), size)
    padded = F.slice(F.concat(F.col("rows"), zeros), 1, size)
    scaled = F.transform(padded, lambda r: F.array(*[(r[i] - m) / s for i, (m, s) in enumerate(zip(means, stds, strict=True))]))
    return listed.select(*keys, F.least(F.size("rows"), F.lit(size)).alias("n_rows"), scaled.alias("x"))


def usable_windows(windows: DataFrame, size: int = WINDOW_ROWS, label_ok: str | None = None) -> DataFrame:
    """Windows to learn from: of full length, all values finite, and with a good label if there is a column that says so."""
    bad = F.exists("x", lambda row: F.exists(row, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return windows.where((F.col("n_rows") == size) & ~bad & (F.col(label_ok) if label_ok else F.lit(True)))


def labelled_windows(windows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that have a label, with it: both sides are keyed alike, so the join shuffles windows once."""
    return windows.join(labels, keys)


def stub_weights(size: int = WINDOW_ROWS, seed: int = 42) -> tuple[list[float], list[float], float, float]:
    """Weights and offsets of the mean and the log variance of the contract's stub model."""
    rng = np.random.default_rng(seed)
    mean, logvar = (rng.normal(0, 0.01, (size * len(FEATURES), 1)).astype(np.float32)[:, 0].tolist() for _ in range(2))
    return mean, logvar, 0.0, -1.0


def linear_model(windows: DataFrame, weights: tuple[list[float], list[float], float, float]) -> DataFrame:
    """Adds mu and logvar of a model with one linear layer a head over the flattened window: sums of products, no Python."""

    def head(w: list[float], offset: float) -> Column:
        products = F.zip_with(F.flatten("x"), F.array(*map(F.lit, w)), lambda a, b: a * b)
        return F.aggregate(products, F.lit(float(offset)), lambda s, v: s + v)

    return windows.withColumn("mu", head(weights[0], weights[2])).withColumn("logvar", head(weights[1], weights[3]))


def plausible_speeds(windows: DataFrame, key: str = "key", bounds: tuple[float, float] = PLAUSIBLE) -> DataFrame:
    """Adds mean, rejected: of windows (i, z, v0) an implausible speed is replaced by the last plausible one of the key, at first by v0."""
    ok = F.col("z").between(*bounds) & finite("z")
    so_far = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(ok, F.col("z")), ignorenulls=True).over(so_far)
    return windows.withColumn("mean", F.coalesce(last, F.col("v0"))).withColumn("rejected", ~F.coalesce(ok, F.lit(False)))


def linear_profile(windows: DataFrame, key: str = "key", size: int = WINDOW_ROWS) -> DataFrame:
    """(key, row, speed_mps): each window's (i, speed, n, v0) rows on a line from the last window's speed, at first v0, to its own, ends included."""
    before = F.coalesce(F.lag("speed").over(W.partitionBy(key).orderBy("i")), F.col("v0"))
    rows = windows.withColumn("before", before).select(key, "i", "before", "speed", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("at"))
    share = F.when(F.col("n") > 1, F.col("at") / (F.col("n") - 1)).otherwise(0.0)
    return rows.select(key, (F.col("i") * size + F.col("at")).cast("long").alias("row"), (F.col("before") + share * (F.col("speed") - F.col("before"))).alias("speed_mps"))


def outage_track(windows: DataFrame, turns: DataFrame, key: str = "key", size: int = WINDOW_ROWS, dt: float = DT_S, sign: float = 1.0) -> DataFrame:
    """(key, row, east_m, north_m, heading_rad) through outages, from the windows' predicted speeds.

    ``windows`` (key, i, z, logvar, n, v0): implausible speeds are replaced, the rest filtered, and
    speeds filled in on a line. ``turns`` (key, row, yaw_rate, h0): the heading is the last known
    one and the sum of turn rates, or is held where they are 0.
    """
    checked = plausible_speeds(windows, key)
    fused = window_filter(checked.select(key, "i", "mean", "logvar", "v0"), key, dt=size * dt).select(key, "i", F.greatest("speed", F.lit(0.0)).alias("speed"))
    speeds = linear_profile(checked.select(key, "i", "n", "v0").join(fused, [key, "i"]), key, size)
    so_far = W.partitionBy(key).orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    turned = speeds.join(turns, [key, "row"]).withColumn("heading_rad", F.col("h0") + sign * dt * F.sum("yaw_rate").over(so_far))
    east, north = F.col("speed_mps") * F.sin("heading_rad") * dt, F.col("speed_mps") * F.cos("heading_rad") * dt
    return turned.select(key, "row", F.sum(east).over(so_far).alias("east_m"), F.sum(north).over(so_far).alias("north_m"), "heading_rad")


def time_warp(x: Column, factor: Column) -> Column:
    """A window resampled at a rate: row i is read at i * factor, between two rows on a line, never beyond the last."""
    last = F.size(x) - 1

    def row(_: Column, i: Column) -> Column:
        at = F.least(i * factor, last.cast("double"))
        low = F.floor(at).cast("int")
        high = F.least(low + 1, last)
        return F.zip_with(F.get(x, low), F.get(x, high), lambda a, b: a + (at - low) * (b - a))

    return F.transform(x, row)
