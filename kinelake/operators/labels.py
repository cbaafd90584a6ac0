"""Sequence quality, regressions through aggregates, and labels of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake import schema
from kinelake.functions.nanops import col, divide, finite, gt, in_order, known, lt, mean_of, moment_corr, rounded, std_pop_of
from kinelake.operators.sequences import centred_std

#: Factors on a label's sigma by a sequence's usability; others count as UNKNOWN_FACTOR.
USABILITY_FACTOR = {"use": 1.0, "weak": 1.4}
UNKNOWN_FACTOR = 1.6


def imputed(value: str) -> Column:
    """Missing values as the sequence's mean."""
    mean = F.avg(known(value)).over(W.partitionBy("seq_id"))
    return F.coalesce(known(value), mean)


def corr_with_imputation(samples: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per sequence a correlation for each name -> (x, y), missing values imputed by the mean."""
    for name, (x, y) in pairs.items():
        samples = samples.withColumn(f"_{name}_x", imputed(x)).withColumn(f"_{name}_y", imputed(y))
    return samples.groupBy("seq_id").agg(*[moment_corr(f"_{n}_x", f"_{n}_y").alias(n) for n in pairs])


def regression_r2(samples: DataFrame, y: str, xs: tuple[str, str, str], by: str = "seq_id", least_rows: int = 200, least_std: float = 1e-3) -> DataFrame:
    """R squared of y on three columns and an intercept, per group, from covariances and Cramer's rule.

    Null without more than ``least_rows`` finite rows or where y hardly varies.
    """
    rows = samples.where(finite(y) & finite(xs[0]) & finite(xs[1]) & finite(xs[2]))
    names = [*xs, y]
    aggs = [F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i in range(4) for j in range(i, 4)]
    m = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)

    def c(i: int, j: int) -> Column:
        return F.col(f"c{min(i, j)}{max(i, j)}")

    def det(columns: list[list[Column]]) -> Column:
        a, b, d = columns
        return a[0] * (b[1] * d[2] - b[2] * d[1]) - b[0] * (a[1] * d[2] - a[2] * d[1]) + d[0] * (a[1] * b[2] - a[2] * b[1])

    sides, goal = [[c(i, j) for i in range(3)] for j in range(3)], [c(i, 3) for i in range(3)]
    base = det(sides)
    betas = [divide(det([goal if j == k else sides[j] for j in range(3)]), base) for k in range(3)]
    explained = sum(b * g for b, g in zip(betas, goal, strict=True))
    enough = (F.col("n") > least_rows) & (F.sqrt(c(3, 3)) > least_std)
    return m.select(by, "n", F.when(enough, divide(explained, c(3, 3))).alias("r2"))


def fractions(samples: DataFrame, speed: str, yaw: str) -> DataFrame:
    """Shares of rows moving (over 1 m/s) and turning (over 0.05 rad/s); missing rows count as neither."""
    share = lambda c: F.avg(c.cast("int"))
    return samples.groupBy("seq_id").agg(share(gt(speed, 1.0)).alias("move_fraction"), share(gt(F.abs(yaw), 0.05)).alias("turn_fraction"))


def usability(vibration: Column | str, r2: Column | str, sync: Column | str, move: Column | str) -> Column:
    """drop, use or weak; a missing correlation counts 0, a missing sync correlation 1."""
    v, r, s = F.coalesce(col(vibration), F.lit(0.0)), F.coalesce(col(r2), F.lit(0.0)), F.coalesce(col(sync), F.lit(1.0))
    return F.when((col(move) < 0.05) | (s < 0.30), "drop").when((v >= 0.35) | (r >= 0.50), "use").when((v >= 0.20) | (r >= 0.30), "weak").otherwise("drop")


def score_sequences(samples: DataFrame, accel: list[str], gyro: tuple[str, str, str], speed: str = "veh_speed_mps", yaw: str = "veh_yaw_rate_radps", gps_speed: str = "phone_gps_speed_mps", least_rows: int = 200) -> DataFrame:
    """(seq_id, vib_speed_corr, lsq_yaw_r2, sync_speed_corr, move_fraction, turn_fraction, usability) of each sequence, from its paired samples.

    Vibration is the standard deviation of the acceleration's size over a second around each row; its correlation with the speed, how well the phone's
    turn rates explain the vehicle's, and the correlation of both speeds say whether the phone was fixed and in step. Scores that can't be had are null;
    usability is decided on the unrounded ones.
    """
    size = F.sqrt(sum((F.col(a) * F.col(a) for a in accel), F.lit(0.0)))
    rows = centred_std(samples.withColumn("_size", size), "_size")
    corr = corr_with_imputation(rows, {"vib_speed_corr": ("rolling_std", speed), "sync_speed_corr": (gps_speed, speed)})
    r2 = regression_r2(samples, yaw, gyro, least_rows=least_rows).select("seq_id", F.col("r2").alias("lsq_yaw_r2"))
    out = corr.join(r2, "seq_id", "left").join(fractions(samples, speed, yaw), "seq_id")
    kind = usability("vib_speed_corr", "lsq_yaw_r2", "sync_speed_corr", "move_fraction")
    return out.select("seq_id", *[rounded(c, 3).alias(c) for c in ("vib_speed_corr", "lsq_yaw_r2", "sync_speed_corr", "move_fraction", "turn_fraction")], kind.alias("usability"))


def clean_rows(speed: str = "veh_speed_mps", yaw: str = "veh_yaw_rate_radps", sats: str = "veh_gps_sats", wheels=schema.WHEELS) -> Column:
    """Straight, fast, well-tracked rows with all wheels known."""
    fine = lt(F.abs(F.col(yaw)), 0.03) & gt(speed, 5.0) & ~F.isnan(sats) & (F.col(sats) >= 4) & finite(speed)
    for wheel in wheels:
        fine = fine & finite(wheel)
    return fine


def origin_slope(rows: DataFrame, x: str, y: str, by: str, least: int = 100) -> DataFrame:
    """y = r x per group of at least ``least`` rows; with the slope of all such rows, and the groups' spread.

    Sums go up twice: from rows to groups, and from the few groups to one row.
    """
    groups = rows.groupBy(by).agg(F.sum(F.col(y) * F.col(x)).alias("yx"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    total = groups.agg(divide(F.sum("yx"), F.sum("xx")).alias("slope_all"), F.stddev_pop(divide(F.col("yx"), F.col("xx"))).alias("spread"))
    return groups.select(by, "n", divide(F.col("yx"), F.col("xx")).alias("slope")).crossJoin(F.broadcast(total))


def speed_rmse(rows: DataFrame, error: Column, by: str = "seq_id", least: int = 50, default: float = 0.20) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.sqrt(F.avg(error * error))).otherwise(default).alias("speed_rmse"))


def displacement_labels(window_rows: DataFrame, wheel_speed: str, can_speed: str, rmse: Column, sync_corr: Column, use: Column, dt: float = schema.DT_S, by: tuple[str, ...] = ("seq_id", "start", "stop")) -> DataFrame:
    """Displacement and its sigma for each window, from rows that carry the window's keys."""
    v = F.col(wheel_speed)
    m = window_rows.withColumn("_rmse", rmse).withColumn("_sync", sync_corr).withColumn("_use", use).groupBy(*by).agg(
        (F.sum(v) * dt).alias("displacement_m"),
        (0.5 * dt * F.coalesce(F.sum(known(F.abs(v - F.col(can_speed)))), F.lit(0.0))).alias("sigma_wheelcan_m"),
        F.abs(F.max_by(v, "row_idx") - F.min_by(v, "row_idx")).alias("dspeed_mps"),
        *[F.first(c).alias(c) for c in ("_rmse", "_sync", "_use")],
    )
    duration = (F.col("stop") - F.col("start")) * dt
    offset = 2.0 * (1.0 - F.coalesce("_sync", F.lit(0.85)))
    factors = F.create_map(*[F.lit(x) for pair in USABILITY_FACTOR.items() for x in pair])
    m = m.withColumn("sigma_gnss_m", F.col("_rmse") * duration).withColumn("sigma_sync_m", F.hypot(0.3 * F.col("dspeed_mps"), offset))
    base = F.sqrt(sum(F.col(c) * F.col(c) for c in ("sigma_wheelcan_m", "sigma_gnss_m", "sigma_sync_m")))
    sigma = F.greatest(base * F.coalesce(F.try_element_at(factors, F.col("_use")), F.lit(UNKNOWN_FACTOR)), F.lit(0.05))
    return m.select(*by, "displacement_m", (F.col("displacement_m") / duration).alias("mean_speed_mps"), sigma.alias("label_sigma_m"), "sigma_wheelcan_m", "sigma_gnss_m", "sigma_sync_m", "dspeed_mps")


def gnss_labels(window_rows: DataFrame, speed: str, accuracy: str, by: tuple[str, ...] = ("seq_id", "start", "stop")) -> DataFrame:
    """A weak speed label: refused with missing values or a median accuracy over 20 m; sigma grows with both and with a held speed."""
    v, acc = F.col(speed), F.col(accuracy)
    m = window_rows.groupBy(*by).agg(
        F.avg(v).alias("mean_speed_mps"),
        F.percentile(acc, 0.5).alias("accuracy_m"),
        F.abs(F.max_by(v, "row_idx") - F.min_by(v, "row_idx")).alias("dspeed_mps"),
        F.count_distinct(F.round(v, 3)).alias("distinct_speeds"),
        F.count_if(~(finite(v) & finite(acc))).alias("missing"),
    )
    reason = F.when(F.col("missing") > 0, "missing").when(F.col("accuracy_m") > 20, "accuracy")
    sigma = 1.2 + 0.15 * F.col("accuracy_m") + 0.10 * F.col("dspeed_mps") + F.when(F.col("distinct_speeds") <= 1, 1.0).otherwise(0.0)
    return m.select(*by, "mean_speed_mps", sigma.alias("sigma_mps"), reason.isNull().alias("ok"), reason.alias("reason"))


def context_labels(window_rows: DataFrame, speed: str, wheel: str, by: tuple[str, ...] = ("seq_id", "start", "stop")) -> DataFrame:
    """0 stopped, 1 smooth, 2 rough: by mean speed and the deviation of the wheel rate's demeaned first difference.

    Both are summed in the order of rows, so what stands on a limit is judged alike however the rows came.
    """
    step = F.col(wheel) - F.lag(wheel).over(W.partitionBy(*by).orderBy("row_idx"))
    m = window_rows.withColumn("_step", step).groupBy(*by).agg(in_order("row_idx", known(speed)).alias("_speeds"), in_order("row_idx", "_step").alias("_steps"))
    m = m.withColumns({"mean_speed_mps": mean_of(F.col("_speeds")), "jitter": std_pop_of(F.col("_steps"))}).drop("_speeds", "_steps")
    return m.withColumn("context", F.when(F.col("mean_speed_mps") < 1.0, 0).when(F.col("jitter") > 0.135, 2).otherwise(1))


def weights_by_decile(rows: DataFrame, value: str, most: float = 4.0) -> DataFrame:
    """Equal-width deciles of a value and inverse square root of their share as weight, mean 1, within [1/most, most]."""
    everything = W.partitionBy()
    top = rows.agg(F.max(value).alias("_top"))
    placed = rows.crossJoin(F.broadcast(top)).withColumn("decile", F.least(F.greatest(F.floor(F.col(value) / (F.col("_top") + 1e-6) * 10), F.lit(0)), F.lit(9)).cast("int")).drop("_top")
    counts = placed.groupBy("decile").agg(F.count(F.lit(1)).alias("n")).withColumn("raw", 1.0 / F.sqrt("n"))
    mean = F.sum(F.col("raw") * F.col("n")).over(everything) / F.sum("n").over(everything)
    table = counts.select("decile", "n", F.least(F.greatest(F.col("raw") / mean, F.lit(1 / most)), F.lit(most)).alias("weight"))
    return placed.join(F.broadcast(table), "decile")


def class_counts(rows: DataFrame, label: str, classes: int = 3) -> DataFrame:
    """Rows of each class from 0, absent ones with 0."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(classes).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def normaliser(values: DataFrame, channel: str, value: str) -> DataFrame:
    """Population mean and deviation of each channel, a deviation under 1e-8 taken as 1."""
    m = values.groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return m.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def bias_of_windows(window_rows: DataFrame, truth: str, estimate: str, key: str, limit: float = 8.0, least: int = 3) -> DataFrame:
    """Median residual of each key's windows, within +-limit; 0 with under ``least`` windows."""
    residual = F.percentile(F.col(estimate) - F.col(truth), 0.5)
    return window_rows.groupBy(key).agg(F.when(F.count(F.lit(1)) >= least, F.greatest(F.least(residual, F.lit(limit)), F.lit(-limit))).otherwise(0.0).alias("bias"))


def sign_of_corr(rows: DataFrame, x: str, y: str, key: str, least: int) -> DataFrame:
    """+1 or -1 by the sign of the covariance of a key's finite rows; +1 with under ``least``."""
    fine = rows.where(finite(x) & finite(y))
    sign = F.when((F.count(F.lit(1)) < least) | (F.covar_pop(x, y) >= 0), 1.0).otherwise(-1.0)
    return fine.groupBy(key).agg(sign.alias("sign"))


