"""The outage benchmark: every way to bridge an outage under one interface, and its scores against the truth.

A baseline is a function of (outages, samples) that gives (key, i, pe, pn, heading_rad), i from 0 (where the outage begins) to its
number of rows. Outages are (key, seq_id, start, stop, ...); samples are (seq_id, row_idx, speed_mps, heading_deg, accel_x, accel_y, gyro_z, ...)
in the vehicle's frame, and only rows before an outage may be read for its speed and heading. New baselines and detectors are added to the registries
by name and are then run and scored like the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.nanops import finite
from kinelake.functions.scalar import wrapped_rad
from kinelake.operators import evaluation, features, filters, labels, navigation, network, sequences
from kinelake.schema import DT_S, RATE_HZ, WINDOW_ROWS
from kinelake.session import shared_path

Baseline = Callable[[DataFrame, DataFrame], DataFrame]
Detector = Callable[[DataFrame], DataFrame]
BASELINES: dict[str, Baseline] = {}
#: Functions of fixes (key, t, east_m, north_m, ...) that add stat, larger the less a fix is to be believed.
DETECTORS: dict[str, Detector] = {"residual": filters.fault_statistic}
#: Rows before an outage from which a gyro's sign and a model's bias are taken, and the fewest rows for a sign.
LOOKBACK_ROWS, SIGN_ROWS = 45 * RATE_HZ, 20


def baseline(name: str) -> Callable[[Baseline], Baseline]:
    def add(f: Baseline) -> Baseline:
        BASELINES[name] = f
        return f

    return add


def entry_states(outages: DataFrame, samples: DataFrame) -> DataFrame:
    """(key, v0, h0): speed and heading (radians) at the row before each outage."""
    last = sequences.row_before(outages.select("key", "seq_id", "start"), samples.select("seq_id", "row_idx", "speed_mps", "heading_deg"))
    return last.select("key", F.col("speed_mps").alias("v0"), F.radians("heading_deg").alias("h0"))


def outage_steps(outages: DataFrame, samples: DataFrame) -> DataFrame:
    """The samples of each outage, i from 0, with its entry state."""
    return sequences.interval_rows(outages.select("key", "seq_id", "start", "stop"), samples).join(entry_states(outages, samples), "key")


def gyro_signs(outages: DataFrame, samples: DataFrame, rows: int = LOOKBACK_ROWS, least: int = SIGN_ROWS) -> DataFrame:
    """(key, sign): 1, or -1 where the gyro ran against the heading's rate over the rows before the outage; 1 where there are too few or one of them is constant."""
    before = sequences.lookback_rows(outages.select("key", "seq_id", "start"), samples.select("seq_id", "row_idx", "heading_deg", "gyro_z"), rows)
    order = navigation.path("key")
    rate = wrapped_rad(F.radians(F.lead("heading_deg").over(order)) - F.radians("heading_deg")) / DT_S
    signs = labels.sign_of_corr(before.withColumn("rate", rate), "rate", "gyro_z", "key", least)
    return outages.select("key").join(signs, "key", "left").select("key", F.coalesce("sign", F.lit(1.0)).alias("sign"))


def _positions(track: DataFrame, heading: Column) -> DataFrame:
    return track.select("key", "i", F.col("east_m").alias("pe"), F.col("north_m").alias("pn"), heading.alias("heading_rad"))


@baseline("hold")
def hold(outages: DataFrame, samples: DataFrame) -> DataFrame:
    """The last speed and heading, held."""
    steps = outage_steps(outages, samples)
    track = navigation.dead_reckon(steps, F.col("v0"), F.col("h0"), DT_S)
    return _positions(track.join(entry_states(outages, samples), "key"), F.col("h0"))


@baseline("strapdown")
def strapdown(outages: DataFrame, samples: DataFrame) -> DataFrame:
    """Acceleration and turn rate integrated twice; the gyro's sign comes from the rows before the outage."""
    steps = outage_steps(outages, samples).join(gyro_signs(outages, samples), "key")
    rows = steps.select("key", "i", F.col("accel_x").alias("ax"), F.col("accel_y").alias("ay"), F.col("gyro_z").alias("gz"), "v0", "h0", "sign")
    track = navigation.strapdown(rows, DT_S)
    origin = entry_states(outages, samples).select("key", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("east_m"), F.lit(0.0).alias("north_m"), F.col("h0").alias("heading"))
    return _positions(track.unionByName(origin), F.col("heading"))


@baseline("filter")
def planar(outages: DataFrame, samples: DataFrame) -> DataFrame:
    """The planar filter with its constraints, without a model's speed."""
    steps = outage_steps(outages, samples)
    still = F.col("is_stationary") if "is_stationary" in samples.columns else F.lit(False)
    rows = steps.select("key", "i", F.col("accel_x").alias("ax"), F.col("accel_y").alias("ay"), F.col("gyro_z").alias("gz"), still.alias("is_stationary"), "v0", "h0")
    return _positions(filters.planar_filter(rows), F.col("heading_rad"))


def learned(model: network.Model, remove_bias: bool = True) -> Baseline:
    """A baseline of the model's speed a window: rejected where implausible, its median error before the outage taken off, filtered, filled in on a line, with the gyro's heading.

    ``samples`` need the model's features. An outage's last window may be short; it is padded.
    """
    size = model.contract.window_size_samples

    def windows_of(rows: DataFrame, key: str) -> DataFrame:
        placed = rows.withColumn("w", F.floor(F.col("i") / size)).withColumn("i", F.col("i") % size)
        return network.infer(features.feature_windows(placed, [key, "w"], size=size), model, [key, "w"])

    def predict(outages: DataFrame, samples: DataFrame) -> DataFrame:
        steps = stored(outage_steps(outages, samples), "outage-steps")
        said = windows_of(steps, "key").select("key", F.col("w").alias("i"), F.col("velocity_mean_mps").alias("z"), F.log("velocity_variance").alias("logvar"))
        if remove_bias:
            before = stored(sequences.lookback_rows(outages.select("key", "seq_id", "start"), samples, LOOKBACK_ROWS), "outage-lookback")
            # Whole windows only, and not the one that would end at the outage itself.
            whole = before.where(F.col("i") < F.floor((F.least(F.col("at"), F.lit(LOOKBACK_ROWS)) - 1) / size) * size)
            truth = whole.groupBy("key", F.floor(F.col("i") / size).alias("w")).agg(F.avg("speed_mps").alias("truth"))
            seen = windows_of(whole, "key").join(truth, ["key", "w"]).where("refused is null")
            bias = labels.bias_of_windows(seen, "truth", "velocity_mean_mps", "key").select("key", "bias")
            said = said.join(bias, "key", "left").withColumn("z", F.col("z") - F.coalesce("bias", F.lit(0.0))).drop("bias")
        counted = steps.groupBy("key", "v0", F.floor(F.col("i") / size).alias("i")).agg(F.count(F.lit(1)).alias("n"))
        windows = counted.join(said, ["key", "i"]).withColumn("logvar", F.coalesce("logvar", F.lit(0.0)))
        turns = steps.join(gyro_signs(outages, samples), "key").select("key", F.col("i").alias("row"), (F.col("gyro_z") * F.col("sign")).alias("yaw_rate"), "h0")
        track = features.outage_track(windows, turns, size=size).select("key", (F.col("row") + 1).alias("i"), "east_m", "north_m", "heading_rad")
        origin = entry_states(outages, samples).select("key", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("east_m"), F.lit(0.0).alias("north_m"), F.col("h0").alias("heading_rad"))
        return _positions(track.unionByName(origin), F.col("heading_rad"))

    return predict


def truths(outages: DataFrame, samples: DataFrame, lat: str = "lat_deg", lon: str = "lon_deg") -> DataFrame:
    """(key, i, te, tn, true_heading_rad) of each outage's rows, the one at its stop included, in metres about its start."""
    rows = sequences.interval_rows(outages.select("key", "seq_id", "start", "stop"), samples, inclusive=True)
    return navigation.local_enu(rows, lat, lon).select("key", "i", F.col("east_m").alias("te"), F.col("north_m").alias("tn"), F.radians("heading_deg").alias("true_heading_rad"))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written to the shared folder once and read from there."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run(outages: DataFrame, samples: DataFrame, baselines: dict[str, Baseline] | None = None) -> DataFrame:
    """(baseline, key, scores...) of every outage under every baseline; points without a counterpart on the other side are left out.

    Outages, samples, the truth and each baseline's track are worked out once and stored in the shared folder, as each is read many times.
    """
    outages, samples = stored(outages, "outages"), stored(samples, "outage-samples")
    truth = stored(truths(outages, samples), "outage-truth")
    out = None
    for name, predict in (baselines or BASELINES).items():
        pairs = stored(predict(outages, samples).join(truth, ["key", "i"]), "outage-pairs")
        headings = pairs.groupBy("key").agg(F.max_by("heading_rad", "i").alias("pred_heading_rad"), F.max_by("true_heading_rad", "i").alias("true_heading_rad"))
        scores = evaluation.score_outages(pairs.select("key", "i", "pe", "pn", "te", "tn"), headings).select(F.lit(name).alias("baseline"), "*")
        out = scores if out is None else out.unionByName(scores)
    return out


def summary(scores: DataFrame, outages: DataFrame) -> DataFrame:
    """(baseline, duration_s, scenario, median, p95, n) of the drift, by duration and by scenario."""
    keyed = scores.join(outages.select("key", "duration_s", "scenario").hint("merge"), "key").where(finite("drift_pct"))
    sets = keyed.groupingSets([["baseline", "duration_s"], ["baseline", "scenario"]], "baseline", "duration_s", "scenario")
    return sets.agg(F.percentile("drift_pct", 0.5).alias("median"), F.percentile("drift_pct", 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))
