"""Backward smoothing of tracks, resampling to a fixed grid, removal of spikes, and low-pass decimation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.nanops import finite
from kinelake.kernels.planar import lockstep
from kinelake.operators.filters import numbered

STATE = ["pe", "ve", "pn", "vn", "cpp", "cpv", "cvv"]


def carried(frames: Iterator[pd.DataFrame], columns: list[str], size: int, step) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Runs ``step(rows, states, fresh)`` over frames in the order of their keys, all keys of a frame side by side; the last key's state goes on into the next frame.

    ``states`` has a row a key, ``fresh`` says which have none yet.
    """
    held, held_key = None, None
    for d in frames:
        if not len(d):
            continue
        codes = numbered(d["key"])
        states, fresh = np.zeros((codes.max() + 1, size)), np.ones(codes.max() + 1, dtype=bool)
        first = d["key"].iloc[0]
        if held is not None and (first == held_key or (pd.isna(first) and pd.isna(held_key))):
            states[0], fresh[0] = held, False
        values = d[columns].to_numpy(dtype=float)
        out = None
        for rows in lockstep(codes):
            made, after = step(values[rows], states[codes[rows]], fresh[codes[rows]])
            out = np.empty((len(d), made.shape[1])) if out is None else out
            out[rows], states[codes[rows]], fresh[codes[rows]] = made, after, False
        held, held_key = states[codes[-1]], d["key"].iloc[-1]
        yield d, out


def _forward(values: np.ndarray, states: np.ndarray, fresh: np.ndarray, noise: float, start_var: float) -> tuple[np.ndarray, np.ndarray]:
    """One row a key of the filter: time, position (NaN in an outage), variance. Gives predicted and filtered state, the step in time and the row's number."""
    t, east, north, var = values.T
    pe, ve, pn, vn, cpp, cpv, cvv, before, number = states.T
    number = np.where(fresh, 0.0, number + 1)
    dt = np.where(fresh, 0.0, t - before)
    pe, pn = pe + dt * ve, pn + dt * vn
    app = cpp + dt * (2 * cpv + dt * cvv) + noise * dt**3 / 3
    apv = cpv + dt * cvv + noise * dt**2 / 2
    avv = cvv + noise * dt
    seen = np.isfinite(east) & np.isfinite(north) & np.isfinite(var)
    pe, pn, ve, vn = (np.where(fresh, x, y) for x, y in ((np.where(seen, east, 0.0), pe), (np.where(seen, north, 0.0), pn), (0.0, ve), (0.0, vn)))
    app, apv, avv = (np.where(fresh, x, y) for x, y in ((start_var, app), (0.0, apv), (start_var, avv)))
    predicted = np.stack([pe, ve, pn, vn, app, apv, avv], axis=1)
    with np.errstate(invalid="ignore"):
        gain_p, gain_v = np.where(seen, app / (app + var), 0.0), np.where(seen, apv / (app + var), 0.0)
    miss_e, miss_n = np.where(seen, east - pe, 0.0), np.where(seen, north - pn, 0.0)
    after = np.stack([pe + gain_p * miss_e, ve + gain_v * miss_e, pn + gain_p * miss_n, vn + gain_v * miss_n, (1 - gain_p) * app, (1 - gain_p) * apv, avv - gain_v * apv, t, number], axis=1)
    return np.concatenate([predicted, after[:, :7], dt[:, None], number[:, None]], axis=1), after


def _backward(values: np.ndarray, states: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row a key of the smoother, last row first: filtered state, and the prediction and step that the row after it had."""
    now, (later, ahead) = values[:, :7], (states[:, :7], states[:, 7:])
    pe, ve, pn, vn, cpp, cpv, cvv = now.T
    dt = ahead[:, 7]
    app, apv, avv = ahead[:, 4], ahead[:, 5], ahead[:, 6]
    det = np.where(fresh, 1.0, app * avv - apv**2)
    # The filtered covariance times the transition's transpose, times the inverse of the predicted one.
    xpp, xpv, xvp, xvv = cpp + dt * cpv, cpv, cpv + dt * cvv, cvv
    gpp, gpv = (xpp * avv - xpv * apv) / det, (xpv * app - xpp * apv) / det
    gvp, gvv = (xvp * avv - xvv * apv) / det, (xvv * app - xvp * apv) / det
    dpe, dve, dpn, dvn = (later[:, i] - ahead[:, i] for i in range(4))
    spp, spv, svv = later[:, 4] - app, later[:, 5] - apv, later[:, 6] - avv
    out = np.stack([pe + gpp * dpe + gpv * dve, ve + gvp * dpe + gvv * dve, pn + gpp * dpn + gpv * dvn, vn + gvp * dpn + gvv * dvn, cpp + gpp * (gpp * spp + gpv * spv) + gpv * (gpp * spv + gpv * svv), cpv + gpp * (gvp * spp + gvv * spv) + gpv * (gvp * spv + gvv * svv), cvv + gvp * (gvp * spp + gvv * spv) + gvv * (gvp * spv + gvv * svv)], axis=1)
    out = np.where(fresh[:, None], now, out)
    return out, np.concatenate([out, values[:, 7:]], axis=1)


def smooth_tracks(fixes: DataFrame, noise: float = 1.0, start_var: float = 1e4) -> DataFrame:
    """(key, t, east_m, north_m, ve_mps, vn_mps, var_m2, filtered_east_m, filtered_north_m) of fixes (key, t, east_m, north_m, var).

    A filter of constant velocity (white acceleration of spectral density ``noise``) goes forward in time, then a
    Rauch-Tung-Striebel smoother backward, so that the rows of an outage (null positions) follow from the fixes on both sides.
    A key's first row starts the filter at its position, at rest, with the variance ``start_var`` in both. The forward pass's rows are
    sorted again, latest first, by Spark, which spills where it must: neither pass holds more than a batch and one state, however long a key.
    Rows of equal times keep the order of their positions; rows without a time are dropped; an empty table gives none.
    """
    kind = fixes.schema["key"].dataType.simpleString()
    columns = ["t", "east_m", "north_m", "var"]

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, out in carried(frames, columns, 9, lambda *a: _forward(*a, noise, start_var)):
            made = pd.DataFrame(out, columns=[*(f"a_{c}" for c in STATE), *STATE, "dt", "i"]).astype({"i": "int64"})
            yield pd.concat([d[["key", "t"]].reset_index(drop=True), made], axis=1)

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inputs = [*STATE, *(f"a_{c}" for c in STATE), "dt"]
        for d, out in carried(frames, inputs, 15, _backward):
            yield pd.DataFrame({"key": d["key"].to_numpy(), "t": d["t"].to_numpy(), "east_m": out[:, 0], "north_m": out[:, 2], "ve_mps": out[:, 1], "vn_mps": out[:, 3], "var_m2": out[:, 4], "filtered_east_m": d["pe"].to_numpy(), "filtered_north_m": d["pn"].to_numpy()})

    rows = fixes.select("key", *[F.col(c).cast("double").alias(c) for c in columns]).where(finite("t"))
    doubles = ", ".join(f"{c} double" for c in [*(f"a_{c}" for c in STATE), *STATE, "dt"])
    passed = rows.repartition("key").sortWithinPartitions("key", *columns).mapInPandas(forward, f"key {kind}, t double, {doubles}, i long")
    back = passed.repartition("key").sortWithinPartitions("key", F.desc("i"))
    return back.mapInPandas(backward, f"key {kind}, t double, " + ", ".join(f"{c} double" for c in ("east_m", "north_m", "ve_mps", "vn_mps", "var_m2", "filtered_east_m", "filtered_north_m")))


def resample(samples: DataFrame, t: str, values: list[str], step: int, most_gap: int, by: str = "key", stretch: int = 0) -> DataFrame:
    """(by, t, values, filled): values on the grid of multiples of ``step``, on a line between the samples on both sides.

    ``t`` is an integer clock; samples may come in any order, and of those at one time the one with the smallest values stands. A grid point between
    samples more than ``most_gap`` apart has null values and filled false; points outside a key's samples aren't there.
    Each pair of neighbours gives its own grid points, so nothing is joined by range. With ``stretch`` (in units of the
    clock) a key's neighbours are found stretch by stretch, and the first sample of each stretch is sent to the one
    before, so that a key with very many samples is spread over many tasks.
    """
    clock = F.col(t).cast("long")
    rows = samples.where(clock.isNotNull()).select(by, clock.alias("_t"), *values)
    part = F.floor(F.col("_t") / stretch) if stretch else F.lit(0).cast("long")
    rows = rows.groupBy(by, "_t").agg(F.min(F.struct(*values)).alias("_v")).withColumn("_part", part)
    order = W.partitionBy(by, "_part").orderBy("_t")
    later = F.lead(F.struct("_t", "_v")).over(order)
    if stretch:
        firsts = rows.groupBy(by, "_part").agg(F.min(F.struct("_t", "_v")).alias("_next"))
        before = firsts.withColumn("_part", F.lag("_part").over(W.partitionBy(by).orderBy("_part"))).where(F.col("_part").isNotNull())
        rows = rows.withColumn("_later", later).join(before, [by, "_part"], "left").withColumn("_later", F.coalesce("_later", "_next"))
    else:
        rows = rows.withColumn("_later", later)
    low = F.ceil(F.col("_t") / step)
    high = F.when(F.col("_later").isNull(), F.floor(F.col("_t") / step)).otherwise(F.ceil(F.col("_later._t") / step) - 1)
    grid = rows.where(high >= low).withColumn("_k", F.explode(F.sequence(low, high)))
    at = F.col("_k") * step
    exact = at == F.col("_t")
    near = exact | ((F.col("_later._t") - F.col("_t")) <= most_gap)
    share = (at - F.col("_t")) / (F.col("_later._t") - F.col("_t"))
    line = lambda c: F.when(exact, F.col(f"_v.{c}")).when(near, F.col(f"_v.{c}") + share * (F.col(f"_later._v.{c}") - F.col(f"_v.{c}")))
    return grid.select(by, at.alias(t), *[line(c).alias(c) for c in values], F.coalesce(near, F.lit(False)).alias("filled"))


def median(values: Column) -> Column:
    """Of an array; the mean of the middle two of an even number."""
    ordered = F.array_sort(values)
    half = F.floor(F.size(values) / 2).cast("int")
    return F.when(F.size(values) % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)


#: A normal distribution's deviation over its median absolute deviation.
MAD_TO_STD = 1.4826


def despike(samples: DataFrame, value: str, reach: int = 3, limit: float = 3.0, by: str = "seq_id", order: str = "row_idx") -> DataFrame:
    """Adds median, mad, is_spike and despiked: a value further than ``limit`` deviations from the median of the rows around it is replaced by that median.

    The rows are ``reach`` on either side and the row itself, fewer at the ends; the deviation is their median absolute deviation times 1.4826, and where
    it is 0 any other value is a spike. Missing values (null, NaN, infinite) are in no median and stay as they are.
    """
    frame = W.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)
    known = F.when(finite(value), F.col(value).cast("double"))
    rows = samples.withColumn("_near", F.collect_list(known).over(frame))
    rows = rows.withColumn("median", median(F.col("_near")))
    rows = rows.withColumn("mad", median(F.transform("_near", lambda v: F.abs(v - F.col("median")))))
    spike = F.coalesce(known.isNotNull() & (F.abs(known - F.col("median")) > limit * MAD_TO_STD * F.col("mad")), F.lit(False))
    return rows.withColumn("is_spike", spike).withColumn("despiked", F.when(F.col("is_spike"), F.col("median")).otherwise(F.col(value))).drop("_near")


def low_pass_taps(cutoff_hz: float, rate_hz: float, taps: int) -> list[float]:
    """Weights of a symmetric low-pass of odd length: a windowed (Hamming) sinc, summing to 1."""
    if taps % 2 == 0 or not 0 < cutoff_hz < rate_hz / 2:
        raise ValueError("an odd number of taps and a cutoff below half the rate are needed")
    at = np.arange(taps) - taps // 2
    shape = np.sinc(2 * cutoff_hz / rate_hz * at) * (0.54 + 0.46 * np.cos(2 * math.pi * at / (taps - 1) if taps > 1 else at))
    return (shape / shape.sum()).tolist()


def decimate(samples: DataFrame, value: str, every: int, weights: list[float], by: str = "seq_id", order: str = "row_idx") -> DataFrame:
    """(by, order, value): each ``every``-th row (by its number), the rows around it weighted, so that nothing beyond the cutoff folds back.

    ``order`` counts rows from 0 without gaps. At the ends the weights that have rows are scaled up to 1. A missing value makes the result missing.
    """
    reach = len(weights) // 2
    frame = W.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    rows = samples.withColumn("_near", F.collect_list(F.struct(F.col(order).alias("at"), x.alias("x"))).over(frame)).where(F.col(order) % every == 0)
    w = F.array(*[F.lit(v) for v in weights])
    weight = lambda r: F.get(w, (r["at"] - F.col(order) + reach).cast("int"))
    total = F.aggregate("_near", F.lit(0.0), lambda a, r: a + weight(r) * r["x"])
    share = F.aggregate("_near", F.lit(0.0), lambda a, r: a + weight(r))
    return rows.select(by, order, F.nanvl(total / share, F.lit(None).cast("double")).alias(value))
