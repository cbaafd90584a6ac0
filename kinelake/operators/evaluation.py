"""Scores of trajectories and of predicted uncertainties."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.nanops import divide, gt
from kinelake.functions.scalar import angle_gap_deg, normal_cdf
from kinelake.operators.navigation import path_length, rigid_align

OUTAGE_SECONDS = (30, 60, 120, 180)


def outage_candidates(segs: DataFrame, samples: DataFrame, speed: str, seconds: tuple[int, ...] = OUTAGE_SECONDS, rate: int = 10, every: int = 10, margin: int = 10, least_speed: float = 2.0) -> DataFrame:
    """(seq_id, seg_index, duration_s, start): rows on a grid where an outage of the duration fits the segment and the vehicle moves."""
    spark = segs.sparkSession
    spans = spark.createDataFrame([(s, s * rate) for s in seconds], "duration_s int, need long")
    fits = segs.crossJoin(F.broadcast(spans)).where(F.col("start") + margin <= F.col("stop") - F.col("need") - margin - 1)
    grid = fits.select("seq_id", "seg_index", "duration_s", "need", F.explode(F.sequence(F.col("start") + margin, F.col("stop") - F.col("need") - margin - 1, F.lit(every).cast("long"))).alias("start"))
    moving = samples.where(~F.isnan(speed) & (F.col(speed) >= least_speed)).select("seq_id", F.col("row_idx").alias("start"))
    # Spark takes the exploded grid for as many rows as the segments, so it would broadcast it.
    return grid.join(moving.hint("merge"), ["seq_id", "start"])


def pick_outages(candidates: DataFrame, each: int = 2, seed: str = "0") -> DataFrame:
    """``each`` candidates of every sequence, segment and duration, in the order of a hash of their keys: no shared random state."""
    key = F.concat_ws(":", F.col("seq_id").cast("string"), F.col("seg_index").cast("string"), F.col("start").cast("string"), F.col("duration_s").cast("string"))
    order = W.partitionBy("seq_id", "seg_index", "duration_s").orderBy(F.md5(F.concat(F.lit(seed), key).cast("binary")), "start")
    picked = candidates.withColumn("key", key).withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    return picked.drop("n").withColumn("stop", F.col("start") + F.col("need")).drop("need")


def stratified_pick(pool: DataFrame, per_duration: int, seed: str = "0") -> DataFrame:
    """``per_duration`` outages a duration, scenarios taken in turn from the largest on."""
    mine = W.partitionBy("duration_s", "scenario")
    sized = pool.withColumn("size", F.count(F.lit(1)).over(mine)).withColumn("turn", F.row_number().over(mine.orderBy(F.md5(F.concat(F.lit(seed), "key").cast("binary")), "key")))
    order = W.partitionBy("duration_s").orderBy("turn", F.desc("size"), "scenario")
    return sized.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_duration).drop("n", "turn", "size")


def topped_up_pick(pool: DataFrame, total: int, durations: int = 4, seed: str = "0") -> DataFrame:
    """``total`` outages of the pool (all, if there are fewer): an equal share of each duration as in ``stratified_pick``, and where durations run short the rest from what is left, in the order of a hash of the key."""
    chosen = stratified_pick(pool, total // durations, seed)
    short = total - chosen.count()
    if short <= 0:
        return chosen
    left = pool.join(chosen.select("key"), "key", "left_anti")
    more = left.orderBy(F.md5(F.concat(F.lit(seed), "key").cast("binary")), "key").limit(short)
    return chosen.unionByName(more.select(*chosen.columns))


def scenario(rows: DataFrame, speed: str, yaw: str, accel: str, key: str = "key", turning_rows: int = 30) -> DataFrame:
    """One of six scenarios for each key, from its rows numbered by i."""
    turn = F.abs(F.col(yaw))
    sized = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key)))
    edge = F.floor(F.floor(F.col("_n") / 2) / 2) + 1
    m = sized.groupBy(key).agg(
        F.min(speed).alias("least"),
        F.min(accel).alias("brake"),
        F.max(turn).alias("turn"),
        F.count_if(gt(turn, 0.12)).alias("turning"),
        F.avg(F.when(F.col("i") < edge, F.col(speed))).alias("head"),
        F.avg(F.when(F.col("i") >= F.col("_n") - edge, F.col(speed))).alias("tail"),
        F.avg(speed).alias("mean"),
        F.percentile(turn, 0.95).alias("p95"),
    )
    roundabout = (F.col("turning") > turning_rows) & (F.col("head") - F.col("least") > 3) & (F.col("tail") - F.col("least") > 3)
    kind = F.when(F.col("least") < 1.0, "stop_start").when(F.col("brake") < -2.5, "hard_braking").when(F.col("turn") > 0.35, "sharp_cornering").when(roundabout, "roundabout").when((F.col("mean") > 22) & (F.col("p95") < 0.05), "motorway_cruise").otherwise("urban")
    return m.select(key, kind.alias("scenario"))


def cross_track(pairs: DataFrame, key: str = "key", block: int = 256) -> DataFrame:
    """Distance of each predicted point (pe, pn) to its key's true polyline (te, tn): a block of points at a time meets the key's legs as arrays, so no pair becomes a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("i", kind="stable")
        line, points = d[["te", "tn"]].to_numpy(float), d[["pe", "pn"]].to_numpy(float)
        legs = np.diff(line, axis=0)
        size = (legs**2).sum(axis=1)
        away = np.full(len(points), np.nan)
        for a in range(0, len(points) if len(legs) else 0, block):
            off = points[a : a + block, None] - line[None, :-1]
            t = np.clip((off * legs).sum(axis=-1) / np.where(size == 0, 1e-9, size), 0.0, 1.0)
            gap = np.hypot(*np.moveaxis(off - t[..., None] * legs, -1, 0))
            known = ~np.isnan(gap).all(axis=1)
            away[a : a + block][known] = np.nanmin(gap[known], axis=1)
        out = pd.DataFrame({key: d[key].to_numpy(), "i": d["i"].to_numpy(), "cross_track_m": away})
        return out[~np.isnan(away)]

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (key, "i")}
    return pairs.select(key, "i", "pe", "pn", "te", "tn").groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, i {kinds['i']}, cross_track_m double")


def score_outages(pairs: DataFrame, headings: DataFrame | None = None, key: str = "key", rate: int = 10) -> DataFrame:
    """Distance, final and drift error, aligned and cross-track error, and the error once a second, of each key's (i, pe, pn, te, tn).

    ``headings`` (key, pred_heading_rad, true_heading_rad) adds the heading error in degrees.
    """
    error = F.hypot(F.col("pe") - F.col("te"), F.col("pn") - F.col("tn"))
    rows = pairs.withColumn("err", error)
    distance = path_length(pairs, key, "te", "tn")
    fitted = rows.join(rigid_align(pairs, key), key)
    s, c = F.sin("theta"), F.cos("theta")
    left = F.hypot(c * F.col("pe") - s * F.col("pn") + F.col("de") - F.col("te"), s * F.col("pe") + c * F.col("pn") + F.col("dn") - F.col("tn"))
    listed = F.array_sort(F.collect_list(F.struct("i", "err")))["err"]
    main = fitted.groupBy(key).agg(F.max_by("err", "i").alias("final_error_m"), F.sqrt(F.avg(left * left)).alias("ate_m"), listed.alias("errs"))
    last = F.size("errs") - 1
    growth = F.transform(F.filter(F.sequence(F.lit(0), last + 1, F.lit(1)), lambda i: (i > 0) & (i % rate == 0)), lambda i: F.col("errs")[F.least(i, last)])
    main = main.withColumn("error_growth_m", growth).drop("errs")
    off = cross_track(pairs, key).groupBy(key).agg(F.avg("cross_track_m").alias("cte_mean_m"), F.max("cross_track_m").alias("cte_max_m"))
    out = main.join(distance, key).join(off, key, "left").withColumnRenamed("length_m", "distance_m")
    out = out.withColumn("drift_pct", F.when(F.col("distance_m") > 1e-6, 100.0 * F.col("final_error_m") / F.col("distance_m")))
    if headings is not None:
        gap = angle_gap_deg(F.degrees("pred_heading_rad"), F.degrees("true_heading_rad"))
        out = out.join(headings.select(key, gap.alias("heading_error_deg")), key, "left")
    return out


def aggregate_scores(scores: DataFrame, value: str = "drift_pct") -> DataFrame:
    """Median, 95 % quantile and number by duration and by scenario, in one pass."""
    sets = scores.where(F.col(value).isNotNull() & ~F.isnan(value)).groupingSets([["duration_s"], ["scenario"]], "duration_s", "scenario")
    return sets.agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


def compare_runs(baseline: DataFrame, candidate: DataFrame, by: str = "duration_s", value: str = "median", limit_pct: float = 5.0) -> DataFrame:
    """Improvement of the candidate over the baseline in percent, and whether it got worse by more than the limit; null where it is missing."""
    both = baseline.select(by, F.col(value).alias("baseline")).join(candidate.select(by, F.col(value).alias("candidate")), by, "left")
    gain = 100.0 * divide(F.col("baseline") - F.col("candidate"), F.col("baseline"))
    return both.withColumn("improvement_pct", gain).withColumn("failed", gain < -limit_pct)


# Uncertainties: rows carry y, mu, logvar and a unique id.


def standardised(rows: DataFrame) -> DataFrame:
    sigma = F.exp(0.5 * F.col("logvar"))
    return rows.withColumn("sigma", sigma).withColumn("z", (F.col("y") - F.col("mu")) / sigma)


def equal_count_bin(rank0: Column, n: Column, bins: int) -> Column:
    """The bin of rank 0..n-1 when bin edges are the truncated even spacing of 0..n."""
    return F.floor((F.lit(bins) * (rank0 + 1) - 1) / n)


def spread_rank(rows: DataFrame, value: str, unique: str = "id", by: list[str] | None = None, cells: int | None = None) -> DataFrame:
    """Adds rank0, a row's place from 0 by (value, unique) among all rows or its group's, and n, their number, without one task for all.

    Rows are cut into cells at approximate quantiles of the value, rows that share a value which
    fills a cell also at quantiles of ``unique``; counts of cells before and ranks within add up to
    the exact rank, whatever the quantiles. NaN and null come last. ``unique`` is a number.
    """
    by = by or []
    cells = cells or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / cells for i in range(1, cells)] or [0.5]
    known = rows.where(~F.isnan(value))
    at, ids = known.agg(F.percentile_approx(value, shares, 10_000), F.percentile_approx(F.col(unique).cast("double"), shares, 10_000)).first()
    edges = sorted(set(at or []))
    often = [e for e, n in Counter(at or []).items() if n > 1]

    def cut(out: DataFrame, column: str, splits: list[float], name: str) -> DataFrame:
        return Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=column, outputCol=name, handleInvalid="keep").transform(out)

    placed = cut(rows.withColumn("_id", F.col(unique).cast("double")), value, edges, "_cell")
    placed = cut(placed, "_id", sorted(set(ids or [])), "_part")
    # Within a cell, rows at its lower edge come first, so only they are cut further.
    placed = placed.withColumn("_part", F.when(F.col(value).isin(often), F.col("_part")).otherwise(F.lit(math.inf)))
    counts = placed.groupBy(*by, "_cell", "_part").agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*by).orderBy("_cell", "_part")
    sums = [F.coalesce(F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(*by)).alias("n")]
    before = counts.select(*[F.col(c).alias(f"_b{c}") for c in (*by, "_cell", "_part")], *sums)
    met = placed.join(before, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in (*by, "_cell", "_part")])
    within = F.row_number().over(W.partitionBy(*by, "_cell", "_part").orderBy(F.asc_nulls_last(value), unique)) - 1
    return met.withColumn("rank0", F.col("_before") + within).select(*rows.columns, "rank0", "n")


def calibration_bins(rows: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Per bin of like predicted sigma: rows, root mean predicted variance, root mean squared error."""
    by = by or []
    ranked = spread_rank(standardised(rows), "logvar", "id", by)
    error = F.col("y") - F.col("mu")
    binned = ranked.withColumn("bin", equal_count_bin(F.col("rank0"), F.col("n"), bins).cast("int"))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("sigma") * F.col("sigma"))).alias("predicted"), F.sqrt(F.avg(error * error)).alias("realised"))


def calibration_error(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error, relative to the prediction and absolute, weighted by rows."""
    gap = F.abs(F.col("predicted") - F.col("realised"))
    relative = F.sum(F.col("n") * gap / F.col("predicted")) / F.sum("n")
    return binned.groupBy(*(by or [])).agg(relative.alias("ece_rel"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece_abs"))


def pit_ks(rows: DataFrame) -> DataFrame:
    """Largest gap between the probability integral transform's ranks and a uniform's."""
    ranked = spread_rank(standardised(rows).withColumn("pit", normal_cdf(F.col("z"))), "pit")
    return ranked.agg(F.max(F.abs(F.col("pit") - (F.col("rank0") + 1) / F.col("n"))).alias("pit_ks"))


def coverage(rows: DataFrame, ks: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Share of rows within k sigma, beside the Gaussian's: one pass, one small row unpivoted."""
    z = F.abs("z")
    wide = standardised(rows).agg(F.array(*[F.struct(F.lit(k).alias("k"), F.avg((z <= k).cast("int")).alias("covered")) for k in ks]).alias("rows"))
    out = wide.select(F.explode("rows").alias("r")).select("r.k", "r.covered")
    return out.withColumn("expected", 2 * normal_cdf(F.col("k")) - 1)


def nll_temperature(rows: DataFrame, label_sigma: str | None = None) -> DataFrame:
    """The temperature of least negative log-likelihood: the root of the mean squared error in predicted variances, the label's own variance taken off it."""
    error = F.col("y") - F.col("mu")
    variance = F.greatest(F.exp("logvar"), F.lit(1e-9))
    if label_sigma is None:
        return rows.agg(F.sqrt(F.avg(error * error / variance)).alias("temperature"))
    left = F.greatest(error * error - F.col(label_sigma) * F.col(label_sigma), F.lit(0.0))
    return rows.agg(F.sqrt(F.greatest(F.avg(left / variance), F.lit(1e-6))).alias("temperature"))


def speed_losses(rows: DataFrame, label_sigma: str | None = None, weight: str | None = None, by: list[str] | None = None, clamp: tuple[float, float] = (-8.0, 6.0)) -> DataFrame:
    """Per group of (y, mu, logvar): negative log-likelihood, weighted root mean squared error and bias, and mean predicted sigma."""
    variance = F.exp(F.least(F.greatest("logvar", F.lit(clamp[0])), F.lit(clamp[1])))
    whole = F.greatest(variance if label_sigma is None else variance + F.col(label_sigma) * F.col(label_sigma), F.lit(1e-6))
    w, gap = F.lit(1.0) if weight is None else F.col(weight), F.col("mu") - F.col("y")
    total = F.greatest(F.sum(w), F.lit(1.0))
    nll = F.avg(0.5 * (F.log(whole) + gap * gap / whole))
    return rows.groupBy(*(by or [])).agg(nll.alias("nll"), F.sqrt(F.sum(w * gap * gap) / total).alias("rmse"), (F.sum(w * gap) / total).alias("bias"), F.avg(F.sqrt(variance)).alias("pred_sigma_mean"))


#: Critical values of the chi-square distribution by confidence, for 1 to 6 dimensions.
CRITICAL = {95: (3.841, 5.991, 7.815, 9.488, 11.070, 12.592), 99: (6.635, 9.210, 11.345, 13.277, 15.086, 16.812)}


def chi_square_gate(statistic: Column, dimensions: Column, confidence: int = 95) -> Column:
    """Whether a squared Mahalanobis distance is accepted; an error where no value is tabulated."""
    table = F.array(*map(F.lit, CRITICAL[confidence]))
    limit = F.when(dimensions.between(1, 6), table[dimensions - 1]).otherwise(F.raise_error(F.lit("no critical value for so many dimensions")).cast("double"))
    return statistic <= limit


def temperatures(low: float = 0.3, high: float = 4.0, n: int = 60) -> list[float]:
    return [low * math.exp(i * math.log(high / low) / (n - 1)) for i in range(n)]


def fit_temperature(rows: DataFrame, grid: list[float] | None = None, bins: int = 10) -> DataFrame:
    """The temperature whose scaled sigmas have the least relative calibration error, the first of equals.

    Scaling keeps the order, so the bins are made once and only their predictions scale.
    """
    binned = calibration_bins(rows, bins)
    scale = F.explode(F.array(*[F.lit(t) for t in (grid or temperatures())])).alias("t")
    scaled = binned.select("*", scale).withColumn("predicted", F.col("predicted") * F.col("t"))
    return calibration_error(scaled, ["t"]).agg(F.min_by("t", F.struct("ece_rel", "t")).alias("temperature"), F.min("ece_rel").alias("ece_rel"))


def tempered(logvar: Column, temperature: float) -> Column:
    return logvar + 2 * math.log(max(temperature, 1e-6))


def isotonic_knots(rows: DataFrame, bins: int = 15, least: int = 5) -> list[tuple[float, float]]:
    """Knots (predicted, calibrated) from bins of at least ``least`` rows, merged until they rise. The bins are few, so they end on the driver."""
    cells = sorted((r["predicted"], r["realised"], r["n"]) for r in calibration_bins(rows, bins).collect() if r["n"] >= least)
    merged: list[list] = []
    for x, y, n in cells:
        merged.append([[x], y, n])
        while len(merged) > 1 and merged[-2][1] > merged[-1][1]:
            xs, y2, n2 = merged.pop()
            last = merged[-1]
            merged[-1] = [last[0] + xs, (last[1] * last[2] + y2 * n2) / (last[2] + n2), last[2] + n2]
    return [(x, y) for xs, y, _ in merged for x in xs]


def interpolated(value: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, flat outside."""
    if not knots:
        return value
    out = F.when(value <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        if x1 > x0:
            out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(knots[-1][1])


def slices(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, root mean squared error, bias and mean truth: of all, and by each column."""
    error = F.col("mu") - F.col("y")
    sets = rows.groupingSets([[], *[[c] for c in by]], *by)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), F.avg("y").alias("mean_y"))


def over_seeds(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def roc(stats: DataFrame, clean: DataFrame, levels: int = 25, target: float = 0.02) -> DataFrame:
    """(threshold, false_rejection, family, param, detection): detection is the share of instances with any attacked statistic
    within the family's horizon at or over the threshold; instances without one in reach don't count.

    ``stats``: family, param, instance, reachable, stat; ``clean``: stat. Each instance keeps its largest
    reachable statistic, so thresholds meet one row an instance.
    """
    qs = [0.5 + i * (0.999 - 0.5) / (levels - 1) for i in range(levels)]
    cut = clean.agg(F.explode(F.array_distinct(F.percentile("stat", F.array(*[F.lit(q) for q in qs])))).alias("threshold"))
    false = clean.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg((F.col("stat") >= F.col("threshold")).cast("int")).alias("false_rejection"))
    best = stats.where("reachable").groupBy("family", "param", "instance").agg(F.max("stat").alias("best"))
    found = best.crossJoin(F.broadcast(false)).groupBy("threshold", "false_rejection", "family", "param").agg(F.avg((F.col("best") >= F.col("threshold")).cast("int")).alias("detection"))
    return found.withColumn("meets_target", F.col("false_rejection") <= target)


def provably_undetected(detection: DataFrame) -> DataFrame:
    """Per family the largest parameter that at most half the instances reveal."""
    return detection.groupBy("family").agg(F.max(F.when(F.col("detection") <= 0.5, F.col("param"))).alias("undetected_up_to"))


def check_curves(expected: DataFrame, current: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Expected detection curves that the current run misses by more than the tolerance, or lacks."""
    both = expected.select("family", "param", F.col("detection").alias("expected")).join(current.select("family", "param", F.col("detection").alias("current")), ["family", "param"], "left")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("expected") - F.col("current")) <= tolerance, F.lit(False)))
