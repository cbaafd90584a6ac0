"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions import scalar
from kinelake.functions.nanops import rounded
from kinelake.operators import alignment, evaluation, filters, ingest, labels, navigation, sequences, splits
from kinelake.plans.samples import GUARD, SAMPLES, SEGMENTS, STRIDE, WINDOW, WINDOWS, event_samples, event_segments, event_windows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SAMPLES}, {SEGMENTS} SELECT seq_id, seg_index, start, stop, stop - start AS n_rows FROM g")
def segment_sessions(spark, sf_dir):
    return event_segments(event_samples(spark, sf_dir)).select("seq_id", "seg_index", "start", "stop", "n_rows")


@query(f"WITH {SAMPLES}, {WINDOWS} SELECT seq_id, start, stop FROM w")
def sliding_windows(spark, sf_dir):
    return event_windows(event_samples(spark, sf_dir)).select("seq_id", "start", "stop")


@query(f"WITH {SAMPLES}, n AS (SELECT seq_id, max(row_idx) + 1 AS stop FROM s GROUP BY seq_id) SELECT seq_id, a AS start, a + {WINDOW} AS stop FROM (SELECT seq_id, unnest(generate_series({GUARD}, stop - {GUARD + WINDOW}, {WINDOW})) AS a FROM n)")
def tumbling_windows(spark, sf_dir):
    return event_windows(event_samples(spark, sf_dir), stride=WINDOW).select("seq_id", "start", "stop")


@query(f"WITH {SAMPLES}, {WINDOWS} SELECT n.seq_id, count(w.start) AS n_windows FROM n LEFT JOIN w USING (seq_id) GROUP BY n.seq_id")
def window_counts(spark, sf_dir):
    samples = event_samples(spark, sf_dir)
    whole = samples.groupBy("seq_id").agg(F.lit(0).alias("start"), (F.max("row_idx") + 1).alias("stop"))
    return sequences.window_counts(whole, WINDOW, STRIDE, GUARD).withColumn("n_windows", F.col("n_windows").cast("long"))


def window_rows(spark, sf_dir) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    return sequences.interval_rows(event_windows(samples).select("seq_id", "start", "stop"), samples)


@query(
    f"""WITH {SAMPLES}, {WINDOWS},
m AS (SELECT seq_id, start, stop, sum(v) * 0.1 AS displacement_m, 0.5 * 0.1 * sum(abs(v - (v + yaw))) AS wheelcan,
      abs(arg_max(v, row_idx) - arg_min(v, row_idx)) AS dspeed FROM wr GROUP BY ALL)
SELECT seq_id, start, stop, round(displacement_m, 6) AS displacement_m, round(displacement_m / {WINDOW * 0.1}, 6) AS mean_speed_mps,
  round(greatest(sqrt(wheelcan * wheelcan + pow(0.2 * {WINDOW * 0.1}, 2) + pow(0.3 * dspeed, 2) + pow(2.0 * (1.0 - 0.9), 2)) * CASE seq_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.4 ELSE 1.6 END, 0.05), 6) AS label_sigma_m
FROM m"""
)
def window_label_stats(spark, sf_dir):
    """Displacement labels; usability and sync come from the sequence's number."""
    use = F.element_at(F.array(F.lit("use"), F.lit("weak"), F.lit("other")), (F.col("seq_id") % 3 + 1).cast("int"))
    rows = window_rows(spark, sf_dir).withColumn("can", F.col("v") + F.col("yaw"))
    out = labels.displacement_labels(rows, "v", "can", F.lit(0.2), F.lit(0.9), use)
    return out.select("seq_id", "start", "stop", *[rounded(c).alias(c) for c in ("displacement_m", "mean_speed_mps", "label_sigma_m")])


@query(
    f"""WITH {SAMPLES}, {WINDOWS},
m AS (SELECT seq_id, start, stop, avg(v) AS mean, quantile_cont(abs(yaw) * 30, 0.5) AS acc, abs(arg_max(v, row_idx) - arg_min(v, row_idx)) AS dv, count(DISTINCT round(v, 3)) AS d FROM wr GROUP BY ALL)
SELECT seq_id, start, stop, round(mean, 6) AS mean_speed_mps, round(1.2 + 0.15 * acc + 0.10 * dv + CASE WHEN d <= 1 THEN 1 ELSE 0 END, 6) AS sigma_mps, acc <= 20 AS ok FROM m"""
)
def gnss_window_labels(spark, sf_dir):
    rows = window_rows(spark, sf_dir).withColumn("acc", F.abs("yaw") * 30)
    out = labels.gnss_labels(rows, "v", "acc")
    return out.select("seq_id", "start", "stop", rounded("mean_speed_mps").alias("mean_speed_mps"), rounded("sigma_mps").alias("sigma_mps"), "ok")


@query(
    f"""WITH {SAMPLES}, {WINDOWS},
d AS (SELECT *, yaw - lag(yaw) OVER (PARTITION BY seq_id, start, stop ORDER BY row_idx) AS step FROM wr),
m AS (SELECT seq_id, start, stop, avg(v / 20) AS mean, stddev_pop(step) AS jitter FROM d GROUP BY ALL)
SELECT seq_id, start, stop, CASE WHEN mean < 1.0 THEN 0 WHEN jitter > 0.135 THEN 2 ELSE 1 END AS context, round(jitter, 6) AS jitter FROM m"""
)
def context_window_labels(spark, sf_dir):
    rows = window_rows(spark, sf_dir).withColumn("slow", F.col("v") / 20)
    return labels.context_labels(rows, "slow", "yaw").select("seq_id", "start", "stop", "context", rounded("jitter").alias("jitter"))


@query(f"WITH {SAMPLES} SELECT seq_id, row_idx, CASE WHEN count(v) OVER f = 10 THEN round(stddev_samp(v) OVER f, 6) END AS rolling_std FROM s WINDOW f AS (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)")
def centered_rolling_std(spark, sf_dir):
    return sequences.centred_std(event_samples(spark, sf_dir), "v").select("seq_id", "row_idx", F.round("rolling_std", 6).alias("rolling_std"))


@query(
    f"""WITH {SAMPLES} SELECT seq_id, row_idx, row_idx >= 9 AND var_pop(v / 100) OVER f + var_pop(yaw) OVER f < 0.3 AND var_pop(yaw) OVER f < 0.3 AS is_stationary
FROM s WINDOW f AS (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def stationary_mask(spark, sf_dir):
    samples = event_samples(spark, sf_dir).withColumn("ax", F.col("v") / 100)
    return sequences.stationary(samples, ["ax", "yaw"], ["yaw"], 10, 0.3, 0.3).select("seq_id", "row_idx", "is_stationary")


@query(
    """SELECT event_id, round(value / 3.6, 6) AS mps, round(value * 9.80665, 8) AS mps2, round(radians(value), 6) AS rad, round(sqrt(value * value + 2 * (value / 2) * (value / 2)), 6) AS size,
round(abs(((value * 7 - 350 + 180) % 360 + 360) % 360 - 180), 6) AS gap FROM events"""
)
def unit_convert_project(spark, sf_dir):
    v = F.col("value")
    gap = scalar.angle_gap_deg(v * 7, F.lit(350.0))
    return table(spark, sf_dir, "events").select("event_id", rounded(scalar.g_to_mps2(v), 8).alias("mps2"), *[rounded(c).alias(n) for c, n in ((scalar.kmh_to_mps(v), "mps"), (scalar.deg_to_rad(v), "rad"), (scalar.magnitude(v, v / 2, v / 2), "size"), (gap, "gap"))])


@query(
    """SELECT event_type, max(abs(value)) AS largest, round(quantile_cont(abs(value), 0.995), 6) AS p995, count(*) FILTER (abs(value) >= 200) AS spikes, quantile_cont(abs(value), 0.995) < 200 AS sane FROM events GROUP BY event_type"""
)
def sanity_gate(spark, sf_dir):
    return scalar.gyro_sanity(table(spark, sf_dir, "events"), "value", ["event_type"], 200.0).select("event_type", "largest", rounded("p995").alias("p995"), "spikes", "sane")


@query(
    f"""WITH {SAMPLES},
x AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE v END AS a FROM s),
i AS (SELECT *, coalesce(a, avg(a) OVER (PARTITION BY seq_id)) AS ai FROM x),
m AS (SELECT seq_id, (avg(ai * v) - avg(ai) * avg(v)) / sqrt((avg(ai * ai) - avg(ai) * avg(ai)) * (avg(v * v) - avg(v) * avg(v))) AS c,
  avg((v > 1)::INT) AS mv, avg((abs(yaw) > 0.05)::INT) AS tn FROM i GROUP BY seq_id)
SELECT seq_id, round(c, 6) AS vib_speed_corr, round(mv, 6) AS move_fraction, round(tn, 6) AS turn_fraction,
  CASE WHEN mv < 0.05 THEN 'drop' WHEN c >= 0.35 THEN 'use' WHEN c >= 0.20 THEN 'weak' ELSE 'drop' END AS usability FROM m"""
)
def quality_scores(spark, sf_dir):
    samples = event_samples(spark, sf_dir).withColumn("a", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("v")))
    corr = labels.corr_with_imputation(samples, {"vib_speed_corr": ("a", "v")})
    out = corr.join(labels.fractions(samples, "v", "yaw"), "seq_id")
    kind = labels.usability("vib_speed_corr", F.lit(None).cast("double"), F.lit(None).cast("double"), "move_fraction")
    return out.select("seq_id", *[rounded(c).alias(c) for c in ("vib_speed_corr", "move_fraction", "turn_fraction")], kind.alias("usability"))


@query(
    """WITH g AS (SELECT l_suppkey, sum(l_extendedprice * l_quantity) AS yx, sum(l_quantity * l_quantity) AS xx, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 100)
SELECT l_suppkey, n, round(yx / xx, 4) AS slope, round(sum(yx) OVER () / sum(xx) OVER (), 4) AS slope_all, round(stddev_pop(yx / xx) OVER (), 4) AS spread FROM g"""
)
def origin_regression(spark, sf_dir):
    out = labels.origin_slope(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_suppkey")
    return out.select("l_suppkey", "n", *[F.round(c, 4).alias(c) for c in ("slope", "slope_all", "spread")])


@query("""SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 50 THEN sqrt(avg(pow(l_extendedprice - 1000 * l_quantity, 2))) ELSE 0.2 END, 4) AS speed_rmse FROM lineitem GROUP BY 1""")
def sequence_rmse(spark, sf_dir):
    out = labels.speed_rmse(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") - 1000 * F.col("l_quantity"), "l_suppkey")
    return out.select("l_suppkey", "n", F.round("speed_rmse", 4).alias("speed_rmse"))


@query(
    """WITH m AS (SELECT l_suppkey AS k, count(*) AS n, var_pop(l_quantity) a, var_pop(l_discount) e, var_pop(l_tax) i, covar_pop(l_quantity, l_discount) b, covar_pop(l_quantity, l_tax) c, covar_pop(l_discount, l_tax) f,
 covar_pop(l_extendedprice, l_quantity) p, covar_pop(l_extendedprice, l_discount) q, covar_pop(l_extendedprice, l_tax) r, var_pop(l_extendedprice) y FROM lineitem GROUP BY 1),
d AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM m)
SELECT k AS l_suppkey, n, CASE WHEN n > 200 THEN round((p * (p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) + q * (a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c))
 + r * (a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c))) / det / y, 6) END AS r2 FROM d"""
)
def multi_regression_r2(spark, sf_dir):
    out = labels.regression_r2(table(spark, sf_dir, "lineitem"), "l_extendedprice", ("l_quantity", "l_discount", "l_tax"), "l_suppkey")
    return out.select("l_suppkey", "n", rounded("r2").alias("r2"))


def two_streams(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = event_samples(spark, sf_dir).select("seq_id", "event_id", "event_type", "t_us", "v")
    return tuple(sequences.number_rows(rows.where(F.col("event_type") == kind), "seq_id", ["t_us", "event_id"]).select("seq_id", "row_idx", "event_id", "v") for kind in ("view", "click"))


@query(
    """WITH p AS (SELECT user_id AS seq_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS row_idx FROM events)
SELECT a.seq_id, a.row_idx, a.event_id AS phone_event_id, a.value AS phone_v, b.event_id AS veh_event_id, b.value AS veh_v, a.row_idx * 100 AS t_ms
FROM p a JOIN p b ON a.seq_id = b.seq_id AND a.row_idx = b.row_idx AND a.event_type = 'view' AND b.event_type = 'click'"""
)
def positional_sync_join(spark, sf_dir):
    return sequences.pair_streams(*two_streams(spark, sf_dir))


@query(
    """WITH c AS (SELECT user_id AS seq_id, count(*) FILTER (event_type = 'view') AS n_left, count(*) FILTER (event_type = 'click') AS n_right FROM events GROUP BY 1 HAVING n_left > 0 AND n_right > 0)
SELECT *, least(n_left, n_right) AS n_rows, abs(n_left - n_right) AS dropped, abs(n_left - n_right) > greatest(1, floor(least(n_left, n_right) * 0.01)) AS flagged FROM c"""
)
def sync_report(spark, sf_dir):
    return sequences.pairing_report(*two_streams(spark, sf_dir))


@query(f"WITH {SAMPLES}, {WINDOWS} SELECT seq_id, start, row_idx - start AS i, v FROM wr")
def interval_slice_join(spark, sf_dir):
    return window_rows(spark, sf_dir).select("seq_id", "start", "i", "v")


@query(f"WITH {SAMPLES} SELECT seq_id, row_idx, last_value(CASE WHEN event_type = 'click' THEN v END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS last_v FROM s")
def asof_last_known(spark, sf_dir):
    return sequences.last_known(event_samples(spark, sf_dir), ["v"], F.col("event_type") == "click").select("seq_id", "row_idx", "last_v")


@query(f"WITH {SAMPLES}, {WINDOWS} SELECT w.seq_id, w.start, s.row_idx, s.v FROM w JOIN s ON s.seq_id = w.seq_id AND s.row_idx = greatest(w.start - 1, 0)")
def row_before_outage(spark, sf_dir):
    samples = event_samples(spark, sf_dir)
    return sequences.row_before(event_windows(samples).select("seq_id", "start"), samples).select("seq_id", "start", "row_idx", "v")


@query(
    f"""WITH {SAMPLES}, {WINDOWS},
k AS (SELECT w.seq_id || ':' || w.start AS key, s.v, s.yaw FROM w JOIN s ON s.seq_id = w.seq_id AND s.row_idx >= w.start - 8 AND s.row_idx < w.start)
SELECT key, CASE WHEN count(*) >= 3 THEN round(greatest(least(quantile_cont(yaw * 20, 0.5), 8.0), -8.0), 6) ELSE 0 END AS bias FROM k GROUP BY key"""
)
def lookback_bias(spark, sf_dir):
    samples = event_samples(spark, sf_dir)
    rows = sequences.lookback_rows(event_windows(samples).select("seq_id", "start"), samples, 8)
    rows = rows.withColumn("key", F.concat_ws(":", "seq_id", "at")).withColumn("estimate", F.col("v") + F.col("yaw") * 20)
    return labels.bias_of_windows(rows, "v", "estimate", "key").select("key", rounded("bias").alias("bias"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi_held_out(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(kept, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
def anti_seen(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


def paths(spark, sf_dir) -> DataFrame:
    """key, i, with a predicted and a true position from each user's values and ids."""
    s = event_samples(spark, sf_dir)
    run = W.partitionBy("seq_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    te, tn = F.sum("v").over(run), F.sum(F.col("yaw") * 10).over(run)
    return s.select(F.col("seq_id").alias("key"), F.col("row_idx").alias("i"), te.alias("te"), tn.alias("tn"), (te + F.col("yaw") * 5).alias("pe"), (tn + F.col("v") / 10).alias("pn"))


PATHS = f"""{SAMPLES}, q AS (SELECT seq_id AS key, row_idx AS i, v, yaw, sum(v) OVER u AS te, sum(yaw * 10) OVER u AS tn FROM s WINDOW u AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT key, i, te, tn, te + yaw * 5 AS pe, tn + v / 10 AS pn FROM q)"""
LEGS = """l AS (SELECT key, te AS ae, tn AS an, lead(te) OVER o - te AS be, lead(tn) OVER o - tn AS bn FROM p WINDOW o AS (PARTITION BY key ORDER BY i)),
c AS (SELECT p.key, p.i, min(sqrt(pow(pe - ae - t * be, 2) + pow(pn - an - t * bn, 2))) AS d FROM (
  SELECT p.key, p.i, pe, pn, ae, an, be, bn, least(greatest(((pe - ae) * be + (pn - an) * bn) / CASE WHEN be * be + bn * bn = 0 THEN 1e-9 ELSE be * be + bn * bn END, 0), 1) AS t
  FROM p JOIN l USING (key) WHERE be IS NOT NULL) p GROUP BY ALL)"""


@query(f"WITH {PATHS}, {LEGS} SELECT key, i, round(d, 5) AS cross_track_m FROM c")
def cross_track_min(spark, sf_dir):
    return evaluation.cross_track(paths(spark, sf_dir)).select("key", "i", F.round("cross_track_m", 5).alias("cross_track_m"))


@query(
    f"""WITH {SAMPLES}, g AS (SELECT seq_id AS key, row_idx AS i, 10 + v / 1000 AS lat, 20 + yaw / 10 AS lon FROM s),
o AS (SELECT *, first_value(lat) OVER u AS lat0, first_value(lon) OVER u AS lon0 FROM g WINDOW u AS (PARTITION BY key ORDER BY i))
SELECT key, i, round(radians(lon - lon0) * cos(radians(lat0)) * 6371000.0, 4) AS east_m, round(radians(lat - lat0) * 6371000.0, 4) AS north_m FROM o"""
)
def enu_path(spark, sf_dir):
    points = event_samples(spark, sf_dir).select(F.col("seq_id").alias("key"), F.col("row_idx").alias("i"), (10 + F.col("v") / 1000).alias("lat"), (20 + F.col("yaw") / 10).alias("lon"))
    return navigation.local_enu(points, "lat", "lon").select("key", "i", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"))


@query(f"WITH {PATHS} SELECT key, round(sum(d), 4) AS length_m FROM (SELECT key, coalesce(sqrt(pow(te - lag(te) OVER o, 2) + pow(tn - lag(tn) OVER o, 2)), 0) AS d FROM p WINDOW o AS (PARTITION BY key ORDER BY i)) GROUP BY key")
def path_length(spark, sf_dir):
    return navigation.path_length(paths(spark, sf_dir), "key", "te", "tn").select("key", F.round("length_m", 4).alias("length_m"))


@query(
    f"""WITH {SAMPLES}, h AS (SELECT *, 0.3 + sum(yaw) OVER u * 0.1 AS hdg FROM s WINDOW u AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING))
SELECT seq_id AS key, row_idx + 1 AS i, round(sum(v * sin(hdg) * 0.1) OVER u, 4) AS east_m, round(sum(v * cos(hdg) * 0.1) OVER u, 4) AS north_m FROM h WINDOW u AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT seq_id, 0, 0, 0 FROM s WHERE row_idx = 0"""
)
def dead_reckon_cumsum(spark, sf_dir):
    steps = event_samples(spark, sf_dir).select(F.col("seq_id").alias("key"), F.col("row_idx").alias("i"), "v", "yaw")
    turned = steps.withColumn("hdg", navigation.integrated_heading(F.col("yaw"), F.lit(0.3), 0.1))
    return navigation.dead_reckon(turned, F.col("v"), F.col("hdg"), 0.1).select("key", "i", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"))


STRAPDOWN_SQL = f"""WITH {SAMPLES}, h AS (SELECT *, v / 100 AS ax, yaw AS ay, 0.3 - coalesce(sum(yaw) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.1 AS hdg FROM s),
q AS (SELECT seq_id, row_idx, 10 * sin(0.3) + sum(({{e}}) * 0.1) OVER u AS ve, 10 * cos(0.3) + sum(({{n}}) * 0.1) OVER u AS vn FROM h WINDOW u AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING))
SELECT seq_id AS key, row_idx + 1 AS i, round(sum(ve * 0.1) OVER u, 4) AS east_m, round(sum(vn * 0.1) OVER u, 4) AS north_m FROM q WINDOW u AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)"""


def strapdown_steps(spark, sf_dir) -> DataFrame:
    return event_samples(spark, sf_dir).select(F.col("seq_id").alias("key"), F.col("row_idx").alias("i"), (F.col("v") / 100).alias("ax"), F.col("yaw").alias("ay"), F.col("yaw").alias("gz"), F.lit(10.0).alias("v0"), F.lit(0.3).alias("h0"), F.lit(-1.0).alias("sign"))


@query(STRAPDOWN_SQL.format(e="ax * sin(hdg) - ay * cos(hdg)", n="ax * cos(hdg) + ay * sin(hdg)"))
def strapdown_b2(spark, sf_dir):
    return navigation.strapdown(strapdown_steps(spark, sf_dir), 0.1).select("key", "i", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"))


@query(STRAPDOWN_SQL.format(e="(ax + ay) * sin(hdg)", n="(ax - ay) * cos(hdg)"))
def strapdown_b2_published(spark, sf_dir):
    return navigation.strapdown(strapdown_steps(spark, sf_dir), 0.1, proper=False).select("key", "i", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"))


@query(
    f"""WITH {SAMPLES} SELECT seq_id, row_idx, round(CASE WHEN lag(v) OVER o IS NULL THEN lead(v) OVER o - v WHEN lead(v) OVER o IS NULL THEN v - lag(v) OVER o ELSE (lead(v) OVER o - lag(v) OVER o) / 2 END * 10, 6) AS gradient,
round((yaw - lag(yaw) OVER o) * 9 - 2 * {math.pi} * round_even((yaw - lag(yaw) OVER o) * 9 / (2 * {math.pi}), 0), 6) AS turned FROM s WINDOW o AS (PARTITION BY seq_id ORDER BY row_idx)"""
)
def gradient_unwrap(spark, sf_dir):
    out = sequences.gradient(event_samples(spark, sf_dir), "v", 10.0)
    step = (F.col("yaw") - F.lag("yaw").over(sequences.ordered())) * 9
    return out.select("seq_id", "row_idx", rounded("gradient").alias("gradient"), rounded(scalar.wrapped_rad(step)).alias("turned"))


def event_outages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    samples = event_samples(spark, sf_dir)
    whole = samples.groupBy("seq_id").agg(F.lit(0).alias("seg_index"), F.lit(0).cast("long").alias("start"), (F.max("row_idx") + 1).alias("stop"))
    return samples, evaluation.pick_outages(evaluation.outage_candidates(whole, samples, "v", (10, 20), 1, 3, 2, 2.0))


OUTAGES = f"""{SAMPLES}, n AS (SELECT seq_id, max(row_idx) + 1 AS stop FROM s GROUP BY seq_id),
cand AS (SELECT seq_id, 0 AS seg_index, d AS duration_s, start FROM (SELECT seq_id, d, unnest(generate_series(2, stop - d - 3, 3)) AS start FROM n CROSS JOIN (VALUES (10), (20)) t(d)) JOIN s USING (seq_id) WHERE s.row_idx = start AND s.v >= 2.0),
keyed AS (SELECT *, seq_id || ':' || seg_index || ':' || start || ':' || duration_s AS key FROM cand),
o AS (SELECT seq_id, seg_index, start, start + duration_s AS stop, duration_s, key FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, seg_index, duration_s ORDER BY md5('0' || key), start) AS r FROM keyed) WHERE r <= 2)"""


@query(f"WITH {OUTAGES} SELECT * FROM o")
def outage_grid_sample(spark, sf_dir):
    return event_outages(spark, sf_dir)[1].select("seq_id", "seg_index", "start", "stop", "duration_s", "key")


SCENARIOS = f"""{OUTAGES}, orows AS (SELECT o.key, o.duration_s, s.row_idx - o.start AS i, s.v / 2 AS speed, abs(s.yaw) * 0.5 AS yaw, s.yaw * 2.6 AS acc FROM o JOIN s ON s.seq_id = o.seq_id AND s.row_idx >= o.start AND s.row_idx < o.stop),
z AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM orows),
k AS (SELECT key, any_value(duration_s) AS duration_s, min(speed) AS least, min(acc) AS brake, max(yaw) AS turn, count(*) FILTER (yaw > 0.12) AS turning, avg(speed) FILTER (i < n // 2 // 2 + 1) AS head, avg(speed) FILTER (i >= n - (n // 2 // 2 + 1)) AS tail,
  avg(speed) AS mean, quantile_cont(yaw, 0.95) AS p95 FROM z GROUP BY key),
sc AS (SELECT key, duration_s, CASE WHEN least < 1 THEN 'stop_start' WHEN brake < -2.5 THEN 'hard_braking' WHEN turn > 0.35 THEN 'sharp_cornering' WHEN turning > 3 AND head - least > 3 AND tail - least > 3 THEN 'roundabout' WHEN mean > 22 AND p95 < 0.05 THEN 'motorway_cruise' ELSE 'urban' END AS scenario FROM k)"""


def event_scenarios(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples, outages = event_outages(spark, sf_dir)
    made = samples.withColumn("speed", F.col("v") / 2).withColumn("turn", F.abs("yaw") * 0.5).withColumn("acc", F.col("yaw") * 2.6)
    rows = sequences.interval_rows(outages, made)
    return samples, outages, evaluation.scenario(rows, "speed", "turn", "acc", turning_rows=3)


@query(f"WITH {SCENARIOS} SELECT key, scenario FROM sc")
def scenario_classify(spark, sf_dir):
    return event_scenarios(spark, sf_dir)[2].select("key", "scenario")


SCORES = f"""{PATHS}, {LEGS},
dist AS (SELECT key, sum(d) AS distance_m FROM (SELECT key, sqrt(pow(te - lag(te) OVER x, 2) + pow(tn - lag(tn) OVER x, 2)) AS d FROM p WINDOW x AS (PARTITION BY key ORDER BY i)) GROUP BY key),
fin AS (SELECT key, arg_max(sqrt(pow(pe - te, 2) + pow(pn - tn, 2)), i) AS final_error_m, max(i) AS top FROM p GROUP BY key),
mm AS (SELECT key, avg(pe) mpe, avg(pn) mpn, avg(te) mte, avg(tn) mtn, atan2(avg(pe * tn) - avg(pe) * avg(tn) - (avg(pn * te) - avg(pn) * avg(te)), avg(pe * te) - avg(pe) * avg(te) + avg(pn * tn) - avg(pn) * avg(tn)) AS th FROM p GROUP BY key),
ate AS (SELECT key, sqrt(avg(pow(cos(th) * (pe - mpe) - sin(th) * (pn - mpn) + mte - te, 2) + pow(sin(th) * (pe - mpe) + cos(th) * (pn - mpn) + mtn - tn, 2))) AS ate_m FROM p JOIN mm USING (key) GROUP BY key),
cte AS (SELECT key, avg(d) AS cte_mean_m, max(d) AS cte_max_m FROM c GROUP BY key),
sco AS (SELECT *, 100 * final_error_m / distance_m AS drift_pct FROM dist JOIN fin USING (key) JOIN ate USING (key) JOIN cte USING (key))"""


@query(f"WITH {SCORES} SELECT key, round(distance_m, 3) AS distance_m, round(final_error_m, 3) AS final_error_m, round(drift_pct, 4) AS drift_pct, round(ate_m, 3) AS ate_m, round(cte_mean_m, 3) AS cte_mean_m, round(cte_max_m, 3) AS cte_max_m, (top + 1) // 10 AS n_growth FROM sco")
def outage_scores(spark, sf_dir):
    out = evaluation.score_outages(paths(spark, sf_dir))
    digits = {"distance_m": 3, "final_error_m": 3, "drift_pct": 4, "ate_m": 3, "cte_mean_m": 3, "cte_max_m": 3}
    return out.select("key", *[F.round(c, d).alias(c) for c, d in digits.items()], F.size("error_growth_m").cast("long").alias("n_growth"))


@query(
    f"WITH {SCORES}, k2 AS (SELECT drift_pct, CASE key % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 120 ELSE 180 END AS duration_s, CASE WHEN key % 5 < 2 THEN 'urban' ELSE 'motorway_cruise' END AS scenario FROM sco) SELECT duration_s, scenario, round(median(drift_pct), 4) AS median, round(quantile_cont(drift_pct, 0.95), 4) AS p95, count(*) AS n FROM k2 GROUP BY GROUPING SETS ((duration_s), (scenario))"
)
def aggregate_grouping_sets(spark, sf_dir):
    scores = evaluation.score_outages(paths(spark, sf_dir))
    seconds = F.element_at(F.array(*[F.lit(s) for s in evaluation.OUTAGE_SECONDS]), (F.col("key") % 4 + 1).cast("int"))
    keyed = scores.select("drift_pct", seconds.alias("duration_s"), F.when(F.col("key") % 5 < 2, "urban").otherwise("motorway_cruise").alias("scenario"))
    return evaluation.aggregate_scores(keyed).select("duration_s", "scenario", F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), "n")


@query(f"WITH {SCENARIOS} SELECT sc.key, sc.duration_s, scenario FROM (SELECT *, row_number() OVER (PARTITION BY duration_s ORDER BY turn, size DESC, scenario) AS r FROM (SELECT *, count(*) OVER (PARTITION BY duration_s, scenario) AS size, row_number() OVER (PARTITION BY duration_s, scenario ORDER BY md5('0' || key), key) AS turn FROM sc)) sc WHERE r <= 10")
def golden_pick(spark, sf_dir):
    _, outages, kinds = event_scenarios(spark, sf_dir)
    return evaluation.stratified_pick(outages.join(kinds, "key").select("key", "duration_s", "scenario"), 10)


def embedding_columns(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("label", *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "ref"))])


@query(
    """WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS ref FROM embeddings),
m AS (SELECT label, count(*) AS n, var_pop(x) vx, var_pop(y) vy, covar_pop(x, y) cxy, covar_pop(x, ref) cxr, covar_pop(y, ref) cyr, var_pop(ref) vr FROM e GROUP BY label),
a AS (SELECT *, cos(2 * pi() * k / 72) AS c, sin(2 * pi() * k / 72) AS s FROM m CROSS JOIN (SELECT unnest(range(-36, 36)) AS k)),
z AS (SELECT label, n, k, round((c * cxr + s * cyr) / sqrt((c * c * vx + 2 * c * s * cxy + s * s * vy) * vr), 9) AS sc FROM a)
SELECT label, n, 5.0 * arg_min(k, (-sc, k)) AS yaw_deg, round(max(sc), 6) AS score FROM z GROUP BY label, n"""
)
def yaw_search_moments(spark, sf_dir):
    out = alignment.yaw_search(embedding_columns(spark, sf_dir), "x", "y", "ref", "label", least=2)
    return out.select("label", "n", "yaw_deg", F.round("score", 6).alias("score"))


@query("SELECT channel, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(range(64))::INT AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY channel")
def channel_normaliser(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    return labels.normaliser(rows, "channel", "x").select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    """SELECT c_custkey, CASE WHEN c_name = 'Customer#000000007' THEN 'test' ELSE coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'train' WHEN 'MACHINERY' THEN 'val' END, 'excluded') END AS split FROM customer"""
)
def split_assign(spark, sf_dir):
    out = splits.assign_splits(table(spark, sf_dir, "customer"), {"Customer#000000007": "test"}, {"BUILDING": "train", "MACHINERY": "val"}, "c_name", "c_mktsegment")
    return out.select("c_custkey", "split")


@query(
    """SELECT c_custkey, list_reduce(list_reverse(list_transform(range(1, length(c_name) + 1), lambda i: ord(c_name[i])::BIGINT)), lambda a, b: (a * 256 + b) % 1000) % 1000 < 250 AS held FROM customer"""
)
def holdout_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (scalar.holdout_bucket("c_name") < 250).alias("held"))


@query("SELECT c_nationkey, sha256(string_agg(c_name || ':' || c_mktsegment, '' ORDER BY c_name || ':' || c_mktsegment)) AS digest, count(*) AS n FROM customer GROUP BY 1")
def manifest_sha(spark, sf_dir):
    return splits.manifest_digest(table(spark, sf_dir, "customer"), "c_name", ["c_mktsegment"], ["c_nationkey"])


def predictions(spark, sf_dir) -> DataFrame:
    """Rows with y, mu, logvar and id, from line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 10).alias("y"), (F.col("l_quantity") / 10 + (F.col("l_discount") - 0.05) * 20 * (1 + F.col("l_tax") * 10)).alias("mu"), (F.col("l_tax") * 10 + F.col("l_quantity") / 50).alias("logvar"), "l_returnflag", "l_shipdate")


PREDICTIONS = "t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 10 AS y, l_quantity / 10 + (l_discount - 0.05) * 20 * (1 + l_tax * 10) AS mu, l_tax * 10 + l_quantity / 50 AS logvar, l_returnflag FROM lineitem), u AS (SELECT *, exp(0.5 * logvar) AS sigma FROM t)"
BINS = f"{PREDICTIONS}, ranked AS (SELECT *, row_number() OVER (ORDER BY logvar, id) - 1 AS r, count(*) OVER () AS n FROM u), bins AS (SELECT ((10 * (r + 1) - 1) // n)::INT AS bin, count(*) AS n, sqrt(avg(sigma * sigma)) AS predicted, sqrt(avg((y - mu) * (y - mu))) AS realised FROM ranked GROUP BY 1)"


@query(f"WITH {BINS} SELECT bin, n, round(predicted, 5) AS predicted, round(realised, 5) AS realised FROM bins")
def calibration_bins(spark, sf_dir):
    return evaluation.calibration_bins(predictions(spark, sf_dir)).select("bin", "n", F.round("predicted", 5).alias("predicted"), F.round("realised", 5).alias("realised"))


@query(f"WITH {BINS} SELECT round(sum(n * abs(predicted - realised) / predicted) / sum(n), 6) AS ece_rel, round(sum(n * abs(predicted - realised)) / sum(n), 6) AS ece_abs FROM bins")
def calibration_ece(spark, sf_dir):
    return evaluation.calibration_error(evaluation.calibration_bins(predictions(spark, sf_dir))).select(F.round("ece_rel", 6).alias("ece_rel"), F.round("ece_abs", 6).alias("ece_abs"))


@query(f"WITH {PREDICTIONS}, v AS (SELECT id, (y - mu) / sigma / sqrt(2.0) AS x FROM u), c AS (SELECT id, 0.5 * (1 + {scalar.erf_sql('x')}) AS pit FROM v), r AS (SELECT pit, row_number() OVER (ORDER BY pit, id) AS k, count(*) OVER () AS n FROM c) SELECT round(max(abs(pit - k / n)), 6) AS pit_ks FROM r")
def pit_ks(spark, sf_dir):
    return evaluation.pit_ks(predictions(spark, sf_dir)).select(F.round("pit_ks", 6).alias("pit_ks"))


@query(f"WITH {PREDICTIONS} SELECT k::DOUBLE AS k, round(avg((abs(y - mu) / sigma <= k)::INT), 6) AS covered FROM u CROSS JOIN (VALUES (0.5), (1.0), (1.5), (2.0)) v(k) GROUP BY k")
def coverage(spark, sf_dir):
    return evaluation.coverage(predictions(spark, sf_dir)).select("k", F.round("covered", 6).alias("covered"))


@query(f"WITH {BINS}, tt AS (SELECT 0.3 * exp(i * ln(4.0 / 0.3) / 59) AS t FROM (SELECT unnest(range(60)) AS i)), e AS (SELECT t, sum(n * abs(predicted * t - realised) / (predicted * t)) / sum(n) AS ece FROM bins CROSS JOIN tt GROUP BY t) SELECT round(arg_min(t, (ece, t)), 6) AS temperature, round(min(ece), 6) AS ece_rel FROM e")
def temperature_grid(spark, sf_dir):
    return evaluation.fit_temperature(predictions(spark, sf_dir)).select(F.round("temperature", 6).alias("temperature"), F.round("ece_rel", 6).alias("ece_rel"))


@query(f"WITH {PREDICTIONS} SELECT l_returnflag, count(*) AS n, round(sqrt(avg((mu - y) * (mu - y))), 5) AS rmse, round(avg(mu - y), 5) AS bias, round(avg(y), 5) AS mean_y FROM u GROUP BY GROUPING SETS ((), (l_returnflag))")
def slice_stats(spark, sf_dir):
    out = evaluation.slices(predictions(spark, sf_dir), ["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 5).alias(c) for c in ("rmse", "bias", "mean_y")])


@query("WITH m AS (SELECT *, max(l_quantity) OVER () AS top FROM lineitem) SELECT least(greatest(floor(l_quantity / (top + 1e-6) * 10), 0), 9)::INT AS decile, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM m GROUP BY 1")
def equal_width_deciles(spark, sf_dir):
    rows = labels.weights_by_decile(table(spark, sf_dir, "lineitem"), "l_quantity")
    return rows.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query(
    """WITH m AS (SELECT least(floor(l_extendedprice / (max(l_extendedprice) OVER () + 1e-6) * 10), 9)::INT AS decile FROM lineitem), c AS (SELECT decile, count(*) AS n, 1 / sqrt(count(*)) AS raw FROM m GROUP BY 1)
SELECT decile, n, round(least(greatest(raw / (sum(raw * n) OVER () / sum(n) OVER ()), 0.25), 4.0), 6) AS weight FROM c"""
)
def sample_weights(spark, sf_dir):
    rows = labels.weights_by_decile(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rows.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query(
    f"""WITH RECURSIVE {SAMPLES}, e AS (SELECT seq_id, row_idx, v, v AS y FROM s WHERE row_idx = 0 UNION ALL SELECT s.seq_id, s.row_idx, s.v, 0.8 * e.y + 0.2 * s.v FROM e JOIN s ON s.seq_id = e.seq_id AND s.row_idx = e.row_idx + 1)
SELECT seq_id, row_idx, v, round(y, 6) AS smoothed FROM e"""
)
def ema_lowpass(spark, sf_dir):
    return navigation.low_pass(event_samples(spark, sf_dir), "v").select("seq_id", "row_idx", "v", F.round("smoothed", 6).alias("smoothed"))


@query(
    f"""WITH RECURSIVE {SAMPLES}, z AS (SELECT seq_id AS key, row_idx AS i, v AS mean, yaw AS logvar FROM s),
f AS (SELECT key, -1::BIGINT AS i, 5.0::DOUBLE AS v, 0.0::DOUBLE AS a, 1.0::DOUBLE AS pvv, 0.0::DOUBLE AS pva, 1.0::DOUBLE AS paa FROM (SELECT DISTINCT key FROM z)
 UNION ALL
 SELECT key, i, pv + qvv / (qvv + r) * (mean - pv), a + qva / (qvv + r) * (mean - pv), qvv - qvv * qvv / (qvv + r), qva - qva * qvv / (qvv + r), qaa - qva * qva / (qvv + r)
 FROM (SELECT z.key, z.i, z.mean, exp(z.logvar) + 0.25 AS r, f.a, f.v + 2 * f.a AS pv, f.pvv + 4 * f.pva + 4 * f.paa + 0.36 * 4 AS qvv, f.pva + 2 * f.paa + 0.36 * 4 AS qva, f.paa + 0.36 * 4 AS qaa FROM f JOIN z ON z.key = f.key AND z.i = f.i + 1))
SELECT key, i, round(v, 6) AS speed, round(a, 6) AS accel FROM f WHERE i >= 0"""
)
def window_kf(spark, sf_dir):
    return navigation.window_filter(kf_windows(spark, sf_dir)).select("key", "i", F.round("speed", 6).alias("speed"), F.round("accel", 6).alias("accel"))


def kf_windows(spark, sf_dir) -> DataFrame:
    return event_samples(spark, sf_dir).select(F.col("seq_id").alias("key"), F.col("row_idx").alias("i"), F.col("v").alias("mean"), F.col("yaw").alias("logvar"), F.lit(5.0).alias("v0"))


@query(
    f"""WITH {SAMPLES}, clean AS (SELECT v AS stat FROM s WHERE event_type = 'view'),
qq AS (SELECT DISTINCT unnest(quantile_cont(stat, [{", ".join(str(0.5 + i * (0.999 - 0.5) / 24) for i in range(25))}])) AS threshold FROM clean),
fr AS (SELECT threshold, avg((stat >= threshold)::INT) AS fr FROM clean CROSS JOIN qq GROUP BY threshold),
best AS (SELECT event_type AS family, seq_id % 4 AS param, seq_id AS instance, max(v) AS best FROM s WHERE event_type <> 'view' AND row_idx >= 10 GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, round(fr, 6) AS false_rejection, family, param, round(avg((best >= threshold)::INT), 6) AS detection FROM best CROSS JOIN fr GROUP BY threshold, fr, family, param"""
)
def roc_curve(spark, sf_dir):
    rows = event_samples(spark, sf_dir)
    stats = rows.where("event_type <> 'view'").select(F.col("event_type").alias("family"), (F.col("seq_id") % 4).alias("param"), F.col("seq_id").alias("instance"), (F.col("row_idx") >= 10).alias("reachable"), F.col("v").alias("stat"))
    out = evaluation.roc(stats, rows.where("event_type = 'view'").select(F.col("v").alias("stat")))
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("false_rejection", 6).alias("false_rejection"), "family", "param", F.round("detection", 6).alias("detection"))


@query(f"WITH {OUTAGES} SELECT key, seq_id, start, duration_s FROM o ORDER BY key LIMIT 10")
def top_public_subset(spark, sf_dir):
    """The first 10 of all outages by key."""
    return splits.public_subset(event_outages(spark, sf_dir)[1]).select("key", "seq_id", "start", "duration_s")


@query(f"WITH {SAMPLES}, {SEGMENTS} SELECT seq_id, arg_max(start, (stop - start, -seg_index)) AS start, max(stop - start) AS n_rows FROM g GROUP BY seq_id")
def longest_segment(spark, sf_dir):
    segs = event_segments(event_samples(spark, sf_dir))
    return segs.groupBy("seq_id").agg(F.max_by("start", F.struct(F.col("n_rows"), (-F.col("seg_index")).alias("k"))).alias("start"), F.max("n_rows").alias("n_rows"))


@query("SELECT user_id, event_type FROM events WHERE value > 150 UNION SELECT user_id, event_type FROM events WHERE event_id % 97 = 0")
def set_union_breaks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("value > 150").select("user_id", "event_type").union(e.where("event_id % 97 = 0").select("user_id", "event_type")).distinct()


@query("SELECT user_id, event_type FROM events WHERE value > 100 EXCEPT SELECT user_id, event_type FROM events WHERE value < 20")
def set_except_cols(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("value > 100").select("user_id", "event_type").subtract(e.where("value < 20").select("user_id", "event_type"))


@query("SELECT user_id FROM events WHERE value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value < 5")
def split_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("value > 150").select("user_id").intersect(e.where("event_type = 'error' AND value < 5").select("user_id"))


@query("SELECT event_type AS kind, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1 UNION ALL SELECT 'gnss', count(*), min(epoch_us(ts)), max(epoch_us(ts)) FROM events WHERE event_type = 'view'")
def event_explode_counts(spark, sf_dir):
    """Each row gives an event of its kind, and views a second one, like a sample that carries a fix."""
    rows = table(spark, sf_dir, "events").select("event_type", scalar.epoch_us("ts").alias("t"))
    kinds = F.filter(F.array(F.col("event_type"), F.when(F.col("event_type") == "view", "gnss")), lambda k: k.isNotNull())
    return rows.select("t", F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))


@query(
    f"""WITH {SAMPLES}, d AS (SELECT *, (lead(t_us) OVER (PARTITION BY seq_id ORDER BY row_idx) - t_us) / 1e6 AS dt FROM s)
SELECT seq_id, count(*) AS n_rows, round(sum(CASE WHEN event_type = 'error' THEN dt ELSE 0 END), 3) AS denied_s, round(sum(CASE WHEN event_type = 'error' THEN v ELSE 0 END), 3) AS denied_m, round(sum(v), 3) AS total_m FROM d GROUP BY seq_id"""
)
def trip_card(spark, sf_dir):
    """Seconds and distance without a fix, and in all, for each trip; from the specification, not from code."""
    d = event_samples(spark, sf_dir).withColumn("dt", (F.lead("t_us").over(sequences.ordered()) - F.col("t_us")) / 1e6)
    denied = F.col("event_type") == "error"
    return d.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.when(denied, F.coalesce("dt", F.lit(0.0))).otherwise(0.0)), 3).alias("denied_s"), F.round(F.sum(F.when(denied, F.col("v")).otherwise(0.0)), 3).alias("denied_m"), F.round(F.sum("v"), 3).alias("total_m"))


@query(
    f"""WITH {SAMPLES}, p AS (SELECT event_id, seq_id, (props::JSON->>'k')::BIGINT AS k, v, yaw FROM s)
SELECT event_id, CASE WHEN seq_id % 10 = 0 THEN 'consent' WHEN k % 10 = 0 THEN 'contract_version' WHEN k <= 20 THEN 'duration' WHEN v / ((k - 20) / 10.0) > 100 THEN 'mean_speed' WHEN v > 100 THEN 'accel' WHEN abs(yaw) * 11 * 0.99 > 10 THEN 'gyro' END AS reason FROM p"""
)
def validate_pairs(spark, sf_dir):
    """Uploads of one-row windows made from events."""
    s = event_samples(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    zero = F.lit(0.0)
    pair = F.struct(
        F.array(F.array(F.col("v"), zero, zero, F.col("yaw") * 11, zero, zero)).alias("imu_window"),
        F.col("v").alias("displacement_m"),
        ((F.col("k") - 20) / 10.0).alias("window_duration_s"),
        F.when(F.col("k") % 10 == 0, "2.0").otherwise("1.0").alias("contract_version"),
    )
    uploads = s.select("event_id", (F.col("seq_id") % 10 != 0).alias("consent"), F.array(pair).alias("pairs"))
    return ingest.judged_pairs(uploads).select("event_id", "reason")


@query("WITH RECURSIVE c AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1) SELECT v.k AS event_type, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('refund')) v(k) LEFT JOIN c USING (k)")
def zero_filled_histogram(spark, sf_dir):
    return splits.histogram(table(spark, sf_dir, "events"), "event_type", ["click", "view", "refund"])


@query("SELECT l_linenumber, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, count(l_discount) AS n FROM lineitem GROUP BY 1")
def mean_over_seeds(spark, sf_dir):
    out = evaluation.over_seeds(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_discount")
    return out.select("l_linenumber", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(
    """WITH b AS (SELECT l_linenumber, median(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), c AS (SELECT l_linenumber, median(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 6 GROUP BY 1)
SELECT l_linenumber, round(100 * (b.m - c.m) / b.m, 5) AS improvement_pct, 100 * (b.m - c.m) / b.m < -1.0 AS failed FROM b LEFT JOIN c USING (l_linenumber)"""
)
def regression_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    medians = [li.where(c).groupBy("l_linenumber").agg(F.percentile("l_extendedprice", 0.5).alias("median")) for c in ("l_returnflag = 'N'", "l_returnflag = 'R' and l_linenumber < 6")]
    return evaluation.compare_runs(*medians, "l_linenumber", limit_pct=1.0).select("l_linenumber", F.round("improvement_pct", 5).alias("improvement_pct"), "failed")


@query("SELECT c_custkey, c_nationkey || '.' || (c_custkey % 7) || '.' || (c_custkey % 3) AS version, c_nationkey = 5 AND (c_custkey % 7 > 2 OR (c_custkey % 7 = 2 AND c_custkey % 3 >= 1)) AS compatible FROM customer")
def semver_compatible(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(".", "c_nationkey", F.col("c_custkey") % 7, F.col("c_custkey") % 3).alias("version"))
    return c.withColumn("compatible", scalar.semver_at_least("version", "5.2.1"))


@query(
    f"""WITH {BINS}, pp AS (SELECT * FROM bins WHERE n >= 5) SELECT bin, round(predicted, 5) AS predicted, round((SELECT max(m) FROM (SELECT a.bin AS a, (SELECT min(q) FROM (SELECT b.bin, sum(c.realised * c.n) / sum(c.n) AS q FROM pp b JOIN pp c ON c.bin BETWEEN a.bin AND b.bin WHERE b.bin >= pp.bin AND b.bin >= a.bin GROUP BY b.bin)) AS m FROM pp a WHERE a.bin <= pp.bin)), 5) AS calibrated FROM pp"""
)
def isotonic_calibration(spark, sf_dir):
    """Calibrated deviation at each bin's own prediction; the SQL has the regression in its max-min form."""
    rows = predictions(spark, sf_dir)
    knots = evaluation.isotonic_knots(rows, 10)
    out = evaluation.calibration_bins(rows).withColumn("calibrated", evaluation.interpolated(F.col("predicted"), knots))
    return out.select("bin", F.round("predicted", 5).alias("predicted"), F.round("calibrated", 5).alias("calibrated"))


@query()
def planar_eskf(spark, sf_dir):
    """The planar filter over each user's events; a kernel, tested on analytic tracks."""
    samples = sequences.stationary(event_samples(spark, sf_dir).withColumn("ax", F.col("v") / 1000), ["ax", "yaw"], ["yaw"])
    rows = samples.select(F.col("seq_id").alias("key"), F.col("row_idx").alias("i"), "ax", F.lit(0.0).alias("ay"), F.col("yaw").alias("gz"), "is_stationary", F.lit(10.0).alias("v0"), F.lit(0.0).alias("h0"))
    return filters.planar_filter(rows)


@query()
def engine15(spark, sf_dir):
    """The batch twin of the streaming engine over each user's events."""
    s = event_samples(spark, sf_dir)
    rows = s.select(F.col("seq_id").alias("key"), (F.col("row_idx") * 100_000_000).alias("ns"), (F.col("v") / 1000).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.80665).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), (F.col("yaw") / 100).alias("gz"))
    return filters.inertial_engine(rows)


@query()
def fault_detector(spark, sf_dir):
    """The residual statistic of tracks under injected faults, from the middle of tracks under 20 s on; random draws and a recursion, tested on known tracks."""
    s = paths(spark, sf_dir).select("key", "i", (F.col("te") / 100).alias("te"), (F.col("tn") / 100).alias("tn"))
    attacks = spark.createDataFrame([(f, p, k) for k, (f, p) in enumerate([("step", 40.0), ("drag", 1.0), ("jam", 2.0), ("multipath", 0.5)])], "family string, param double, seed long")
    tracks = filters.inject_attacks(s, attacks, fixes_only=True)
    fixes = tracks.select(F.col("instance").alias("key"), "family", "param", "attacked", (F.col("i") / 10).alias("t"), "east_m", "north_m")
    return filters.fault_statistic(fixes)


#: The events' tracks have 99 rows (9.9 s at 10 Hz) at most, so their faults begin after 3 s and their clocks run four times as slowly: a fix every 0.4 s of track.
ONSET_S, SLOWER = 3.0, 4
ATTACKS = [("step", 40.0), ("step", 400.0), ("drag", 1.0), ("drag", 40.0), ("jam", 2.0), ("multipath", 0.5)]


def attacked_fixes(spark, sf_dir) -> DataFrame:
    """Every user's track under every attack, a row in ``SLOWER`` rows of track a row: (key, family, param, attacked, t, east_m, north_m), valid fixes only."""
    s = paths(spark, sf_dir).select("key", "i", (F.col("te") / 100).alias("te"), (F.col("tn") / 100).alias("tn"))
    order = W.partitionBy("key").orderBy("i")
    after = [F.coalesce(F.lead(c).over(order), F.col(c)) for c in ("te", "tn")]
    rows = s.withColumns({"_e": after[0], "_n": after[1]}).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SLOWER - 1))))
    share = F.col("part") / SLOWER
    finer = rows.select("key", (F.col("i") * SLOWER + F.col("part")).alias("i"), (F.col("te") + share * (F.col("_e") - F.col("te"))).alias("te"), (F.col("tn") + share * (F.col("_n") - F.col("tn"))).alias("tn"))
    few = spark.createDataFrame([(f, p, k) for k, (f, p) in enumerate(ATTACKS)], "family string, param double, seed long")
    tracks = filters.inject_attacks(finer, few, ONSET_S * SLOWER, fixes_only=True)
    return tracks.select(F.col("instance").alias("key"), "family", "param", "attacked", (F.col("i") / 10).alias("t"), "east_m", "north_m")


@query()
def detection_rates(spark, sf_dir):
    """Rates of detection and false rejection by threshold, family and strength; the statistics before the onset are the clean ones."""
    stats = filters.reachable(filters.fault_statistic(attacked_fixes(spark, sf_dir)), ONSET_S * SLOWER)
    stats = stats.select("family", "param", F.col("key").alias("instance"), "reachable", "stat", "t")
    clean = stats.where(~F.isnan("stat") & (F.col("t") < ONSET_S * SLOWER)).select("stat")
    return evaluation.roc(stats, clean)
