"""Registered queries of inference, stateful streams, smoothing, routes, sampling and constraints, each beside its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.kernels import modes
from kinelake.kernels import network as layers
from kinelake.operators import augment, benchmark, constraints, evaluation, features, labels, monitoring, network, remount, reports, routes, sampling, sequences, smoothing, splits
from kinelake.operators.features import FEATURES, feature_windows
from kinelake.plans.model_queries import _FLAT, ALIGNED, MEANS, RECORDS, SIZE, STDS, event_features, event_records, phone_samples
from kinelake.plans.queries import OUTAGES, PATHS, SCENARIOS, event_outages, event_scenarios, paths, query
from kinelake.plans.samples import GAP_MS, SAMPLES, SEGMENTS, WINDOW, WINDOWS, event_samples, event_segments, event_windows, table
from kinelake.session import shared_path
from kinelake.sources import artefacts
from kinelake.streaming import stateful

# Inference: a small network with random weights over the events' windows. The SQL has every layer as a join of values with weights.
HIDDEN = 8
CONTRACT = network.Contract(window_size_samples=SIZE, mean=tuple(MEANS), std=tuple(STDS))
WEIGHTS = layers.random_weights(len(FEATURES), HIDDEN, ("mean", "logvar", "yaw"), seed=7)


def _values(name: str) -> str:
    """A weight as rows: its indices, then its value."""
    w = WEIGHTS[name]
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, at)) + f", {float(v)!r}::DOUBLE)" for at, v in np.ndenumerate(w)) + ") AS w(" + ", ".join(f"i{k}" for k in range(w.ndim)) + ", v)"


def _network_sql() -> str:
    parts = [f"h0 AS (SELECT f.seq_id, f.start, f.t, w.i1 AS c, sum(f.x * w.v) + any_value(b.v) AS x FROM (SELECT seq_id, start, pos // 6 AS t, pos % 6 AS f, x FROM flat) f JOIN {_values('input.weight')} ON w.i0 = f.f JOIN (SELECT * FROM {_values('input.bias')}) b ON b.i0 = w.i1 GROUP BY ALL)"]
    for i, dilation in enumerate(layers.DILATIONS):
        parts.append(f"""y{i} AS (SELECT o.seq_id, o.start, o.t, o.c, coalesce(any_value(s.x), 0) + any_value(b.v) AS x FROM h{i} o LEFT JOIN (
  SELECT h.seq_id, h.start, h.t - (w.i0 - 1) * {dilation} AS t, w.i2 AS c, sum(h.x * w.v) AS x FROM h{i} h JOIN {_values(f'block{i}.weight')} ON w.i1 = h.c GROUP BY ALL) s USING (seq_id, start, t, c)
  JOIN (SELECT * FROM {_values(f'block{i}.bias')}) b ON b.i0 = o.c GROUP BY ALL),
m{i} AS (SELECT seq_id, start, t, avg(x) AS m, var_pop(x) AS s FROM y{i} GROUP BY ALL),
h{i + 1} AS (SELECT y.seq_id, y.start, y.t, y.c, h.x + greatest((y.x - m.m) / sqrt(m.s + {layers.NORM_EPS}) * g.v + o.v, 0) AS x FROM y{i} y JOIN m{i} m USING (seq_id, start, t) JOIN h{i} h USING (seq_id, start, t, c)
  JOIN (SELECT * FROM {_values(f'block{i}.gain')}) g ON g.i0 = y.c JOIN (SELECT * FROM {_values(f'block{i}.offset')}) o ON o.i0 = y.c)""")
    parts.append(f"z AS (SELECT seq_id, start, c, avg(x) AS x FROM h{len(layers.DILATIONS)} GROUP BY ALL)")
    for head in layers.heads_of(WEIGHTS):
        parts.append(f"a_{head} AS (SELECT z.seq_id, z.start, w.i1 AS c, greatest(sum(z.x * w.v) + any_value(b.v), 0) AS x FROM z JOIN {_values(f'{head}.weight0')} ON w.i0 = z.c JOIN (SELECT * FROM {_values(f'{head}.bias0')}) b ON b.i0 = w.i1 GROUP BY ALL)")
        parts.append(f"o_{head} AS (SELECT a.seq_id, a.start, w.i1 AS c, sum(a.x * w.v) + any_value(b.v) AS x FROM a_{head} a JOIN {_values(f'{head}.weight1')} ON w.i0 = a.c JOIN (SELECT * FROM {_values(f'{head}.bias1')}) b ON b.i0 = w.i1 GROUP BY ALL)")
    return ",\n".join(parts)


INPUTS = f"""{ALIGNED}, {WINDOWS},
places AS (SELECT seq_id, start, unnest(range({SIZE})) AS i FROM w),
flat AS (SELECT p.seq_id, p.start, unnest([{_FLAT}]) AS x, i * 6 + unnest(range(6)) AS pos FROM places p LEFT JOIN fe ON fe.seq_id = p.seq_id AND i < {WINDOW} AND fe.row_idx = p.start + i)"""


@query(
    f"""WITH {INPUTS}, {_network_sql()}
SELECT a.seq_id, a.start, round(ln(1 + exp(-abs(a.x))) + greatest(a.x, 0), 5) AS velocity_mean_mps, round(exp(l.x), 5) AS velocity_variance, round(y.x, 5) AS yaw_increment_rad, round(exp(v.x), 5) AS yaw_variance
FROM o_mean a JOIN o_logvar l USING (seq_id, start) JOIN o_yaw y ON y.seq_id = a.seq_id AND y.start = a.start AND y.c = 0 JOIN o_yaw v ON v.seq_id = a.seq_id AND v.start = a.start AND v.c = 1"""
)
def network_inference(spark, sf_dir):
    """A model written to its folder, loaded through its contract, and run over all windows."""
    folder = shared_path(spark, "model")
    network.save_model(spark, network.Model(CONTRACT, WEIGHTS), folder)
    model = network.load_model(spark, folder, size=SIZE)
    windows = event_windows(event_samples(spark, sf_dir)).select("seq_id", "start", "stop")
    rows = sequences.interval_rows(windows, event_features(spark, sf_dir)).withColumn("i", F.col("row_idx") - F.col("start"))
    # The model normalises by its manifest; windows come as they are.
    out = network.infer(feature_windows(rows, ["seq_id", "start"], size=SIZE), model, ["seq_id", "start"])
    return out.where("refused is null").select("seq_id", "start", *[F.round(c, 5).alias(c) for c in ("velocity_mean_mps", "velocity_variance", "yaw_increment_rad", "yaw_variance")])


# A phone's orientation, from its first valid rows, in batch and as a stream.
LEAST = 20
GRAVITY, ACCEL = ["grav_x", "grav_y", "grav_z"], ["acc_x", "acc_y", "acc_z"]


def phone_stream_rows(spark, sf_dir) -> DataFrame:
    """(key, ts, ns, gravity, acceleration, reference): a sample an event; every ninth has no reference."""
    s = event_samples(spark, sf_dir)
    lin = [F.col("v") / 100 + F.col("yaw") / 50, F.col("yaw"), F.col("v") / 300]
    gravity = [F.lit(3.0), F.col("yaw"), F.lit(5.0)]
    reference = F.when(F.col("event_id") % 9 != 0, F.col("v") / 50 - F.col("yaw") / 3)
    return s.select(F.col("seq_id").alias("key"), F.timestamp_micros("t_us").alias("ts"), (F.col("t_us") * 1000).alias("ns"), *[g.alias(n) for g, n in zip(gravity, GRAVITY, strict=True)], *[(g + a).alias(n) for g, a, n in zip(gravity, lin, ACCEL, strict=True)], reference.alias("reference"))


CALIBRATIONS = f"""{SAMPLES},
ph AS (SELECT seq_id, t_us * 1000 AS ns, yaw AS gy, v / 100 + yaw / 50 AS ax, yaw AS ay, v / 300 AS az, CASE WHEN event_id % 9 <> 0 THEN v / 50 - yaw / 3 END AS ref FROM s),
on1 AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY seq_id, ns ORDER BY gy, ax, ay, az, ref NULLS FIRST) = 1),
cn AS (SELECT *, count(ref) OVER o AS n, stddev_pop(ref) OVER o AS sd FROM on1 WINDOW o AS (PARTITION BY seq_id ORDER BY ns ROWS UNBOUNDED PRECEDING)),
op AS (SELECT seq_id, min(ns) AS opened FROM cn WHERE n >= {LEAST} AND sd >= 0.001 GROUP BY seq_id),
us AS (SELECT cn.* FROM cn LEFT JOIN op USING (seq_id) WHERE opened IS NULL OR ns <= opened),
gm AS (SELECT seq_id, 3.0 / size AS x, gy / size AS y, -5.0 / size AS c, gy FROM (SELECT seq_id, avg(gy) AS gy, sqrt(34.0 + pow(avg(gy), 2)) AS size FROM us GROUP BY seq_id)),
rot AS (SELECT seq_id, x AS vy, -y AS vx, c, 1 / (1 + c) AS k FROM gm),
lev AS (SELECT seq_id, ref, (1 - k * vy * vy) * ax + k * vx * vy * ay + vy * az AS lx, k * vx * vy * ax + (1 - k * vx * vx) * ay - vx * az AS ly FROM us JOIN rot USING (seq_id)),
mo AS (SELECT seq_id, count(*) AS n, var_pop(lx) vx, var_pop(ly) vy, covar_pop(lx, ly) cxy, covar_pop(lx, ref) cxr, covar_pop(ly, ref) cyr, var_pop(ref) vr FROM lev WHERE ref IS NOT NULL GROUP BY seq_id),
an AS (SELECT *, cos(2 * pi() * k / 72) AS c, sin(2 * pi() * k / 72) AS d FROM mo CROSS JOIN (SELECT unnest(range(-36, 36)) AS k)),
sc AS (SELECT seq_id, n, vr, k, CASE WHEN (c * c * vx + 2 * c * d * cxy + d * d * vy) * vr > 0 THEN round((c * cxr + d * cyr) / sqrt((c * c * vx + 2 * c * d * cxy + d * d * vy) * vr), 9) ELSE -2 END AS score FROM an),
yw AS (SELECT seq_id, n, CASE WHEN n >= {LEAST} AND sqrt(vr) >= 0.001 THEN 5.0 * arg_min(k, (-score, k)) ELSE 0.0 END AS yaw_deg, CASE WHEN n >= {LEAST} AND sqrt(vr) >= 0.001 THEN max(score) END AS score FROM sc GROUP BY seq_id, n, vr),
la AS (SELECT seq_id, max(ns) AS ns FROM us GROUP BY seq_id)
SELECT seq_id AS key, ns, coalesce(n, 0) AS n, coalesce(yaw_deg, 0.0) AS yaw_deg, round(score, 6) AS score, round(gy, 6) AS gravity_y FROM la LEFT JOIN yw USING (seq_id) JOIN gm USING (seq_id)"""


@query(f"WITH {CALIBRATIONS}")
def calibrations(spark, sf_dir):
    """Levelling and yaw of each user from its first valid rows."""
    out = monitoring.calibrations(phone_stream_rows(spark, sf_dir), ACCEL, GRAVITY, "reference", least=LEAST)
    return out.select("key", "ns", "n", "yaw_deg", F.round("score", 6).alias("score"), F.round(F.col("gravity")[1], 6).alias("gravity_y"))


def streamed(rows: DataFrame, make, name: str) -> DataFrame:
    """What ``make`` gives for the rows as a stream: they are written in two halves by time, each key's half in one file, and read file by file."""
    spark = stateful.with_state_store(rows.sparkSession)
    files, out, checkpoint = (shared_path(spark, f"{name}-{what}") for what in ("files", "out", "checkpoint"))
    middle = rows.select(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    early = F.col("ts").cast("double") <= F.lit(middle or 0.0)
    for half in (early, ~early):
        rows.where(half).repartition("key").write.mode("append").parquet(files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(files)
    stream = make(stream)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {CALIBRATIONS.replace('SELECT seq_id AS key', 'SELECT seq_id AS key', 1)} WHERE score IS NOT NULL")
def calibrator_stream(spark, sf_dir):
    """The same orientations from keyed state in a stream, one for each user that gets a yaw."""
    rows = phone_stream_rows(spark, sf_dir)
    out = streamed(rows, lambda s: stateful.calibrate(s, ACCEL, GRAVITY, "reference", late="3650 days", least=LEAST), "calibrator")
    return out.where("score is not null").select("key", "ns", "n", "yaw_deg", F.round("score", 6).alias("score"), F.round(F.col("gravity")[1], 6).alias("gravity_y"))


# Quality of fixes and modes: an hour of the events counts as a second.
POLICY = modes.Policy(accuracy_m=40.0, sats=5, gate=None, bad_run=2, good_run=3, gap_ms=4_000)


def fixes(spark, sf_dir) -> DataFrame:
    s = event_samples(spark, sf_dir)
    walk = paths(spark, sf_dir).select(F.col("key").alias("seq_id"), F.col("i").alias("row_idx"), "te", "tn")
    both = s.join(walk, ["seq_id", "row_idx"])
    ms = F.floor(F.col("t_us") / 3_600_000)
    return both.select(F.col("seq_id").alias("key"), F.timestamp_millis(ms).alias("ts"), ms.alias("t_ms"), F.col("te").alias("east_m"), F.col("tn").alias("north_m"), F.col("v").alias("accuracy_m"), (F.col("event_id") % 11 + 2).cast("double").alias("sats"))


_STEP = f"""SELECT b.key, b.i, b.t, b.good, b.due, b.pm, CASE b.pm WHEN 0 THEN b.good WHEN 1 THEN CASE WHEN b.good = 1 OR b.r < {POLICY.bad_run} THEN 1 ELSE 2 END WHEN 2 THEN 2 + b.good ELSE CASE WHEN b.good = 0 THEN 2 WHEN b.r >= {POLICY.good_run} THEN 1 ELSE 3 END END AS nm, b.r, CASE WHEN b.good = 1 THEN b.t ELSE b.trusted END AS trusted
  FROM (SELECT f.key, f.i, f.t, f.good, CASE WHEN m.mode IN (1, 3) AND m.trusted + {POLICY.gap_ms} < f.t THEN m.trusted + {POLICY.gap_ms} END AS due, CASE WHEN m.mode IN (1, 3) AND m.trusted + {POLICY.gap_ms} < f.t THEN 2 ELSE m.mode END AS pm, CASE WHEN m.mode IN (1, 3) AND m.trusted + {POLICY.gap_ms} < f.t THEN 0 ELSE m.run END + 1 AS r, m.trusted FROM modes m JOIN fx f ON f.key = m.key AND f.i = m.i + 1) b"""
MODES_SQL = f"""WITH RECURSIVE {PATHS},
fa AS (SELECT seq_id AS key, t_us // 3600000 AS t, v, event_id % 11 + 2 AS sats, te, tn FROM s JOIN (SELECT key, i, te, tn FROM p) w ON w.key = s.seq_id AND w.i = s.row_idx),
fx AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS i, CASE WHEN v <= {POLICY.accuracy_m} AND sats >= {POLICY.sats} THEN 1 ELSE 0 END AS good FROM (SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY te, tn, v, sats) = 1)),
modes AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS t, NULL::INT AS good, NULL::BIGINT AS due, 0 AS pm, 0 AS mode, 0 AS run, NULL::BIGINT AS trusted FROM fx
 UNION ALL
 SELECT key, i, t, good, due, pm, nm, CASE WHEN nm <> pm AND nm <> 3 THEN 0 WHEN pm = 1 THEN CASE WHEN good = 1 THEN 0 ELSE r END WHEN pm = 2 THEN 1 ELSE r END, trusted FROM ({_STEP})),
names AS (SELECT * FROM (VALUES (0, 'WAITING'), (1, 'TRACKING'), (2, 'DEAD_RECKONING'), (3, 'REACQUIRING')) AS n(mode, name)),
said AS (
 SELECT key, t AS t_ms, CASE WHEN good = 1 THEN 'trusted' ELSE 'degraded' END AS quality, name AS mode,
  CASE WHEN m.mode = pm THEN NULL WHEN pm = 0 THEN 'first_fix' WHEN pm = 1 THEN 'fixes_degraded' WHEN pm = 2 THEN 'fix' WHEN m.mode = 1 THEN 'settled' ELSE 'fix_degraded' END AS trigger FROM modes m JOIN names USING (mode) WHERE t IS NOT NULL
 UNION ALL SELECT key, due, 'absent', 'DEAD_RECKONING', 'gap' FROM modes WHERE due IS NOT NULL)"""


@query(f"{MODES_SQL} SELECT * FROM said")
def monitored_fixes(spark, sf_dir):
    """Each fix's quality and the mode after it, and the modes that ended in gaps."""
    return monitoring.monitor_fixes(fixes(spark, sf_dir), POLICY).select("key", "t_ms", "quality", "mode", "trigger")


@query(f"{MODES_SQL} SELECT * FROM said")
def fix_monitor_stream(spark, sf_dir):
    """The same from keyed state with timers; gaps after a user's last fix, which only a clock can tell, are left out as in the batch."""
    rows = fixes(spark, sf_dir)
    out = streamed(rows, lambda s: stateful.monitor(s, POLICY, late="3650 days"), "monitor")
    return out.select("key", "t_ms", "quality", "mode", "trigger")


@query()
def scored_fixes(spark, sf_dir):
    """The residual statistic of every fix beside its quality under the gate; a recursion over vectors, tested against the batch detector."""
    return monitoring.monitor_fixes(fixes(spark, sf_dir), modes.Policy(accuracy_m=200.0, sats=0))


# Smoothing: three rows of seven are without a position.
NOISE, START_VAR, FIX_VAR = 50.0, 1e4, 25.0
RTS_SQL = f"""WITH RECURSIVE {PATHS},
o AS (SELECT key, i, CASE WHEN i % 7 < 4 THEN te END AS e FROM p),
f AS (SELECT key, i, coalesce(e, 0) AS pe, 0.0::DOUBLE AS ve, coalesce(e, 0) AS ape, 0.0::DOUBLE AS ave, {START_VAR}::DOUBLE AS app, 0.0::DOUBLE AS apv, {START_VAR}::DOUBLE AS avv,
   CASE WHEN e IS NULL THEN {START_VAR} ELSE {START_VAR} * {FIX_VAR} / ({START_VAR} + {FIX_VAR}) END::DOUBLE AS cpp, 0.0::DOUBLE AS cpv, {START_VAR}::DOUBLE AS cvv FROM o WHERE i = 0
 UNION ALL
 SELECT key, i, ape + gp * miss, ave + gv * miss, ape, ave, app, apv, avv, (1 - gp) * app, (1 - gp) * apv, avv - gv * apv FROM (
  SELECT *, CASE WHEN e IS NULL THEN 0 ELSE app / (app + {FIX_VAR}) END AS gp, CASE WHEN e IS NULL THEN 0 ELSE apv / (app + {FIX_VAR}) END AS gv, coalesce(e - ape, 0) AS miss FROM (
   SELECT o.key, o.i, o.e, f.pe + f.ve AS ape, f.ve AS ave, f.cpp + 2 * f.cpv + f.cvv + {NOISE} / 3 AS app, f.cpv + f.cvv + {NOISE} / 2 AS apv, f.cvv + {NOISE} AS avv FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1))),
b AS (SELECT key, i, pe, ve, cpp, cpv, cvv, ape, ave, app, apv, avv FROM f QUALIFY i = max(i) OVER (PARTITION BY key)
 UNION ALL
 SELECT key, i, pe + gpp * dp + gpv * dv, ve + gvp * dp + gvv * dv, cpp + gpp * (gpp * spp + gpv * spv) + gpv * (gpp * spv + gpv * svv), cpv + gpp * (gvp * spp + gvv * spv) + gpv * (gvp * spv + gvv * svv), cvv + gvp * (gvp * spp + gvv * spv) + gvv * (gvp * spv + gvv * svv), ape, ave, app, apv, avv FROM (
  SELECT f.*, b.pe - b.ape AS dp, b.ve - b.ave AS dv, b.cpp - b.app AS spp, b.cpv - b.apv AS spv, b.cvv - b.avv AS svv,
   ((f.cpp + f.cpv) * b.avv - f.cpv * b.apv) / (b.app * b.avv - b.apv * b.apv) AS gpp, (f.cpv * b.app - (f.cpp + f.cpv) * b.apv) / (b.app * b.avv - b.apv * b.apv) AS gpv,
   ((f.cpv + f.cvv) * b.avv - f.cvv * b.apv) / (b.app * b.avv - b.apv * b.apv) AS gvp, (f.cvv * b.app - (f.cpv + f.cvv) * b.apv) / (b.app * b.avv - b.apv * b.apv) AS gvv
  FROM b JOIN f ON f.key = b.key AND f.i = b.i - 1))
SELECT b.key, b.i::DOUBLE AS t, round(b.pe, 3) AS east_m, round(b.ve, 3) AS ve_mps, round(b.cpp, 3) AS var_m2, round(f.pe, 3) AS filtered_east_m FROM b JOIN f ON f.key = b.key AND f.i = b.i"""


@query(RTS_SQL)
def smoothed_tracks(spark, sf_dir):
    """Tracks through outages, filtered forward and smoothed backward."""
    seen = F.col("i") % 7 < 4
    rows = paths(spark, sf_dir).select("key", F.col("i").cast("double").alias("t"), F.when(seen, F.col("te")).alias("east_m"), F.when(seen, F.col("tn")).alias("north_m"), F.lit(FIX_VAR).alias("var"))
    out = smoothing.smooth_tracks(rows, NOISE, START_VAR)
    return out.select("key", "t", *[F.round(c, 3).alias(c) for c in ("east_m", "ve_mps", "var_m2", "filtered_east_m")])


STEP_MS, DAY_MS = 3_600_000, 86_400_000


@query(
    f"""WITH {SAMPLES}, r AS (SELECT seq_id, t_us // 1000 AS t, v, yaw FROM s QUALIFY row_number() OVER (PARTITION BY seq_id, t_us // 1000 ORDER BY v, yaw) = 1),
l AS (SELECT *, lead(t) OVER o AS t2, lead(v) OVER o AS v2, lead(yaw) OVER o AS yaw2 FROM r WINDOW o AS (PARTITION BY seq_id ORDER BY t)),
g AS (SELECT *, unnest(generate_series(ceil(t / {STEP_MS})::BIGINT, CASE WHEN t2 IS NULL THEN floor(t / {STEP_MS})::BIGINT ELSE ceil(t2 / {STEP_MS})::BIGINT - 1 END)) * {STEP_MS} AS pos FROM l)
SELECT seq_id, pos AS t_ms, round(CASE WHEN pos = t THEN v WHEN t2 - t <= {GAP_MS} THEN v + (pos - t) / (t2 - t) * (v2 - v) END, 5) AS v, round(CASE WHEN pos = t THEN yaw WHEN t2 - t <= {GAP_MS} THEN yaw + (pos - t) / (t2 - t) * (yaw2 - yaw) END, 5) AS yaw, coalesce(pos = t OR t2 - t <= {GAP_MS}, false) AS filled FROM g"""
)
def resampled(spark, sf_dir):
    """Irregular samples on an hourly grid; gaps of over six hours stay open. Each user's samples are worked a day at a time."""
    rows = event_samples(spark, sf_dir).withColumn("t_ms", F.floor(F.col("t_us") / 1000))
    out = smoothing.resample(rows, "t_ms", ["v", "yaw"], STEP_MS, GAP_MS, by="seq_id", stretch=DAY_MS)
    return out.select("seq_id", "t_ms", F.round("v", 5).alias("v"), F.round("yaw", 5).alias("yaw"), "filled")


@query(
    f"""WITH {SAMPLES}, m AS (SELECT seq_id, row_idx, v, median(v) OVER o AS median, list(v) OVER o AS near FROM s WINDOW o AS (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
d AS (SELECT *, list_aggregate(list_transform(near, lambda x: abs(x - median)), 'median') AS mad FROM m)
SELECT seq_id, row_idx, round(median, 5) AS median, round(mad, 5) AS mad, abs(v - median) > 3.0 * {smoothing.MAD_TO_STD} * mad AS is_spike, round(CASE WHEN abs(v - median) > 3.0 * {smoothing.MAD_TO_STD} * mad THEN median ELSE v END, 5) AS despiked FROM d"""
)
def despiked(spark, sf_dir):
    """Values far off the median around them, replaced by it."""
    out = smoothing.despike(event_samples(spark, sf_dir), "v")
    return out.select("seq_id", "row_idx", F.round("median", 5).alias("median"), F.round("mad", 5).alias("mad"), "is_spike", F.round("despiked", 5).alias("despiked"))


TAPS = smoothing.low_pass_taps(1.0, 10.0, 9)


@query(f"WITH {SAMPLES}, w AS (SELECT unnest({TAPS}) AS w, unnest(range(9)) - 4 AS off) SELECT a.seq_id, a.row_idx, round(sum(b.v * w.w) / sum(w.w), 5) AS v FROM s a CROSS JOIN w JOIN s b ON b.seq_id = a.seq_id AND b.row_idx = a.row_idx + w.off WHERE a.row_idx % 4 = 0 GROUP BY ALL")
def decimated(spark, sf_dir):
    """Every fourth row after a low-pass."""
    return smoothing.decimate(event_samples(spark, sf_dir), "v", 4, TAPS).withColumn("v", F.round("v", 5))


@query(
    f"""WITH {PATHS}, c AS (SELECT DISTINCT key AS seq, floor(round(te, 4) / 250)::BIGINT || ':' || floor(round(tn, 4) / 50)::BIGINT AS cell FROM p), n AS (SELECT seq, count(*) AS n FROM c GROUP BY seq HAVING count(*) >= 3),
pr AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS common FROM c a JOIN c b ON b.cell = a.cell AND a.seq < b.seq GROUP BY ALL)
SELECT seq_a, seq_b, common, round(common / least(x.n, y.n), 6) AS share FROM pr JOIN n x ON x.seq = seq_a JOIN n y ON y.seq = seq_b WHERE common >= ceil(round(0.5 * least(x.n, y.n), 9))"""
)
def repeat_routes(spark, sf_dir):
    """Pairs of users whose tracks go over the same cells."""
    cells = paths(spark, sf_dir).select(F.col("key").alias("seq_id"), F.concat_ws(":", F.floor(F.round("te", 4) / 250), F.floor(F.round("tn", 4) / 50)).alias("cell"))
    return routes.repeat_routes(cells, 0.5, digits=6)


_UNIT = lambda text: f"(('0x' || substring(md5({text}), 1, 12))::BIGINT / {1 << 48}::DOUBLE)"


@query(
    f"""WITH k AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS w, floor({_UNIT("'3:' || o_orderkey")} * {sampling.CELLS}) AS cell FROM orders WHERE o_totalprice > 0),
line AS (SELECT id, sum(w) OVER (ORDER BY cell, id ROWS UNBOUNDED PRECEDING) - w AS x FROM k),
d AS (SELECT draw, {_UNIT("'3:draw:' || draw")} * (SELECT sum(w) FROM k) AS x FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS draw))
SELECT draw, id FROM d ASOF JOIN line ON d.x >= line.x"""
)
def weighted_draws(spark, sf_dir):
    """Orders drawn by their price, with replacement, one draw a customer."""
    return sampling.weighted_draws(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").count(), "o_orderkey", "o_totalprice", seed=3)


@query(
    f"""WITH {SAMPLES}, {SEGMENTS}, rm AS (SELECT seq_id, start, stop - start - 3 AS room, sum(stop - start - 3) OVER (PARTITION BY seq_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS upto, sum(stop - start - 3) OVER (PARTITION BY seq_id) AS total FROM g WHERE stop - start >= 4),
k AS (SELECT *, floor({_UNIT("'5:' || seq_id")} * total) AS pick FROM rm)
SELECT seq_id, (start + pick - (upto - room))::BIGINT AS start, (start + pick - (upto - room) + 4)::BIGINT AS stop FROM k WHERE pick >= upto - room AND pick < upto"""
)
def random_segments(spark, sf_dir):
    return sampling.random_segments(event_segments(event_samples(spark, sf_dir)), 4, seed=5)


TILT = f"""{SAMPLES}, a AS (SELECT seq_id, row_idx, atan2(yaw * 2, 9.0) AS r, atan2(-v / 50, sqrt(yaw * yaw * 4 + 81.0)) AS p, row_number() OVER (PARTITION BY seq_id ORDER BY row_idx) AS n FROM s),
b AS (SELECT *, atan2(sum(CASE WHEN n <= 10 THEN sin(r) END) OVER k, sum(CASE WHEN n <= 10 THEN cos(r) END) OVER k) AS r0, avg(CASE WHEN n <= 10 THEN p END) OVER k AS p0 FROM a WINDOW k AS (PARTITION BY seq_id)),
c AS (SELECT seq_id, row_idx, atan2(sin(r - r0), cos(r - r0)) AS r, p - p0 AS p FROM b),
t AS (SELECT *, sum(r - 0.05) OVER o AS t1, sum(-r - 0.05) OVER o AS t2, sum(p - 0.05) OVER o AS t3, sum(-p - 0.05) OVER o AS t4 FROM c WINDOW o AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, t1 - least(0, min(t1) OVER o) AS s1, t2 - least(0, min(t2) OVER o) AS s2, t3 - least(0, min(t3) OVER o) AS s3, t4 - least(0, min(t4) OVER o) AS s4 FROM t WINDOW o AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING))"""


def tilted(spark, sf_dir) -> DataFrame:
    return event_samples(spark, sf_dir).select("seq_id", "row_idx", (F.col("v") / 50).alias("gx"), (F.col("yaw") * 2).alias("gy"), F.lit(9.0).alias("gz"))


@query(f"WITH {TILT} SELECT seq_id, row_idx, round(r, 6) AS roll_rad, round(p, 6) AS pitch_rad, round(s1, 5) AS roll_up, round(s2, 5) AS roll_down, round(s3, 5) AS pitch_up, round(s4, 5) AS pitch_down FROM u")
def tilt_sums(spark, sf_dir):
    """Two-sided cumulative sums of the tilt."""
    out = remount.tilt_sums(tilted(spark, sf_dir), ["gx", "gy", "gz"], settle=10)
    return out.select("seq_id", "row_idx", F.round("roll_rad", 6).alias("roll_rad"), F.round("pitch_rad", 6).alias("pitch_rad"), *[F.round(s, 5).alias(s) for s in remount.SIDES])


@query(f"WITH {TILT} SELECT seq_id, min(row_idx) AS detected FROM u WHERE greatest(s1, s2, s3, s4) >= 1 GROUP BY seq_id")
def remounts(spark, sf_dir):
    return remount.remounts(tilted(spark, sf_dir), ["gx", "gy", "gz"], settle=10).select("seq_id", "detected")


#: Rules for the driver's tables, some of which their rows break.
RULES: dict[str, tuple[constraints.Constraint, ...]] = {
    "orders": (constraints.Key("orders_key", ("o_orderkey",)), constraints.Check("orders_price", "o_totalprice BETWEEN 2000 AND 400000"), constraints.Reference("orders_customer", ("o_custkey",), "customer", ("c_custkey",))),
    "lineitem": (
        constraints.Key("lineitem_key", ("l_orderkey", "l_linenumber")),
        constraints.Check("lineitem_quantity", "l_quantity < 50"),
        constraints.Check("lineitem_flags", "l_returnflag IN ('A', 'N', 'R') AND l_discount <= 0.09"),
        constraints.Reference("lineitem_supplier", ("l_suppkey",), "busy", ("s_suppkey",)),
    ),
    "customer": (constraints.Key("customer_segment", ("c_mktsegment", "c_nationkey", "c_acctbal")), constraints.Check("customer_balance", "c_acctbal > 0")),
}


@query(
    """WITH busy AS (SELECT * FROM supplier WHERE s_acctbal > 0)
SELECT 'orders' AS table_name, 'orders_key' AS "constraint", o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey IS NULL OR o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'orders_price', o_orderkey::VARCHAR FROM orders WHERE NOT o_totalprice BETWEEN 2000 AND 400000
UNION ALL SELECT 'orders', 'orders_customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lineitem', 'lineitem_key', l_orderkey || ',' || l_linenumber FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) USING (l_orderkey, l_linenumber)
UNION ALL SELECT 'lineitem', 'lineitem_quantity', l_orderkey || ',' || l_linenumber FROM lineitem WHERE NOT l_quantity < 50
UNION ALL SELECT 'lineitem', 'lineitem_flags', l_orderkey || ',' || l_linenumber FROM lineitem WHERE NOT (l_returnflag IN ('A', 'N', 'R') AND l_discount <= 0.09)
UNION ALL SELECT 'lineitem', 'lineitem_supplier', l_orderkey || ',' || l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM busy WHERE s_suppkey = l_suppkey)
UNION ALL SELECT 'customer', 'customer_segment', c_custkey::VARCHAR FROM customer JOIN (SELECT c_mktsegment, c_nationkey, c_acctbal FROM customer GROUP BY 1, 2, 3 HAVING count(*) > 1) USING (c_mktsegment, c_nationkey, c_acctbal)
UNION ALL SELECT 'customer', 'customer_balance', c_custkey::VARCHAR FROM customer WHERE NOT c_acctbal > 0"""
)
def constraint_violations(spark, sf_dir):
    """Rows that break the rules of their tables."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer")} | {"busy": table(spark, sf_dir, "supplier").where("s_acctbal > 0")}
    return constraints.violations(tables, RULES, {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]})


_BETWEEN = lambda name, reach: f"(({_UNIT(f'''concat_ws(':', '9', vec_id || '/1', '{name}')''')} * 2 - 1) * {reach})"
WARP = augment.Strengths(noise=0.0, share=1.0)
_TURNED = {
    (i, j): sql
    for (i, j), sql in {
        (0, 0): "c + x * x * (1 - c)", (0, 1): "x * y * (1 - c) - z * s", (0, 2): "x * z * (1 - c) + y * s",
        (1, 0): "x * y * (1 - c) + z * s", (1, 1): "c + y * y * (1 - c)", (1, 2): "y * z * (1 - c) - x * s",
        (2, 0): "x * z * (1 - c) - y * s", (2, 1): "y * z * (1 - c) + x * s", (2, 2): "c + z * z * (1 - c)",
    }.items()
}
AUGMENT_SQL = f"""WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_BETWEEN('axis', 1.0)} AS z, {_UNIT("concat_ws(':', '9', vec_id || '/1', 'around')")} * {2 * math.pi!r} AS around, {_BETWEEN('angle', math.radians(WARP.turn_deg))} AS angle, 1 + {_BETWEEN('pace', WARP.warp)} AS pace FROM embeddings),
a AS (SELECT *, sqrt(greatest(1 - z * z, 0)) * cos(around) AS x, sqrt(greatest(1 - z * z, 0)) * sin(around) AS y, cos(angle) AS c, sin(angle) AS s FROM k),
r AS (SELECT vec_id, pace, i, e[6 * i + 1] AS e0, e[6 * i + 2] AS e1, e[6 * i + 3] AS e2, e[6 * i + 4] AS e3, e[6 * i + 5] AS e4, e[6 * i + 6] AS e5, {', '.join(f'{sql} AS r{i}{j}' for (i, j), sql in _TURNED.items())} FROM a, range(10) AS t(i)),
y AS (SELECT vec_id, pace, i, {', '.join(f'r{i}0 * e{b} + r{i}1 * e{b + 1} + r{i}2 * e{b + 2} AS y{b + i}' for b in (0, 3) for i in range(3))} FROM r),
d AS (SELECT vec_id, pace, i, {', '.join(f'y{c} * (1 + {_BETWEEN(f"gain{c}", WARP.gain)}) + i / 9 * {_BETWEEN(f"drift{c}", WARP.drift)} * (stddev_pop(y{c}) OVER (PARTITION BY vec_id) + 1e-6) AS y{c}' for c in range(6))} FROM y),
g AS (SELECT vec_id, i, least(i * pace, 9) AS pos FROM d)
SELECT g.vec_id, {', '.join(f'round(sum((g.i + 1) * (l.y{c} + (pos - floor(pos)) * (h.y{c} - l.y{c}))), 4) AS s{c}' for c in range(6))} FROM g JOIN d l ON l.vec_id = g.vec_id AND l.i = floor(pos) JOIN d h ON h.vec_id = g.vec_id AND h.i = least(floor(pos) + 1, 9) GROUP BY g.vec_id"""


@query(AUGMENT_SQL)
def augmented_windows(spark, sf_dir):
    """Each vector's first 60 components as ten rows of six channels: turned, with gains and a drift, read at another pace."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.transform(F.slice("embedding", i * 6 + 1, 6), lambda v: v.cast("double")))
    windows = table(spark, sf_dir, "embeddings").select("vec_id", rows.alias("x"))
    out = augment.augmented(windows, "vec_id", seed=9, strengths=WARP)
    total = lambda c: F.aggregate(F.transform("x", lambda r, i: r[c] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", *[F.round(total(c), 4).alias(f"s{c}") for c in range(6)])


LOSSES = "WITH t AS (SELECT l_returnflag AS g, l_linenumber % 3 AS label, l_extendedprice / 1000 AS y, l_quantity::DOUBLE AS mu, l_discount * 50 AS lv, l_tax AS sigma, [l_quantity / 10, l_discount * 20, l_tax * 30, 7.0, 8.0]::DOUBLE[] AS logits FROM lineitem)"


@query(
    LOSSES
    + """, v AS (SELECT *, greatest(least(greatest(lv, -8), 6), -8) AS l, greatest(exp(least(greatest(lv, -8), 6)) + sigma * sigma, 1e-6) AS var, exp(least(greatest(lv, -8), 6)) AS plain FROM t)
SELECT g AS l_returnflag, round(avg(pow(y - mu, 2)) + 1e-4 * avg(l * l), 4) AS warm_up, round(avg(sqrt(var) * 0.5 * (ln(var) + pow(y - mu, 2) / var)) + 1e-3 * avg(l * l), 4) AS beta_nll,
 round(avg(0.5 * (ln(plain) + pow(y - mu, 2) / plain)) + 1e-3 * avg(l * l), 4) AS yaw, round(avg(CASE WHEN sigma > 0.01 THEN ln(exp(logits[1]) + exp(logits[2]) + exp(logits[3])) - logits[label + 1] END), 5) AS context FROM v GROUP BY g"""
)
def training_losses(spark, sf_dir):
    """The losses of all heads, evaluated."""
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 3).alias("label"), (d("l_extendedprice") / 1000).alias("y"), d("l_quantity").alias("mu"), (d("l_discount") * 50).alias("logvar"), d("l_tax").alias("sigma"), F.array(d("l_quantity") / 10, d("l_discount") * 20, d("l_tax") * 30, F.lit(7.0), F.lit(8.0)).alias("logits"))
    rows = rows.withColumn("sure", F.col("sigma") > 0.01)
    by = ["l_returnflag"]
    parts = [augment.speed_loss(rows, False, by).withColumnRenamed("loss", "warm_up"), augment.speed_loss(rows, True, by, label_sigma="sigma").withColumnRenamed("loss", "beta_nll"), augment.yaw_loss(rows, by).withColumnRenamed("loss", "yaw"), augment.context_loss(rows, by, "sure").withColumnRenamed("loss", "context")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by)
    return out.select("l_returnflag", *[F.round(c, 5 if c == "context" else 4).alias(c) for c in ("warm_up", "beta_nll", "yaw", "context")])


_COV = lambda a, b: f"covar_pop({a}, {b})"
_GYROS, _YAW = ("g1", "g2", "g3"), "y"


def _det(columns: list[list[str]]) -> str:
    a, b, d = columns
    return f"({a[0]} * ({b[1]} * {d[2]} - {b[2]} * {d[1]}) - {b[0]} * ({a[1]} * {d[2]} - {a[2]} * {d[1]}) + {d[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"


_SIDES = [[f"k{min(i, j)}{max(i, j)}" for i in range(3)] for j in range(3)]
_GOAL = [f"k{i}3" for i in range(3)]
_R2 = "(" + " + ".join(f"{_det([_GOAL if j == k else _SIDES[j] for j in range(3)])} * {_GOAL[k]}" for k in range(3)) + f") / {_det(_SIDES)} / k33"
_NAMES = (*_GYROS, _YAW)


@query(
    f"""WITH {SAMPLES}, p AS (SELECT seq_id, row_idx, v AS speed, CASE WHEN event_id % 13 > 0 THEN v + yaw * 8 END AS gps, sqrt(pow(v / 10, 2) + yaw * yaw + 96.2361) AS a, yaw / 10 + (event_id % 5) / 20 AS g1, v / 300 AS g2, (event_id % 17) / 30 AS g3, yaw AS y FROM s),
r AS (SELECT *, CASE WHEN count(*) OVER f = 10 THEN stddev_samp(a) OVER f END AS vib FROM p WINDOW f AS (PARTITION BY seq_id ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
i AS (SELECT *, coalesce(vib, avg(vib) OVER k) AS vi, coalesce(gps, avg(gps) OVER k) AS gi FROM r WINDOW k AS (PARTITION BY seq_id)),
m AS (SELECT seq_id, count(*) AS n, CASE WHEN var_pop(vi) > 1e-12 AND var_pop(speed) > 1e-12 THEN covar_pop(vi, speed) / sqrt(var_pop(vi) * var_pop(speed)) END AS vc, CASE WHEN var_pop(gi) > 1e-12 AND var_pop(speed) > 1e-12 THEN covar_pop(gi, speed) / sqrt(var_pop(gi) * var_pop(speed)) END AS sc,
 avg((speed > 1)::INT) AS mv, avg((abs(y) > 0.05)::INT) AS tn, {', '.join(f'{_COV(_NAMES[i], _NAMES[j])} AS k{i}{j}' for i in range(4) for j in range(i, 4))} FROM i GROUP BY seq_id),
q AS (SELECT *, CASE WHEN n > 20 AND sqrt(k33) > 0.001 THEN {_R2} END AS r2 FROM m)
SELECT seq_id, round(vc, 3) AS vib_speed_corr, round(r2, 3) AS lsq_yaw_r2, round(sc, 3) AS sync_speed_corr, round(mv, 3) AS move_fraction, round(tn, 3) AS turn_fraction,
 CASE WHEN mv < 0.05 OR coalesce(sc, 1) < 0.3 THEN 'drop' WHEN coalesce(vc, 0) >= 0.35 OR coalesce(r2, 0) >= 0.5 THEN 'use' WHEN coalesce(vc, 0) >= 0.2 OR coalesce(r2, 0) >= 0.3 THEN 'weak' ELSE 'drop' END AS usability FROM q"""
)
def sequence_scores(spark, sf_dir):
    """All scores of a sequence and its usability in one operator."""
    s = event_samples(spark, sf_dir)
    rows = s.select("seq_id", "row_idx", F.col("v").alias("speed"), F.when(F.col("event_id") % 13 > 0, F.col("v") + F.col("yaw") * 8).otherwise(float("nan")).alias("gps"), (F.col("v") / 10).alias("ax"), F.col("yaw").alias("ay"), F.lit(9.81).alias("az"), (F.col("yaw") / 10 + (F.col("event_id") % 5) / 20).alias("g1"), (F.col("v") / 300).alias("g2"), ((F.col("event_id") % 17) / 30).alias("g3"), "yaw")
    return labels.score_sequences(rows, ["ax", "ay", "az"], ("g1", "g2", "g3"), "speed", "yaw", "gps", least_rows=20)


@query(
    f"""WITH {SCENARIOS}, ch AS (SELECT key, duration_s, scenario FROM (SELECT *, row_number() OVER (PARTITION BY duration_s ORDER BY turn, size DESC, scenario) AS rr FROM (SELECT sc.key, sc.duration_s, scenario, count(*) OVER (PARTITION BY sc.duration_s, scenario) AS size, row_number() OVER (PARTITION BY sc.duration_s, scenario ORDER BY md5('0' || sc.key), sc.key) AS turn FROM sc)) WHERE rr <= 10),
mo AS (SELECT key, duration_s, scenario FROM sc WHERE key NOT IN (SELECT key FROM ch) ORDER BY md5('0' || key), key LIMIT (SELECT 40 - count(*) FROM ch))
SELECT * FROM ch UNION ALL SELECT * FROM mo"""
)
def golden_pick_topped(spark, sf_dir):
    """Forty outages: a quarter for each of four durations, of which two don't occur, so the rest is topped up."""
    _, outages, kinds = event_scenarios(spark, sf_dir)
    return evaluation.topped_up_pick(outages.join(kinds, "key").select("key", "duration_s", "scenario"), 40)


@query(f"WITH {ALIGNED} SELECT seq_id, any_value(n) AS n, any_value(yaw_deg) AS yaw_deg, round(CASE WHEN any_value(n) >= 3 AND any_value(sqrt(vr)) >= 0.001 THEN max(score) END, 6) AS score FROM sc JOIN yw USING (seq_id) GROUP BY seq_id")
def alignment_fit(spark, sf_dir):
    """The correlation that each sequence's alignment reaches."""
    phone = phone_samples(spark, sf_dir).withColumn("ref", features.speed_gradient(event_samples(spark, sf_dir), "v"))
    out = features.fit_report(phone, [f"acc_{n}" for n in "xyz"], [f"grav_{n}" for n in "xyz"], "ref", least=3)
    return out.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {RECORDS}, lines AS (SELECT split, seq_id || ':' || sha256(seq_id || ':' || n_rows) AS line FROM rec), dg AS (SELECT split, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM lines GROUP BY split),
su AS (SELECT split, count(*) AS n_sequences, round_even(sum(duration_s) / 3600, 2) AS hours, sum(n_windows_train_stride)::BIGINT AS train_windows FROM rec GROUP BY split)
SELECT seq_id, split, n_rows, n_windows_infer_stride, n_sequences, hours, train_windows, digest FROM rec JOIN su USING (split) JOIN dg USING (split)"""
)
def split_manifests(spark, sf_dir):
    """Manifests written as files by split with their summary, and read again."""
    records = event_records(spark, sf_dir)
    files = records.withColumn("sha", F.sha2(F.concat_ws(":", "seq_id", "n_rows").cast("binary"), 256))
    digests = splits.manifest_digest(files, "seq_id", ["sha"], ["split"])
    folder = shared_path(spark, "manifests")
    splits.write_manifests(records, digests, folder)
    rows, summary = splits.read_manifests(spark, folder, records.schema)
    return rows.join(F.broadcast(summary), "split").select("seq_id", "split", "n_rows", "n_windows_infer_stride", "n_sequences", "hours", "train_windows", "digest")


@query(f"WITH {ALIGNED} SELECT seq_id, row_idx, round(accel_x, 4) AS accel_x, round(gyro_z, 4) AS gyro_z FROM fe")
def cached_features(spark, sf_dir):
    """Features kept by a digest of what they are made from; the second reader makes nothing."""
    root = shared_path(spark, "features")
    parts = {"events": sf_dir, "least": 3, "version": 1}
    artefacts.cached(spark, root, parts, lambda: event_features(spark, sf_dir))
    rows = artefacts.cached(spark, root, parts, lambda: spark.range(0).select(F.raise_error(F.lit("made twice"))))
    return rows.select("seq_id", "row_idx", F.round("accel_x", 4).alias("accel_x"), F.round("gyro_z", 4).alias("gyro_z"))


# Routes by their field: embeddings, joined end to end by label, are the stored field of ten ways; every seventeenth, somewhat disturbed, is a trace.
ROUTE_SQL = """WITH e AS (SELECT vec_id, label % 10 AS way, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label % 10 ORDER BY vec_id) - 1 AS place FROM embeddings),
tr AS (SELECT vec_id AS trip_id, way AS way_id, list_transform(x[9:40], lambda v, i: v + 0.02 * sin(i * vec_id)) AS t FROM e WHERE vec_id % 17 = 0),
pi AS (SELECT way AS way_id, place // 8 AS piece, min(place) * 64 AS start, flatten(list(x ORDER BY place)) AS st FROM e GROUP BY ALL),
pl AS (SELECT trip_id, tr.way_id, start + o AS pos, t, st[o + 1:o + 32] AS y FROM tr JOIN pi USING (way_id), LATERAL (SELECT unnest(range(len(st) - 31)) AS o)),
el AS (SELECT trip_id, way_id, pos, unnest(t) AS a, unnest(y) AS b FROM pl),
co AS (SELECT trip_id, way_id, pos, round(covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)), 9) AS score FROM el GROUP BY ALL),
be AS (SELECT trip_id, way_id, arg_min(pos, (-score, pos)) AS pos, max(score) AS score FROM co GROUP BY ALL),
ru AS (SELECT co.trip_id, co.way_id, max(co.score) AS runner_up FROM co JOIN be ON be.trip_id = co.trip_id AND be.way_id = co.way_id AND abs(be.pos - co.pos) >= 20 GROUP BY ALL)
SELECT trip_id, way_id, pos AS metre, round(score, 5) AS score, round(runner_up, 5) AS runner_up, CASE WHEN score - coalesce(runner_up, -1) > 0.05 THEN 'MATCHED' ELSE 'MAG_AMBIGUOUS' END AS verdict FROM be LEFT JOIN ru USING (trip_id, way_id)"""


@query(ROUTE_SQL)
def located_on_route(spark, sf_dir):
    """Traces located along their ways by correlation with the stored field."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 10).alias("way_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    placed = sequences.number_rows(e, "way_id", ["vec_id"])
    piece = placed.groupBy("way_id", F.floor(F.col("row_idx") / 8).alias("piece")).agg((F.min("row_idx") * 64).alias("start"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "x"))), lambda r: r["x"])).alias("field"))
    disturbed = F.transform(F.slice("x", 9, 32), lambda v, i: v + 0.02 * F.sin((i + 1) * F.col("vec_id")))
    traces = e.where("vec_id % 17 = 0").select(F.col("vec_id").alias("trip_id"), "way_id", disturbed.alias("field"))
    out = routes.locate_on_route(traces, piece)
    return out.select("trip_id", "way_id", F.col("at").alias("metre"), F.round("score", 5).alias("score"), F.round("runner_up", 5).alias("runner_up"), "verdict")


# The outage benchmark over the events: positions are the users' paths, headings the paths' directions, turn rates those of the events.
def drives(spark, sf_dir) -> DataFrame:
    p = paths(spark, sf_dir).select(F.col("key").alias("seq_id"), F.col("i").alias("row_idx"), (50 + F.col("tn") / 100_000).alias("lat_deg"), (7 + F.col("te") / 100_000).alias("lon_deg"))
    s = event_samples(spark, sf_dir).select("seq_id", "row_idx", F.col("v").alias("speed_mps"), F.degrees(F.atan2("v", F.col("yaw") * 10)).alias("heading_deg"), (F.col("yaw") * 3).alias("accel_x"), (F.col("v") / 50).alias("accel_y"), F.lit(0.0).alias("accel_z"), F.lit(0.0).alias("gyro_x"), F.lit(0.0).alias("gyro_y"), (F.col("yaw") / 2).alias("gyro_z"))
    return s.join(p, ["seq_id", "row_idx"])


BENCH = f"""{OUTAGES}, q AS (SELECT seq_id, row_idx, v, yaw, sum(v) OVER u AS te, sum(yaw * 10) OVER u AS tn, atan2(v, yaw * 10) AS h FROM s WINDOW u AS (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
w AS (SELECT seq_id, row_idx, v, yaw * 3 AS ax, v / 50 AS ay, yaw / 2 AS gz, h, 50 + tn / 100000 AS lat, 7 + te / 100000 AS lon FROM q),
t AS (SELECT o.key, w.row_idx - o.start AS i, radians(lon - first_value(lon) OVER k) * cos(radians(first_value(lat) OVER k)) * 6371000 AS te, radians(lat - first_value(lat) OVER k) * 6371000 AS tn, h AS th FROM o JOIN w ON w.seq_id = o.seq_id AND w.row_idx BETWEEN o.start AND o.stop WINDOW k AS (PARTITION BY o.key ORDER BY w.row_idx)),
e AS (SELECT o.key, w.v AS v0, w.h AS h0 FROM o JOIN w ON w.seq_id = o.seq_id AND w.row_idx = greatest(o.start - 1, 0)),
bk AS (SELECT o.key, w.gz, (d - 2 * pi() * round_even(d / (2 * pi()), 0)) / 0.1 AS rate FROM (SELECT *, lead(h) OVER (PARTITION BY key ORDER BY row_idx) - h AS d FROM (SELECT o.key, w.* FROM o JOIN w ON w.seq_id = o.seq_id AND w.row_idx < o.start AND w.row_idx >= greatest(o.start - 450, 0))) w JOIN o USING (key)),
sg AS (SELECT key, CASE WHEN count(*) >= 20 AND covar_pop(rate, gz) < 0 AND var_pop(rate) > 1e-12 AND var_pop(gz) > 1e-12 THEN -1 ELSE 1 END AS sign FROM bk WHERE rate IS NOT NULL GROUP BY key),
st AS (SELECT o.key, w.row_idx - o.start AS i, ax, ay, gz, v0, h0, coalesce(sign, 1) AS sign FROM o JOIN w ON w.seq_id = o.seq_id AND w.row_idx >= o.start AND w.row_idx < o.stop JOIN e USING (key) LEFT JOIN sg USING (key)),
hd AS (SELECT *, h0 + sign * 0.1 * coalesce(sum(gz) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hh FROM st),
ve AS (SELECT *, v0 * sin(h0) + sum((ax * sin(hh) - ay * cos(hh)) * 0.1) OVER k AS ve, v0 * cos(h0) + sum((ax * cos(hh) + ay * sin(hh)) * 0.1) OVER k AS vn FROM hd WINDOW k AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT 'hold' AS baseline, key, i + 1 AS i, (i + 1) * 0.1 * v0 * sin(h0) AS pe, (i + 1) * 0.1 * v0 * cos(h0) AS pn FROM st
 UNION ALL SELECT 'strapdown', key, i + 1, sum(ve * 0.1) OVER k, sum(vn * 0.1) OVER k FROM ve WINDOW k AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT b, key, 0, 0.0, 0.0 FROM e, (VALUES ('hold'), ('strapdown')) AS n(b)),
jo AS (SELECT pr.*, te, tn, sqrt(pow(te - lag(te) OVER k, 2) + pow(tn - lag(tn) OVER k, 2)) AS step, sqrt(pow(pe - te, 2) + pow(pn - tn, 2)) AS err FROM pr JOIN t USING (key, i) WINDOW k AS (PARTITION BY baseline, key ORDER BY i))
SELECT baseline, key, round(sum(step), 3) AS distance_m, round(arg_max(err, i), 3) AS final_error_m, round(100 * arg_max(err, i) / sum(step), 3) AS drift_pct FROM jo GROUP BY baseline, key"""


@query(f"WITH {BENCH}")
def outage_benchmark(spark, sf_dir):
    """Held speed and strapdown through sampled outages, scored against the paths."""
    outages = event_outages(spark, sf_dir)[1]
    chosen = {n: benchmark.BASELINES[n] for n in ("hold", "strapdown")}
    out = benchmark.run(outages, drives(spark, sf_dir), chosen)
    return out.select("baseline", "key", *[F.round(c, 3).alias(c) for c in ("distance_m", "final_error_m", "drift_pct")])


@query()
def outage_benchmark_learned(spark, sf_dir):
    """The planar filter and a model of random weights through the same outages; kernels, each tested by itself."""
    outages = event_outages(spark, sf_dir)[1].withColumn("scenario", F.lit("urban"))
    model = network.Model(CONTRACT, WEIGHTS)
    scores = benchmark.run(outages, drives(spark, sf_dir), {"filter": benchmark.BASELINES["filter"], "learned": benchmark.learned(model)})
    return benchmark.summary(scores, outages)
