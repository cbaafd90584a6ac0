"""Registered queries of model inputs, outages, losses and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.nanops import in_order, mean_of
from kinelake.operators import evaluation, features, reports, sequences
from kinelake.plans.queries import OUTAGES, PREDICTIONS, event_outages, predictions, query
from kinelake.plans.samples import GUARD, SAMPLES, SEGMENTS, STRIDE, WINDOW, WINDOWS, event_samples, event_segments, table

SIZE = 7
WEIGHTS = features.stub_weights(SIZE)
MEANS, STDS = [0.5, 0.0, 0.1, 0.0, 0.2, 0.0], [2.0, 1.0, 0.5, 1.0, 1.5, 1.0]


def phone_samples(spark, sf_dir) -> DataFrame:
    """Made-up phone columns: a tilted gravity, and accelerations and turn rates from the events."""
    gravity = {"grav_x": F.lit(3.0), "grav_y": F.col("yaw"), "grav_z": F.lit(5.0)}
    lin = [F.col("v") / 100, F.col("yaw"), F.lit(0.1)]
    accel = {f"acc_{n}": g + a for n, g, a in zip("xyz", gravity.values(), lin, strict=True)}
    gyro = {"gyro_roll": F.col("yaw") / 10, "gyro_pitch": F.col("v") / 1000, "gyro_yaw": F.col("yaw") / 5}
    return event_samples(spark, sf_dir).withColumns(gravity | accel | gyro)


GRADIENT = "CASE WHEN lag(v) OVER o IS NULL THEN lead(v) OVER o - v WHEN lead(v) OVER o IS NULL THEN v - lag(v) OVER o ELSE (lead(v) OVER o - lag(v) OVER o) / 2 END * 10"
ALIGNED = f"""{SAMPLES},
lin AS (SELECT seq_id, row_idx, v / 100 AS ax, yaw AS ay, 0.1::DOUBLE AS az, yaw / 10 AS wx, v / 1000 AS wy, yaw / 5 AS wz, {GRADIENT} AS ref FROM s WINDOW o AS (PARTITION BY seq_id ORDER BY row_idx)),
gm AS (SELECT seq_id, 3.0 / size AS x, gy / size AS y, -5.0 / size AS c FROM (SELECT seq_id, avg(yaw) AS gy, sqrt(34.0 + pow(avg(yaw), 2)) AS size FROM s GROUP BY seq_id)),
rot AS (SELECT seq_id, x AS vy, -y AS vx, c, 1 / (1 + c) AS k FROM gm),
lev AS (SELECT seq_id, row_idx, ref, (1 - k * vy * vy) * ax + k * vx * vy * ay + vy * az AS lx, k * vx * vy * ax + (1 - k * vx * vx) * ay - vx * az AS ly, -vy * ax + vx * ay + c * az AS lz,
  (1 - k * vy * vy) * wx + k * vx * vy * wy + vy * wz AS tx, k * vx * vy * wx + (1 - k * vx * vx) * wy - vx * wz AS ty, -vy * wx + vx * wy + c * wz AS tz FROM lin JOIN rot USING (seq_id)),
mo AS (SELECT seq_id, count(*) AS n, var_pop(lx) vx, var_pop(ly) vy, covar_pop(lx, ly) cxy, covar_pop(lx, ref) cxr, covar_pop(ly, ref) cyr, var_pop(ref) vr FROM lev WHERE ref IS NOT NULL GROUP BY seq_id),
an AS (SELECT *, cos(2 * pi() * k / 72) AS c, sin(2 * pi() * k / 72) AS d FROM mo CROSS JOIN (SELECT unnest(range(-36, 36)) AS k)),
sc AS (SELECT seq_id, n, vr, k, CASE WHEN (c * c * vx + 2 * c * d * cxy + d * d * vy) * vr > 0 THEN round((c * cxr + d * cyr) / sqrt((c * c * vx + 2 * c * d * cxy + d * d * vy) * vr), 9) ELSE -2 END AS score FROM an),
yw AS (SELECT seq_id, CASE WHEN n >= 3 AND sqrt(vr) >= 0.001 THEN 5.0 * arg_min(k, (-score, k)) ELSE 0.0 END AS yaw_deg FROM sc GROUP BY seq_id, n, vr),
fe AS (SELECT seq_id, row_idx, yaw_deg, cos(radians(yaw_deg)) * lx + sin(radians(yaw_deg)) * ly AS accel_x, -sin(radians(yaw_deg)) * lx + cos(radians(yaw_deg)) * ly AS accel_y, lz AS accel_z,
  cos(radians(yaw_deg)) * tx + sin(radians(yaw_deg)) * ty AS gyro_x, -sin(radians(yaw_deg)) * tx + cos(radians(yaw_deg)) * ty AS gyro_y, tz AS gyro_z FROM lev JOIN yw USING (seq_id))"""


def event_features(spark, sf_dir) -> DataFrame:
    phone = phone_samples(spark, sf_dir)
    phone = phone.withColumn("ref", features.speed_gradient(phone, "v"))
    return features.aligned_features(phone, [f"acc_{n}" for n in "xyz"], [f"grav_{n}" for n in "xyz"], ["gyro_roll", "gyro_pitch", "gyro_yaw"], "ref", least=3, keep=("v",))


def listed_windows(spark, sf_dir) -> DataFrame:
    """(seq_id, start, rows, label): the features of each window's rows, and its mean speed."""
    gathered = {"rows": F.collect_list(F.array(*features.FEATURES)), "label": F.avg("v")}
    return sequences.gathered_windows(event_features(spark, sf_dir), gathered, WINDOW, STRIDE, GUARD)


@query(f"WITH {ALIGNED} SELECT seq_id, row_idx, yaw_deg, " + ", ".join(f"round({f}, 4) AS {f}" for f in features.FEATURES) + " FROM fe")
def aligned_features(spark, sf_dir):
    """Features in the vehicle's frame of a phone without a vehicle: the reference is the speed's gradient."""
    return event_features(spark, sf_dir).select("seq_id", "row_idx", "yaw_deg", *[F.round(f, 4).alias(f) for f in features.FEATURES])


_FLAT = ", ".join(f"(coalesce({f}, 0) - {m}) / {s}" for f, m, s in zip(features.FEATURES, MEANS, STDS, strict=True))
MODEL = f"""{ALIGNED}, {WINDOWS},
places AS (SELECT seq_id, start, unnest(range({SIZE})) AS i FROM w),
flat AS (SELECT p.seq_id, p.start, unnest([{_FLAT}]) AS x, i * 6 + unnest(range(6)) AS pos FROM places p LEFT JOIN fe ON fe.seq_id = p.seq_id AND i < {WINDOW} AND fe.row_idx = p.start + i),
model AS (SELECT seq_id, start, sum(x * list_extract({WEIGHTS[0]}, pos + 1)) + {WEIGHTS[2]} AS mu, sum(x * list_extract({WEIGHTS[1]}, pos + 1)) + {WEIGHTS[3]} AS logvar FROM flat GROUP BY ALL),
lb AS (SELECT seq_id, start, avg(v) AS label FROM wr GROUP BY ALL)"""


@query(f"WITH {MODEL} SELECT seq_id, start, {WINDOW} AS n_rows, round(mu, 4) AS mu, round(logvar, 4) AS logvar, round(label, 4) AS label FROM model JOIN lb USING (seq_id, start)")
def model_windows(spark, sf_dir):
    """Windows of features, padded and normalised, a linear model's output, and their labels."""
    listed = listed_windows(spark, sf_dir)
    inputs = features.model_inputs(listed, ["seq_id", "start", "label"], MEANS, STDS, SIZE)
    out = features.linear_model(inputs, WEIGHTS)
    return out.select("seq_id", "start", "n_rows", *[F.round(c, 4).alias(c) for c in ("mu", "logvar", "label")])


@query(f"WITH {ALIGNED}, {WINDOWS}, r AS (SELECT w.seq_id, w.start, count(*) AS n, bool_and(isfinite(accel_x) AND accel_x > -1) AS ok FROM w JOIN fe ON fe.seq_id = w.seq_id AND fe.row_idx >= w.start AND fe.row_idx < w.stop GROUP BY ALL) SELECT seq_id, start FROM r WHERE n = {WINDOW} AND ok")
def usable_model_windows(spark, sf_dir):
    """Full, finite windows whose label is good, here those that never brake hard."""
    inputs = features.model_inputs(listed_windows(spark, sf_dir), ["seq_id", "start"], size=WINDOW)
    marked = inputs.withColumn("ok", ~F.exists("x", lambda r: r[0] <= -1))
    return features.usable_windows(marked, WINDOW, "ok").select("seq_id", "start")


TRACK = f"""{OUTAGES},
ow AS (SELECT o.key, (s.row_idx - o.start) // {WINDOW} AS i, avg(s.v) AS z, avg(s.yaw) AS logvar, count(*) AS n FROM o JOIN s ON s.seq_id = o.seq_id AND s.row_idx >= o.start AND s.row_idx < o.stop GROUP BY ALL),
first AS (SELECT o.key, s.v / 10 AS v0, s.yaw AS h0 FROM o JOIN s ON s.seq_id = o.seq_id AND s.row_idx = o.start - 1),
chk AS (SELECT key, i, n, v0, h0, logvar, coalesce(last_value(CASE WHEN z BETWEEN 0 AND 100 THEN z END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING), v0) AS mean, NOT z BETWEEN 0 AND 100 AS rejected FROM ow JOIN first USING (key)),
f AS (SELECT key, -1::BIGINT AS i, v0::DOUBLE AS v, 0.0::DOUBLE AS a, 1.0::DOUBLE AS pvv, 0.0::DOUBLE AS pva, 1.0::DOUBLE AS paa FROM first
 UNION ALL
 SELECT key, i, pv + qvv / (qvv + r) * (mean - pv), a + qva / (qvv + r) * (mean - pv), qvv - qvv * qvv / (qvv + r), qva - qva * qvv / (qvv + r), qaa - qva * qva / (qvv + r)
 FROM (SELECT c.key, c.i, c.mean, exp(c.logvar) + 0.25 AS r, f.a, f.v + 0.5 * f.a AS pv, f.pvv + 2 * 0.5 * f.pva + 0.25 * f.paa + 0.36 * 0.0625 / 4 AS qvv, f.pva + 0.5 * f.paa + 0.36 * 0.125 / 2 AS qva, f.paa + 0.36 * 0.25 AS qaa FROM f JOIN chk c ON c.key = f.key AND c.i = f.i + 1)),
est AS (SELECT key, c.i, n, h0, greatest(f.v, 0) AS speed, coalesce(lag(greatest(f.v, 0)) OVER (PARTITION BY key ORDER BY c.i), v0) AS before FROM chk c JOIN f USING (key, i)),
prof AS (SELECT key, h0, i * {WINDOW} + pos AS row, before + CASE WHEN n > 1 THEN pos / (n - 1) ELSE 0 END * (speed - before) AS speed FROM (SELECT *, unnest(range(n)) AS pos FROM est)),
hd AS (SELECT p.key, p.row, p.speed, p.h0 + 0.1 * sum(s.yaw) OVER (PARTITION BY p.key ORDER BY p.row ROWS UNBOUNDED PRECEDING) AS heading FROM prof p JOIN o USING (key) JOIN s ON s.seq_id = o.seq_id AND s.row_idx = o.start + p.row)"""


@query(f"WITH RECURSIVE {TRACK} SELECT key, row, round(sum(speed * sin(heading) * 0.1) OVER q, 4) AS east_m, round(sum(speed * cos(heading) * 0.1) OVER q, 4) AS north_m, round(heading, 5) AS heading_rad FROM hd WINDOW q AS (PARTITION BY key ORDER BY row ROWS UNBOUNDED PRECEDING)")
def outage_track(spark, sf_dir):
    """Tracks through outages from window speeds: rejection, filter, profile and heading."""
    windows, turns = outage_inputs(spark, sf_dir)
    out = features.outage_track(windows, turns, size=WINDOW)
    return out.select("key", "row", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"), F.round("heading_rad", 5).alias("heading_rad"))


@query(f"WITH RECURSIVE {TRACK} SELECT key, count(*) FILTER (rejected) AS rejected, round(max(mean), 4) AS most FROM chk GROUP BY key")
def plausible_speeds(spark, sf_dir):
    out = features.plausible_speeds(outage_inputs(spark, sf_dir)[0])
    return out.groupBy("key").agg(F.count_if("rejected").alias("rejected"), F.round(F.max("mean"), 4).alias("most"))


def outage_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    samples, outages = event_outages(spark, sf_dir)
    last = outages.join(samples.select("seq_id", (F.col("row_idx") + 1).alias("start"), (F.col("v") / 10).alias("v0"), F.col("yaw").alias("h0")), ["seq_id", "start"]).select("key", "v0", "h0")
    rows = sequences.interval_rows(outages, samples).join(last, "key").withColumn("row", F.col("row_idx") - F.col("start"))
    windows = rows.withColumn("i", F.floor(F.col("row") / WINDOW)).groupBy("key", "i", "v0").agg(in_order("row", "v").alias("z"), in_order("row", "yaw").alias("logvar"), F.count(F.lit(1)).alias("n"))
    windows = windows.withColumns({"z": mean_of(F.col("z")), "logvar": mean_of(F.col("logvar"))})
    return windows, rows.select("key", "row", F.col("yaw").alias("yaw_rate"), "h0")


@query("SELECT vec_id, round(list_sum(list_transform(range(10), lambda i: (i + 1) * (list_extract(e, lo(i)) + (at(i) - floor(at(i))) * (list_extract(e, least(lo(i) + 1, 10)) - list_extract(e, lo(i)))))), 4) AS checksum FROM x".replace("at(i)", "least(i * 1.05, 9)").replace("lo(i)", "(floor(least(i * 1.05, 9))::INT + 1)").join(["WITH x AS (SELECT vec_id, embedding[1:10]::DOUBLE[] AS e FROM embeddings) ", ""]))
def time_warp(spark, sf_dir):
    x = F.transform(F.slice("embedding", 1, 10), lambda v: F.array(v.cast("double")))
    warped = table(spark, sf_dir, "embeddings").withColumn("y", features.time_warp(x, F.lit(1.05)))
    total = F.aggregate(F.transform("y", lambda r, i: r[0] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return warped.select("vec_id", F.round(total, 4).alias("checksum"))


@query(f"WITH {PREDICTIONS}, c AS (SELECT *, exp(least(greatest(logvar, -8), 6)) AS var FROM t) SELECT l_returnflag, round(avg(0.5 * (ln(var + 0.01) + pow(y - mu, 2) / (var + 0.01))), 6) AS nll, round(sqrt(sum(y * pow(mu - y, 2)) / sum(y)), 6) AS rmse, round(sum(y * (mu - y)) / sum(y), 6) AS bias, round(avg(sqrt(var)), 6) AS pred_sigma_mean FROM c GROUP BY 1")
def speed_losses(spark, sf_dir):
    out = evaluation.speed_losses(predictions(spark, sf_dir).withColumn("ls", F.lit(0.1)), "ls", "y", ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("nll", "rmse", "bias", "pred_sigma_mean")])


@query(f"WITH {PREDICTIONS} SELECT round(sqrt(avg(greatest(pow(y - mu, 2) - 0.01, 0) / exp(logvar))), 6) AS temperature FROM t")
def nll_temperature(spark, sf_dir):
    return evaluation.nll_temperature(predictions(spark, sf_dir).withColumn("ls", F.lit(0.1)), "ls").select(F.round("temperature", 6).alias("temperature"))


@query("SELECT dims, count(*) FILTER (d <= [3.841, 5.991, 7.815, 9.488, 11.07, 12.592][dims]) AS at_95, count(*) FILTER (d <= [6.635, 9.21, 11.345, 13.277, 15.086, 16.812][dims]) AS at_99 FROM (SELECT l_linenumber % 6 + 1 AS dims, l_quantity / 3 AS d FROM lineitem) GROUP BY dims")
def chi_square_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 6 + 1).alias("dims"), (F.col("l_quantity") / 3).alias("d"))
    return rows.groupBy("dims").agg(*[F.count_if(evaluation.chi_square_gate(F.col("d"), F.col("dims"), c)).alias(f"at_{c}") for c in (95, 99)])


RECORDS = f"""{SAMPLES}, {SEGMENTS},
q AS (SELECT seq_id, CASE seq_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CASE WHEN seq_id % 5 < 3 THEN 'use' ELSE 'weak' END AS usability, 'F' || (seq_id % 7) AS route_family, count(*) AS n_rows FROM s GROUP BY seq_id),
room AS (SELECT seq_id, count(*) AS n_segments, sum(CASE WHEN stop - start >= 4 THEN (stop - start - 4) // 1 + 1 ELSE 0 END)::BIGINT AS short, sum(CASE WHEN stop - start >= 4 THEN (stop - start - 4) // 2 + 1 ELSE 0 END)::BIGINT AS long FROM g GROUP BY seq_id),
rec AS (SELECT q.*, round_even(n_rows / 10, 1) AS duration_s, n_segments, short AS n_windows_train_stride, long AS n_windows_infer_stride FROM q JOIN room USING (seq_id))"""


def event_records(spark, sf_dir) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    rest = F.col("seq_id") % 3
    rows = samples.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_rows"))
    named = rows.select("seq_id", F.when(rest == 0, "train").when(rest == 1, "val").otherwise("test").alias("split"), F.when(F.col("seq_id") % 5 < 3, "use").otherwise("weak").alias("usability"), F.concat(F.lit("F"), F.col("seq_id") % 7).alias("route_family"), "n_rows")
    return reports.split_records(named, event_segments(samples), size=2, guard=1, strides=(1, 2))


@query(f"WITH {RECORDS} SELECT * FROM rec")
def split_records(spark, sf_dir):
    return event_records(spark, sf_dir)


@query(f"WITH {RECORDS} SELECT split, count(*) AS n_sequences, round_even(sum(duration_s) / 3600, 2) AS hours, round_even(coalesce(sum(duration_s) FILTER (usability = 'use'), 0) / 3600, 2) AS hours_use, sum(n_windows_train_stride)::BIGINT AS train_windows FROM rec GROUP BY split")
def split_counts(spark, sf_dir):
    return reports.split_counts(event_records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT split, array_to_string(list_sort(list(DISTINCT route_family)), ' + ') AS families FROM rec GROUP BY split")
def family_summary(spark, sf_dir):
    return reports.family_summary(event_records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT seq_id FROM rec WHERE n_rows > 65")
def bench_sequences(spark, sf_dir):
    return reports.bench_sequences(event_records(spark, sf_dir), 65).select("seq_id")


@query("SELECT c_nationkey, arg_min(c_name, (c_acctbal, c_name)) AS checkpoint, min(c_acctbal) AS rmse FROM customer GROUP BY 1")
def best_checkpoint(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("checkpoint"), F.col("c_acctbal").alias("rmse"))
    return reports.best_checkpoint(runs, ["c_nationkey"])


@query("SELECT n_nationkey AS row, n_name AS title, value, CASE WHEN value IS NOT NULL THEN 'done' WHEN n_regionkey = 1 THEN 'external' ELSE 'pending' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, round(avg(s_acctbal), 4) AS value FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) ON s_nationkey = n_nationkey")
def ablation_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("title"), (F.col("n_regionkey") == 1).alias("external"))
    results = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("row")).agg(F.round(F.avg("s_acctbal"), 4).alias("value"))
    return reports.ablation_table(rows, results)


@query(f"WITH {OUTAGES}, r AS (SELECT o.key, s.row_idx AS i, 10 + v / 1000 AS lat, 20 + yaw / 10 AS lon, sqrt(pow(v - lag(v) OVER k, 2) + pow(yaw - lag(yaw) OVER k, 2)) AS step FROM o JOIN s ON s.seq_id = o.seq_id AND s.row_idx >= o.start AND s.row_idx < o.stop WINDOW k AS (PARTITION BY o.key ORDER BY s.row_idx)) SELECT key, round_even(sum(step), 2) AS distance_m, round_even(arg_min(lat, i), 6) AS start_lat, round_even(arg_min(lon, i), 6) AS start_lon FROM r GROUP BY key")
def golden_records(spark, sf_dir):
    samples, outages = event_outages(spark, sf_dir)
    made = samples.select("seq_id", "row_idx", (10 + F.col("v") / 1000).alias("lat"), (20 + F.col("yaw") / 10).alias("lon"), F.col("v").alias("te"), F.col("yaw").alias("tn"))
    rows = sequences.interval_rows(outages, made).withColumn("i", F.col("row_idx") - F.col("start"))
    return reports.golden_records(outages, rows)


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('0' || c_custkey), c_custkey) <= greatest(count(*) OVER (PARTITION BY c_nationkey) // 6, 2) AS is_val FROM customer")
def validation_split(spark, sf_dir):
    return reports.validation_split(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", ["c_nationkey"])


@query(f"WITH {OUTAGES} SELECT key AS outageKey, seq_id AS seqId, duration_s AS durationS FROM o")
def wire_names(spark, sf_dir):
    rows = event_outages(spark, sf_dir)[1].select(F.col("key").alias("outage_key"), "seq_id", "duration_s")
    return reports.wire_names(rows)
