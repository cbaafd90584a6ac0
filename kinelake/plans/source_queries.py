"""Registered queries over files: the events written as replay files to the shared folder and read again, beside SQL over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake import schema
from kinelake.operators import sequences, splits
from kinelake.plans.queries import query
from kinelake.plans.samples import SAMPLES, event_samples, table
from kinelake.session import shared_path
from kinelake.sources import recordings, replay

YAW = "((event_id * 37) % 200 - 100) / 100.0::DOUBLE"


def replay_rows(spark, sf_dir) -> DataFrame:
    """Events in the replay contract's columns, a millisecond apart by their ids; views carry a fix."""
    yaw = ((F.col("event_id") * 37) % 200 - 100) / 100.0
    view = F.col("event_type") == "view"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("timestamp_ms"),
        (F.col("value") / 100).alias("accel_x"),
        *[F.lit(v).alias(c) for c, v in (("accel_y", 0.0), ("accel_z", 9.81))],
        yaw.alias("gyro_x"),
        *[F.lit(v).alias(c) for c, v in (("gyro_y", 0.0), ("gyro_z", 0.01), ("mag_x", 20.0), ("mag_y", 5.0), ("mag_z", -40.0))],
        view.cast("int").alias("gnss_valid"),
        F.when(view, F.col("value") / 10).alias("gnss_lat"),
        *[F.when(view, v).alias(c) for c, v in (("gnss_lon", -1.5), ("gnss_speed_mps", 10.0), ("gnss_course_deg", 45.0))],
    )


def written(rows: DataFrame, name: str) -> str:
    """The folder of replay files, each a range of times in order."""
    path = shared_path(rows.sparkSession, name)
    replay.write(rows.repartitionByRange("timestamp_ms").sortWithinPartitions("timestamp_ms"), path)
    return path


_KINDS = {"accelerometer": "value / 100", "gyroscope": YAW, "magnetometer": "20.0", "gnss_fix": "value / 10"}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n, min(event_id) * 1000000 AS first_ns, max(event_id) * 1000000 AS last_ns, round(sum({first}), 4)::DOUBLE AS total FROM events" + " WHERE event_type = 'view'" * (kind == "gnss_fix") + " HAVING count(*) > 0" for kind, first in _KINDS.items()))
def replay_events(spark, sf_dir):
    """Replay files written, loaded by the lenient rules and taken apart into sensor events."""
    found = replay.events(replay.load(spark, written(replay_rows(spark, sf_dir), "replay"), "lenient"))
    totals = found.groupBy("kind").agg(F.round(F.sum(F.get("values", F.lit(0))), 4).alias("total"))
    return replay.event_counts(found).join(totals, "kind")


@query(
    f"""WITH e AS (SELECT abs({YAW}) * 20 AS spin, event_type = 'view' AS fix, event_type = 'click' AS click, value AS lat FROM events),
v AS (
  SELECT 'lenient' AS mode, 'rotation' AS rule FROM e WHERE spin > 10 UNION ALL SELECT 'strict', 'rotation' FROM e WHERE spin >= 10
  UNION ALL SELECT m, 'fix_without_valid' FROM e, (VALUES ('lenient'), ('strict')) AS t(m) WHERE NOT fix AND NOT click
  UNION ALL SELECT m, 'gnss_valid' FROM e, (VALUES ('lenient'), ('strict')) AS t(m) WHERE click
  UNION ALL SELECT 'strict', 'gnss_lat_range' FROM e WHERE lat > 90)
SELECT mode, rule, count(*) AS n FROM v GROUP BY ALL"""
)
def replay_violations(spark, sf_dir):
    """Files with fast turns, a third state of validity, positions in rows without a valid fix, and latitudes out of range, by both rule sets."""
    click = F.col("event_type") == "click"
    rows = replay_rows(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("timestamp_ms"), "event_type", "value"), "timestamp_ms")
    rows = rows.withColumns({"gyro_x": F.col("gyro_x") * 20, "gnss_valid": F.when(click, 2).otherwise(F.col("gnss_valid")), "gnss_lat": F.col("value")} | {c: F.lit(1.0) for c in ("gnss_lon", "gnss_speed_mps", "gnss_course_deg")})
    lines = replay.read_lines(spark, written(rows, "violations"))
    both = [replay.violations(lines, mode).select(F.lit(mode).alias("mode"), "rule") for mode in ("lenient", "strict")]
    return both[0].unionByName(both[1]).groupBy("mode", "rule").agg(F.count(F.lit(1)).alias("n"))


# Recordings: users by their ids in ten drives, each a phone's and a vehicle's file; the vehicle's are shorter by every drive's last ten rows, and drive 7 turns in degrees.
DRIVES, SHORT = 10, 10


def drive_rows(spark, sf_dir) -> DataFrame:
    """(drive, n, row, and the events' values): rows of all users of a drive, one after the other."""
    s = event_samples(spark, sf_dir).withColumn("drive", F.col("seq_id") % DRIVES)
    numbered = sequences.number_rows(s.drop("row_idx"), "drive", ["seq_id", "t_us", "event_id"])
    return numbered.withColumnRenamed("row_idx", "row").join(s.groupBy("drive").agg(F.count(F.lit(1)).alias("n")), "drive")


def written_recordings(spark, sf_dir) -> str:
    """The folder of the files ``drive-N/S-driveN.csv`` and ``V-driveN.csv``; one more has a phone file of a wrong width."""
    rows = drive_rows(spark, sf_dir)
    yaw = F.col("yaw") * F.when(F.col("drive") == 7, 57.3).otherwise(1.0)
    phone = {"gps_speed_mps": F.col("v"), "gps_sats": F.concat(F.col("event_id") % 9 + 4, F.lit(" / 18")), "time_since_start_ms": F.col("row") * 100, "date_local_raw": F.lit("2024-01-01"), "accel_x_mps2": F.col("v") / 100, "gravity_z_mps2": F.lit(9.81), "gyro_yaw_radps": yaw, "gyro_pitch_radps": F.when(F.col("event_id") % 5 > 0, yaw / 2)}
    vehicle = {"speed_mps": F.col("v") + 1, "long_accel_mps2": F.col("v") / 500, "yaw_rate_radps": F.col("yaw") * 57.3, **{c: F.col("v") / 10 for c in recordings.WHEELS}}
    lines = []
    for kind, columns, known, kept in (("S", schema.PHONE_COLUMNS, phone, F.lit(True)), ("V", schema.VEHICLE_COLUMNS, vehicle, F.col("row") < F.col("n") - SHORT)):
        cells = [F.coalesce(known[c].cast("string"), F.lit("")) if c in known else F.lit("0.5") for c in columns]
        lines.append(rows.where(kept).select("drive", F.lit(kind).alias("kind"), "row", F.concat_ws(", ", *cells).alias("line")))
        lines.append(rows.select("drive").distinct().select("drive", F.lit(kind), F.lit(-1).cast("long"), F.lit(", ".join(columns))))
    wide = rows.where(F.col("drive") == 0).select(F.lit(DRIVES).cast("long"), F.lit("S"), F.col("row") - 1, F.lit("1, 2, 3"))
    text = lines[0]
    for more in (*lines[1:], wide):
        text = text.union(more)
    path = shared_path(spark, "recordings")
    text.repartition("drive", "kind").sortWithinPartitions("drive", "kind", "row").select("drive", "kind", "line").write.partitionBy("drive", "kind").text(path)
    # Spark names files itself; recordings have names of their own.
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    new = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    for drive in range(DRIVES + 1):
        for kind in "SV":
            for found in store.globStatus(new(f"drive={drive}", f"kind={kind}", "part-*")) or []:
                store.mkdirs(new(f"drive-{drive}"))
                store.rename(found.getPath(), new(f"drive-{drive}", f"{kind}-drive{drive}.csv"))
        store.delete(new(f"drive={drive}"), True)
    return path


DRIVEN = f"""{SAMPLES}, dr AS (SELECT *, seq_id % {DRIVES} AS drive, row_number() OVER (PARTITION BY seq_id % {DRIVES} ORDER BY seq_id, t_us, event_id) - 1 AS r, count(*) OVER (PARTITION BY seq_id % {DRIVES}) AS n FROM s)"""


@query(
    f"""WITH {DRIVEN} SELECT 'drive' || drive AS seq_id, count(*) AS n_rows, round(sum(v / 3.6), 3) AS phone_speed, round(sum((v + 1) / 3.6), 3) AS veh_speed, round(sum(v / 500 * 9.80665), 4) AS veh_accel, round(sum(0.5 / 3.6), 4) AS veh_climb, round(sum(radians(yaw * 57.3)), 4) AS veh_yaw, sum(event_id % 9 + 4)::DOUBLE AS sats, count(*) FILTER (event_id % 5 > 0) AS pitches, max(r * 100) AS t_ms
FROM dr WHERE r < n - {SHORT} AND drive IN (SELECT drive FROM dr GROUP BY drive HAVING quantile_cont(abs(yaw * CASE WHEN drive = 7 THEN 57.3 ELSE 1 END), 0.995) < 10 AND max(v) / 100 < 100 AND max(v) FILTER (r < n - {SHORT}) / 10 < 400) GROUP BY drive"""
)
def recording_pairs(spark, sf_dir):
    """Files of phones and vehicles found, parsed, bound, converted and checked; row i of one with row i of the other. A drive in wrong units and a file of a wrong width are left out."""
    phone, vehicle, _, _ = recordings.load_checked_pairs(spark, written_recordings(spark, sf_dir))
    both = sequences.pair_streams(phone, vehicle)
    total = lambda c, digits: F.round(F.sum(c), digits)
    return both.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        total("phone_gps_speed_mps", 3).alias("phone_speed"),
        total("veh_speed_mps", 3).alias("veh_speed"),
        total("veh_long_accel_mps2", 4).alias("veh_accel"),
        total("veh_vertical_velocity_mps", 4).alias("veh_climb"),
        total("veh_yaw_rate_radps", 4).alias("veh_yaw"),
        F.sum("phone_gps_sats").alias("sats"),
        F.count_if(~F.isnan("phone_gyro_pitch_radps")).alias("pitches"),
        F.max("t_ms").alias("t_ms"),
    )


@query(
    f"""WITH {DRIVEN}, g AS (SELECT drive, abs(yaw * CASE WHEN drive = 7 THEN 57.3 ELSE 1 END) AS y, event_id, v, r, n FROM dr),
c AS (SELECT drive, 'gyro_yaw_radps' AS "column", y AS x, 10 AS most, true AS soft FROM g UNION ALL SELECT drive, 'gyro_pitch_radps', y / 2, 10, true FROM g WHERE event_id % 5 > 0 UNION ALL SELECT drive, 'gyro_roll_radps', 0.5, 10, true FROM g
 UNION ALL SELECT drive, 'accel_x_mps2', v / 100, 100, false FROM g UNION ALL SELECT drive, a, 0.5, 100, false FROM g, (VALUES ('accel_y_mps2'), ('accel_z_mps2')) AS t(a) UNION ALL SELECT drive, w, v / 10, 400, false FROM g, (VALUES {', '.join(f"('{w}')" for w in recordings.WHEELS)}) AS t(w) WHERE r < n - {SHORT})
SELECT 'drive' || drive AS seq_id, "column", round(max(x), 4) AS largest, CASE WHEN any_value(soft) THEN count(*) FILTER (x >= 10) END AS spikes, CASE WHEN any_value(soft) THEN quantile_cont(x, 0.995) ELSE max(x) END < any_value(most) AS sane FROM c GROUP BY ALL"""
)
def recording_sanity(spark, sf_dir):
    """What each sequence's sensors read at most, and whether that is credible."""
    phone, vehicle, _ = recordings.load_pairs(spark, written_recordings(spark, sf_dir))
    return recordings.sanity(phone, vehicle).withColumn("largest", F.round("largest", 4))


@query(
    f"""WITH {DRIVEN} SELECT 'drive' || drive AS seq_id, NULL AS reason, count(*) AS n_rows, CASE WHEN drive % 2 = 0 THEN CASE WHEN list_reduce(list_prepend(0::BIGINT, list_reverse(list_transform(range(1, 7), lambda i: ord(substring('drive' || drive, i::INT, 1))::BIGINT))), lambda a, b: (a * 256 + b) % 1000) < 250 THEN 'test_ood_region' ELSE 'heldout' END ELSE 'pretrain' END AS role FROM dr GROUP BY drive
UNION ALL SELECT 'drive{DRIVES}', 'columns: 3', NULL, NULL"""
)
def recording_phones(spark, sf_dir):
    """Phone files by themselves: rows and roles, and the file that doesn't fit with its reason."""
    phone, rejected = recordings.load_phone_only(spark, written_recordings(spark, sf_dir))
    rows = phone.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("family", F.when(F.regexp_extract("seq_id", r"(\d+)", 1).cast("int") % 2 == 0, "far").otherwise("near"))
    roles = splits.assign_roles(rows, ["far"], ["near"]).select("seq_id", F.lit(None).cast("string").alias("reason"), "n_rows", "role")
    return roles.unionByName(rejected.select(F.regexp_extract("path", r"S-(\w+)\.csv", 1).alias("seq_id"), "reason", F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("role")))
