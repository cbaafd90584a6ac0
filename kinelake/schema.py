"""Fixed schemas and contract constants. Columns bind by position; every table of samples carries (seq_id, row_idx)."""

from __future__ import annotations

from pyspark.sql import types as T

RATE_HZ, DT_S, ROW_MS = 10, 0.1, 100
WINDOW_ROWS, TRAIN_STRIDE, INFER_STRIDE, GUARD_ROWS = 20, 5, 20, 100
SEGMENT_GAP_MS, BACKWARD_MS = 500, -200

#: Column orders of the recording files after load.
PHONE_COLUMNS = (
    "gps_lat_deg gps_lon_deg gps_alt_m gps_speed_mps gps_accuracy_m gps_orientation_deg gps_sats time_since_start_ms date_local_raw "
    "accel_x_mps2 accel_y_mps2 accel_z_mps2 gravity_x_mps2 gravity_y_mps2 gravity_z_mps2 gyro_yaw_radps gyro_pitch_radps gyro_roll_radps "
    "mag_x_ut mag_y_ut mag_z_ut orient_yaw_deg orient_pitch_deg orient_roll_deg"
).split()
PHONE_COLUMNS_REDUCED = PHONE_COLUMNS[:18]
VEHICLE_COLUMNS = (
    "gps_sats time_of_day_s gt_lat_deg gt_lon_deg speed_mps heading_deg height_m vertical_velocity_mps sample_period_s steering_angle_deg "
    "wheel_fl_radps wheel_fr_radps wheel_rl_radps wheel_rr_radps yaw_rate_radps indicated_speed_mps long_accel_mps2 lat_accel_mps2 handbrake "
    "gear_requested gear engine_rpm coolant_temp_c clutch brake_pressure_psi brake_position battery_v air_temp_c accel_pedal_pct"
).split()
WHEELS = tuple(f"veh_wheel_{w}_radps" for w in ("fl", "fr", "rl", "rr"))
REPLAY_COLUMNS = "timestamp_ms accel_x accel_y accel_z gyro_x gyro_y gyro_z mag_x mag_y mag_z gnss_valid gnss_lat gnss_lon gnss_speed_mps gnss_course_deg".split()
REPLAY_NULLABLE = REPLAY_COLUMNS[11:]


def replay_schema() -> T.StructType:
    kinds = {"timestamp_ms": T.LongType(), "gnss_valid": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType()), c in REPLAY_NULLABLE) for c in REPLAY_COLUMNS])


def recording_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType() if c == "date_local_raw" else T.DoubleType()) for c in columns])
