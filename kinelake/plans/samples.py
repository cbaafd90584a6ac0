"""The driver's tables seen as recordings: events of a user are a sequence, its values speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.scalar import epoch_us
from kinelake.operators.sequences import number_rows, segments, sliding_windows, with_breaks

#: For sequences of some 70 rows; the recordings' own values are in kinelake.schema.
GAP_MS, WINDOW, STRIDE, GUARD = 6 * 3600 * 1000, 5, 2, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, row_idx, event_id, event_type, t_us, v, yaw): yaw is a made-up rate from the id."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), "event_id", "event_type", epoch_us("ts").alias("t_us"), F.col("value").alias("v"), "props")
    rows = number_rows(events, "seq_id", ["t_us", "event_id"])
    return rows.withColumn("yaw", ((F.col("event_id") * 37) % 200 - 100) / 100.0)


SAMPLES = """s AS (
  SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx, event_id, event_type,
         epoch_us(ts) AS t_us, value AS v, props, ((event_id * 37) % 200 - 100) / 100.0::DOUBLE AS yaw
  FROM events)"""


def event_segments(samples: DataFrame) -> DataFrame:
    return segments(with_breaks(samples, {"t_us": 0.001}, GAP_MS))


SEGMENTS = f"""b AS (
  SELECT *, CASE WHEN row_idx > 0 AND (t_us - lag(t_us) OVER w) * 0.001 > {GAP_MS} THEN 1 ELSE 0 END AS is_break FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY row_idx)),
r AS (SELECT *, sum(is_break) OVER (PARTITION BY seq_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_index FROM b),
g AS (SELECT seq_id, seg_index, min(row_idx) AS start, max(row_idx) + 1 AS stop FROM r GROUP BY ALL)"""


def event_windows(samples: DataFrame, size: int = WINDOW, stride: int = STRIDE, guard: int = GUARD) -> DataFrame:
    """Windows over whole sequences, taken as one segment each."""
    whole = samples.groupBy("seq_id").agg(F.lit(0).cast("long").alias("seg_index"), F.lit(0).cast("long").alias("start"), (F.max("row_idx") + 1).alias("stop"))
    return sliding_windows(whole, size, stride, guard)


WINDOWS = f"""n AS (SELECT seq_id, max(row_idx) + 1 AS stop FROM s GROUP BY seq_id),
w AS (SELECT seq_id, a AS start, a + {WINDOW} AS stop FROM (SELECT seq_id, unnest(generate_series({GUARD}, stop - {GUARD + WINDOW}, {STRIDE})) AS a FROM n)),
wr AS (SELECT w.seq_id, w.start, w.stop, s.row_idx, s.v, s.yaw, s.t_us FROM w JOIN s ON s.seq_id = w.seq_id AND s.row_idx >= w.start AND s.row_idx < w.stop)"""
