"""Ordered samples: breaks, segments, sliding windows, interval and as-of joins, pairing of streams.

A sequence is a set of rows (seq_id, row_idx); windows over it share one shuffle on seq_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake import schema
from kinelake.functions.nanops import finite


def ordered(seq: str = "seq_id", row: str = "row_idx"):
    return W.partitionBy(seq).orderBy(row)


def number_rows(samples: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Adds row_idx from 0, in the given order, within each sequence."""
    return samples.withColumn("row_idx", (F.row_number().over(W.partitionBy(seq).orderBy(*order)) - 1).cast("long"))


def with_breaks(samples: DataFrame, clocks: dict[str, float], gap_ms: float = schema.SEGMENT_GAP_MS, backward_ms: float = schema.BACKWARD_MS) -> DataFrame:
    """Adds is_break: any clock (column -> factor to ms) isn't finite, jumps by more than gap_ms or back by more than backward_ms."""
    broken: Column = F.lit(False)
    for clock, factor in clocks.items():
        step = (F.col(clock) - F.lag(clock).over(ordered())).cast("double") * factor
        broken = broken | ~finite(step) | (step > gap_ms) | (step < backward_ms)
    return samples.withColumn("is_break", (F.col("row_idx") > 0) & broken)


def segments(broken: DataFrame) -> DataFrame:
    """(seq_id, seg_index, start, stop, n_rows): half-open runs of rows between breaks."""
    run = F.sum(F.col("is_break").cast("int")).over(ordered().rowsBetween(W.unboundedPreceding, 0))
    out = broken.withColumn("seg_index", run).groupBy("seq_id", "seg_index").agg(F.min("row_idx").alias("start"), (F.max("row_idx") + 1).alias("stop"))
    return out.withColumn("n_rows", F.col("stop") - F.col("start"))


def sliding_windows(segs: DataFrame, size: int = schema.WINDOW_ROWS, stride: int = schema.TRAIN_STRIDE, guard: int = schema.GUARD_ROWS) -> DataFrame:
    """(seq_id, seg_index, start, stop): windows of ``size`` rows within each segment, ``guard`` rows off its ends.

    The starts come from arithmetic on the segment alone; samples aren't touched.
    """
    first, last = F.col("start") + guard, F.col("stop") - guard - size
    fits = segs.where(last >= first)
    return fits.select("seq_id", "seg_index", F.explode(F.sequence(first, last, F.lit(stride).cast("long"))).alias("start")).withColumn("stop", F.col("start") + size)


def gathered_windows(samples: DataFrame, gathered: dict[str, Column], size: int = schema.WINDOW_ROWS, stride: int = schema.TRAIN_STRIDE, guard: int = schema.GUARD_ROWS) -> DataFrame:
    """(seq_id, start, gathered): the windows of ``sliding_windows`` over whole sequences, numbered from 0 without gaps, with aggregates of each window's rows, lists in their order.

    A frame at a window's first row holds its rows, so rows are neither copied for each window nor moved from where their sequence is.
    """
    rows, stop = ordered().rowsBetween(0, size - 1), F.max("row_idx").over(W.partitionBy("seq_id")) + 1
    at = samples.withColumns({"_stop": stop, **{name: c.over(rows) for name, c in gathered.items()}})
    begins = (F.col("row_idx") >= guard) & (F.col("row_idx") <= F.col("_stop") - guard - size) & ((F.col("row_idx") - guard) % stride == 0)
    return at.where(begins).select("seq_id", F.col("row_idx").alias("start"), *gathered)


def window_counts(segs: DataFrame, size: int = schema.WINDOW_ROWS, stride: int = schema.TRAIN_STRIDE, guard: int = schema.GUARD_ROWS) -> DataFrame:
    """Windows of each sequence, by formula."""
    room = F.col("stop") - F.col("start") - 2 * guard - size
    return segs.groupBy("seq_id").agg(F.sum(F.when(room >= 0, F.floor(room / stride) + 1).otherwise(0)).alias("n_windows"))


def interval_rows(intervals: DataFrame, samples: DataFrame, inclusive: bool = False) -> DataFrame:
    """The samples of each interval [start, stop) (or [start, stop]), with i from 0: an equi-join on the row number, not a range join.

    Both sides are sorted: Spark takes exploded rows for as many as the intervals and would send all of them to the driver, as a small table.
    """
    last = F.col("stop") if inclusive else F.col("stop") - 1
    rows = intervals.where(last >= F.col("start")).withColumn("row_idx", F.explode(F.sequence("start", last)))
    return rows.withColumn("i", F.col("row_idx") - F.col("start")).join(samples.hint("merge"), ["seq_id", "row_idx"])


def lookback_rows(points: DataFrame, samples: DataFrame, rows: int, at: str = "start") -> DataFrame:
    """The samples of up to ``rows`` rows strictly before each point."""
    starts = points.withColumn("stop", F.col(at)).withColumn("start", F.greatest(F.col(at) - rows, F.lit(0)))
    return interval_rows(starts.withColumn("at", F.col("stop")), samples)


def row_before(points: DataFrame, samples: DataFrame, start: str = "start") -> DataFrame:
    """Each point with the sample at max(start - 1, 0). Both sides are sorted, as points grow with the samples."""
    return points.withColumn("row_idx", F.greatest(F.col(start) - 1, F.lit(0).cast("long"))).join(samples.hint("merge"), ["seq_id", "row_idx"])


def last_known(samples: DataFrame, columns: list[str], valid: Column) -> DataFrame:
    """As-of: adds last_<column>, its value at the latest valid row up to each row."""
    over = ordered().rowsBetween(W.unboundedPreceding, 0)
    return samples.select("*", *[F.last(F.when(valid, F.col(c)), True).over(over).alias(f"last_{c}") for c in columns])


def pair_streams(left: DataFrame, right: DataFrame, prefixes: tuple[str, str] = ("phone_", "veh_")) -> DataFrame:
    """Row i of one stream with row i of the other, columns prefixed, on a clock made from the row number."""
    keys = ["seq_id", "row_idx"]
    a, b = (df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys]) for df, p in ((left, prefixes[0]), (right, prefixes[1])))
    return a.join(b, keys).withColumn("t_ms", F.col("row_idx") * schema.ROW_MS)


def pairing_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per sequence: rows of each stream, rows dropped from the longer one, and whether that is over a hundredth."""
    counts = [df.groupBy("seq_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "n_left"), (right, "n_right"))]
    both = counts[0].join(counts[1], "seq_id").withColumn("n_rows", F.least("n_left", "n_right")).withColumn("dropped", F.abs(F.col("n_left") - F.col("n_right")))
    return both.withColumn("flagged", F.col("dropped") > F.greatest(F.lit(1), F.floor(F.col("n_rows") * 0.01)))


def held(samples: DataFrame, windows: DataFrame, value: str, n: Column, m: Column) -> DataFrame:
    """Window values spread over a sequence's samples: row i takes window floor(i / (n / m)), the last at most."""
    at = F.least(F.floor(F.col("row_idx") / (n / m)), m - 1).cast("long")
    return samples.withColumn("window", at).join(windows.select("seq_id", "window", value), ["seq_id", "window"], "left")


def centred_std(samples: DataFrame, value: str, before: int = 5, after: int = 4) -> DataFrame:
    """Sample standard deviation over the rows from i - before to i + after; null where the frame isn't full."""
    frame = ordered().rowsBetween(-before, after)
    full = F.count(F.when(finite(value), 1)).over(frame) == before + after + 1
    return samples.withColumn("rolling_std", F.when(full, F.stddev_samp(value).over(frame)))


def stationary(samples: DataFrame, accel: list[str], gyro: list[str], rows: int = 10, accel_limit: float = 0.02, gyro_limit: float = 0.001) -> DataFrame:
    """Adds is_stationary: summed population variances of the trailing rows are under both limits; false until the frame is full."""
    frame = ordered().rowsBetween(-(rows - 1), 0)
    energy = lambda columns: sum((F.var_pop(c).over(frame) for c in columns), F.lit(0.0))
    full = F.count(F.lit(1)).over(frame) == rows
    return samples.withColumn("accel_energy", energy(accel)).withColumn("gyro_energy", energy(gyro)).withColumn("is_stationary", full & (F.col("accel_energy") < accel_limit) & (F.col("gyro_energy") < gyro_limit))


def gradient(samples: DataFrame, value: str, per_row: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the ends, times rows per unit."""
    now, prev, after = F.col(value), F.lag(value).over(ordered()), F.lead(value).over(ordered())
    return samples.withColumn("gradient", F.when(prev.isNull(), after - now).when(after.isNull(), now - prev).otherwise((after - prev) / 2) * per_row)
