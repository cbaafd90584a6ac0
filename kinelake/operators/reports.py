"""Summaries of splits, runs and outages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.schema import GUARD_ROWS, INFER_STRIDE, RATE_HZ, TRAIN_STRIDE, WINDOW_ROWS

#: Sequences with more rows are long enough to be benched.
BENCH_ROWS = 600


def split_records(sequences: DataFrame, segments: DataFrame, size: int = WINDOW_ROWS, guard: int = GUARD_ROWS, rate: int = RATE_HZ, strides: tuple[int, int] = (TRAIN_STRIDE, INFER_STRIDE)) -> DataFrame:
    """One row a sequence (seq_id, split, ..., n_rows) with duration_s, n_segments, and its windows at the training and the inference stride."""
    room = F.greatest(F.col("stop") - F.col("start") - 2 * guard - size, F.lit(-1))
    windows = [F.sum(F.when(room >= 0, F.floor(room / stride) + 1).otherwise(0)).cast("long") for stride in strides]
    counted = segments.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_segments"), windows[0].alias("n_windows_train_stride"), windows[1].alias("n_windows_infer_stride"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_segments", "n_windows_train_stride", "n_windows_infer_stride")]
    return sequences.join(counted, "seq_id", "left").select(*sequences.columns, F.bround(F.col("n_rows") / rate, 1).alias("duration_s"), *zero)


def split_counts(records: DataFrame) -> DataFrame:
    """Per split: sequences, hours, hours of usable sequences, and training windows."""
    used = F.when(F.col("usability") == "use", F.col("duration_s")).otherwise(0.0)
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("n_sequences"), F.bround(F.sum("duration_s") / 3600, 2).alias("hours"), F.bround(F.sum(used) / 3600, 2).alias("hours_use"), F.sum("n_windows_train_stride").alias("train_windows"))


def family_summary(sequences: DataFrame, by: str = "split", family: str = "route_family") -> DataFrame:
    """The distinct families of each group, in order, joined by plus signs. Families are few."""
    return sequences.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(family)), " + ").alias("families"))


def best_checkpoint(runs: DataFrame, by: list[str], score: str = "rmse", name: str = "checkpoint") -> DataFrame:
    """Per group the run of the least score, the smaller name of equals."""
    return runs.where(~F.isnan(score)).groupBy(*by).agg(F.min(F.struct(F.col(score), F.col(name))).alias("b")).select(*by, f"b.{name}", f"b.{score}")


def ablation_table(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Every registered row (row, title, external) with its result (row, value): done, or else external or pending."""
    status = F.when(F.col("value").isNotNull(), "done").when(F.col("external"), "external").otherwise("pending")
    return rows.join(results, "row", "left").select("row", "title", "value", status.alias("status"))


def golden_records(outages: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, distance_m, start_lat, start_lon): the way along each outage's rows (i, lat, lon, te, tn), rounded to cm, and its start to 6 places."""
    order = W.partitionBy(key).orderBy("i")
    step = F.hypot(F.col("te") - F.lag("te").over(order), F.col("tn") - F.lag("tn").over(order))
    way = rows.withColumn("step", step).groupBy(key).agg(F.bround(F.coalesce(F.sum("step"), F.lit(0.0)), 2).alias("distance_m"), F.bround(F.min_by("lat", "i"), 6).alias("start_lat"), F.bround(F.min_by("lon", "i"), 6).alias("start_lon"))
    return outages.select(key).join(way, key)


def bench_sequences(sequences: DataFrame, least_rows: int = BENCH_ROWS) -> DataFrame:
    return sequences.where(F.col("n_rows") > least_rows)


def validation_split(items: DataFrame, id_col: str, by: list[str], seed: str = "0", share: int = 6, least: int = 2) -> DataFrame:
    """Adds is_val: of each group one in ``share``, ``least`` at least, in the order of a hash of the id."""
    mine = W.partitionBy(*by)
    turn = F.row_number().over(mine.orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary")), id_col))
    many = F.greatest(F.floor(F.count(F.lit(1)).over(mine) / share), F.lit(least))
    return items.withColumn("is_val", turn <= many)


def wire_names(df: DataFrame) -> DataFrame:
    """Columns as the interface names them: snake_case becomes camelCase."""
    return df.toDF(*[head + "".join(part.capitalize() for part in rest) for head, *rest in (c.split("_") for c in df.columns)])
