"""Weighted draws with replacement, and random windows, over tables of any size; the same rows and seed give the same draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 1024


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of a seed and of the parts' decimal texts: 48 bits, and the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def weighted_draws(rows: DataFrame, draws: int, id_col: str, weight_col: str, seed: int = 0, cells: int = CELLS) -> DataFrame:
    """(draw, id) for draw 0 .. draws - 1: each an id by its share of all weights, with replacement.

    Rows lie end to end on a line, each as long as its weight: dealt into ``cells`` by a hash of the id, and by id within a cell. A cell's
    place on the line follows from the sums of the cells before it, of which there are ``cells`` whatever the rows; a draw is a point of the line. Points and rows of a cell
    are sorted together, and the last row that begins at or before a point is drawn: no join by range, no row compared
    with all. Weights that are null, not finite or not positive are never drawn; ids are distinct (of
    repeated ones the weights add up); without weights there are no draws.
    """
    weight = F.col(weight_col).cast("double")
    good = rows.where(F.col(id_col).isNotNull() & (weight > 0) & ~F.isnan(weight) & (weight < float("inf"))).groupBy(F.col(id_col).alias("id")).agg(F.sum(weight).alias("w"))
    placed = good.withColumn("cell", F.floor(unit(seed, F.col("id")) * cells).cast("int"))
    sums = {r["cell"]: r["w"] for r in placed.groupBy("cell").agg(F.sum("w").alias("w")).collect()}
    spark = rows.sparkSession
    if not sums or draws <= 0:
        return spark.createDataFrame([], f"draw long, id {good.schema['id'].dataType.simpleString()}")
    order = sorted(sums)
    ends = np.cumsum([sums[c] for c in order])
    begins = np.concatenate([[0.0], ends[:-1]])
    line = spark.createDataFrame([(c, float(a), float(b)) for c, a, b in zip(order, begins, ends, strict=True)], "cell int, low double, high double")
    points = spark.range(draws).select(F.col("id").alias("draw"), (unit(seed, F.lit("draw"), F.col("id")) * float(ends[-1])).alias("x"))
    at = F.array(*[F.lit(float(b)) for b in ends])
    # The number of cells that end at or before the point, by halving: as many steps as the number of cells has bits.
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(order).bit_length()))])
    index = F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= len(order) - 1) & (F.get(at, i + step - 1) <= F.col("x")), i + step).otherwise(i))
    points = points.withColumn("cell", F.get(F.array(*[F.lit(c) for c in order]), index))
    within = W.partitionBy("cell").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    rows_at = placed.join(F.broadcast(line), "cell").select("cell", "id", (F.col("low") + F.coalesce(F.sum("w").over(within), F.lit(0.0))).alias("x"), F.lit(None).cast("long").alias("draw"))
    both = rows_at.unionByName(points.select("cell", F.lit(None).cast(good.schema["id"].dataType).alias("id"), "x", "draw"))
    latest = W.partitionBy("cell").orderBy("x", F.col("draw").isNotNull(), "draw").rowsBetween(W.unboundedPreceding, 0)
    first = W.partitionBy("cell").orderBy(F.col("id").isNull(), "x", "draw")
    # Rounding may put a cell's first row a hair after a point of the cell; it is drawn then.
    drawn = both.withColumn("_id", F.coalesce(F.last("id", ignorenulls=True).over(latest), F.first("id").over(first)))
    return drawn.where("draw is not null").select("draw", F.col("_id").alias("id"))


def random_segments(segments: DataFrame, size: int, seed: int = 0, seq: str = "seq_id") -> DataFrame:
    """(seq, start, stop): one stretch of ``size`` rows in each sequence, its start uniform over all that fit in the sequence's segments [start, stop)."""
    room = segments.where(F.col("stop") - F.col("start") >= size).withColumn("room", F.col("stop") - F.col("start") - size + 1)
    order = W.partitionBy(seq).orderBy("start")
    placed = room.withColumn("before", F.sum("room").over(order) - F.col("room")).withColumn("all", F.sum("room").over(W.partitionBy(seq)))
    pick = F.floor(unit(seed, F.col(seq)) * F.col("all"))
    chosen = placed.where((pick >= F.col("before")) & (pick < F.col("before") + F.col("room")))
    start = F.col("start") + pick - F.col("before")
    return chosen.select(seq, start.alias("start"), (start + size).alias("stop"))
