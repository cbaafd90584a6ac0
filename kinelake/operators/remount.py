"""Change points: when a phone was put into its mount differently, from the direction of gravity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.nanops import finite

SIDES = ("roll_up", "roll_down", "pitch_up", "pitch_down")


def tilt_sums(samples: DataFrame, gravity: list[str], by: str = "seq_id", order: str = "row_idx", settle: int = 30, slack_rad: float = 0.05) -> DataFrame:
    """Adds roll_rad and pitch_rad (from the mean of the key's first ``settle`` valid rows) and the sums SIDES.

    A sum adds up by how much the angle exceeds the slack in its direction, and never falls below 0. As such a sum is the running total minus the
    total's minimum so far, windows give it, without a recursion. Rows whose gravity isn't finite or is 0 are left out.
    """
    gx, gy, gz = (F.col(g).cast("double") for g in gravity)
    good = samples.where(finite(gravity[0]) & finite(gravity[1]) & finite(gravity[2]) & ((gx * gx + gy * gy + gz * gz) > 0))
    angles = good.withColumn("_roll", F.atan2(gy, gz)).withColumn("_pitch", F.atan2(-gx, F.sqrt(gy * gy + gz * gz)))
    at = W.partitionBy(by).orderBy(order)
    counted = angles.withColumn("_at", F.row_number().over(at))
    early = F.col("_at") <= settle
    base = W.partitionBy(by)
    # Angles of roll are averaged as directions, as they may stand on both sides of half a turn.
    roll0 = F.atan2(F.sum(F.when(early, F.sin("_roll"))).over(base), F.sum(F.when(early, F.cos("_roll"))).over(base))
    off = counted.withColumn("roll_rad", F.col("_roll") - roll0).withColumn("pitch_rad", F.col("_pitch") - F.avg(F.when(early, F.col("_pitch"))).over(base))
    off = off.withColumn("roll_rad", F.atan2(F.sin("roll_rad"), F.cos("roll_rad")))
    so_far = at.rowsBetween(W.unboundedPreceding, 0)
    steps = {"roll_up": F.col("roll_rad"), "roll_down": -F.col("roll_rad"), "pitch_up": F.col("pitch_rad"), "pitch_down": -F.col("pitch_rad")}
    totals = off.withColumns({f"_t_{n}": F.sum(x - slack_rad).over(so_far) for n, x in steps.items()})
    sums = {n: F.col(f"_t_{n}") - F.least(F.lit(0.0), F.min(f"_t_{n}").over(so_far)) for n in SIDES}
    return totals.withColumns(sums).drop("_roll", "_pitch", "_at", *[f"_t_{n}" for n in SIDES])


def remounts(samples: DataFrame, gravity: list[str], by: str = "seq_id", order: str = "row_idx", settle: int = 30, slack_rad: float = 0.05, limit: float = 1.0) -> DataFrame:
    """(by, detected, changed, side): the first row of a key at which a sum reaches ``limit``, the row after that sum was last 0, and the direction; the first of SIDES if several do.

    Alignment has to start again there; rows from ``detected`` on can be searched by themselves for a further change.
    """
    rows = tilt_sums(samples, gravity, by, order, settle, slack_rad)
    so_far = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sides = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(n).alias("side"), F.col(n).alias("sum"), F.max(F.when(F.col(n) <= 0, F.col(order))).over(so_far).alias("rest")) for i, n in enumerate(SIDES)])
    over = rows.withColumn("_hit", F.get(F.filter(sides, lambda s: s["sum"] >= limit), F.lit(0))).where(F.col("_hit").isNotNull())
    first = over.groupBy(by).agg(F.min(F.struct(F.col(order).alias("at"), "_hit")).alias("_f"))
    return first.select(by, F.col("_f.at").alias("detected"), (F.coalesce(F.col("_f._hit.rest"), F.lit(-1)) + 1).alias("changed"), F.col("_f._hit.side").alias("side"))
