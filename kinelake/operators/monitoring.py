"""Quality of fixes and modes of navigation, and the orientation of a phone: the batch twins of the streaming operators."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.nanops import finite
from kinelake.kernels.modes import Monitor, Policy
from kinelake.operators.alignment import levelled, yaw_search
from kinelake.operators.filters import by_key_in_order, key_bounds, whole_keys

FIX = ["key", "t_ms", "east_m", "north_m", "accuracy_m", "sats"]
#: Of a key's fixes at one time the first in this order counts (missing values last).
ORDER = FIX[1:]
SAID = ["t_ms", "stat", "quality", "mode", "trigger"]


def monitored_schema(kind: str) -> str:
    return f"key {kind}, t_ms long, stat double, quality string, mode string, trigger string, dropped long"


def key_rows(monitor: Monitor, key, d: pd.DataFrame) -> Iterator[tuple]:
    """What the monitor says about one key's fixes, in their order."""
    for fix in zip(*(d[c].to_numpy() for c in FIX[1:]), strict=True):
        for row in monitor.fix(*fix):
            yield (key, *row, monitor.dropped)


def monitor_fixes(fixes: DataFrame, policy: Policy = Policy(), until_ms: int | None = None) -> DataFrame:
    """(key, t_ms, stat, quality, mode, trigger, dropped): a row for each fix (key, t_ms, east_m, north_m, accuracy_m, sats), and one for each mode that ends for want of fixes.

    ``trigger`` says why the mode changed, and is null where it didn't; ``dropped`` counts the key's fixes so far that came
    at no later time than the one before (of equal times the first by place, accuracy and satellites counts). A gap after a key's last fix is reported if it was due before ``until_ms``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in whole_keys(frames):
            rows = []
            for a, b in itertools.pairwise(key_bounds(d["key"])):
                monitor, key = Monitor(policy), d["key"].iloc[a]
                rows += key_rows(monitor, key, d.iloc[a:b])
                if until_ms is not None and (last := monitor.expire(until_ms)):
                    rows.append((key, *last, monitor.dropped))
            yield pd.DataFrame(rows, columns=["key", *SAID, "dropped"])

    kind = fixes.schema["key"].dataType.simpleString()
    return by_key_in_order(fixes.select(*FIX), *[F.asc_nulls_last(c) for c in ORDER]).mapInPandas(run, monitored_schema(kind))


def calibrations(samples: DataFrame, accel: list[str], gravity: list[str], reference: str, by: str = "key", order: str = "ns", least: int = 200, least_std: float = 1e-3) -> DataFrame:
    """(by, ns, n, yaw_deg, score, gravity): each key's orientation from its rows up to the first at which a yaw can be searched.

    That is the row with which ``least`` rows are valid and the reference so far deviates by ``least_std``. Keys that never get there
    are levelled by all rows, with a yaw of 0 and a null score. Rows of equal times count once, the first by value.
    """
    columns = [*gravity, *accel, reference]
    once = samples.select(by, order, *columns).withColumn("_n", F.row_number().over(W.partitionBy(by, order).orderBy(*columns))).where("_n = 1").drop("_n")
    valid = F.lit(True)
    for c in columns:
        valid = valid & finite(c)
    so_far = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    counted = once.withColumns({"_count": F.count(F.when(valid, 1)).over(so_far), "_std": F.stddev_pop(F.when(valid, F.col(reference))).over(so_far)})
    opened = (F.col("_count") >= least) & (F.col("_std") >= least_std)
    used = counted.withColumn("_open", F.min(F.when(opened, F.col(order))).over(W.partitionBy(by))).where(F.col("_open").isNull() | (F.col(order) <= F.col("_open")))
    both = levelled(used, accel, gravity, by)
    yaw = yaw_search(both, "level_x", "level_y", reference, by, least=least, least_std=least_std)
    known = finite(gravity[0]) & finite(gravity[1]) & finite(gravity[2])
    down = used.where(known).groupBy(by).agg(F.max(order).alias("_last"), F.array(*[F.avg(c) for c in gravity]).alias("gravity"))
    last = used.groupBy(by).agg(F.max(order).alias(order))
    return down.join(last, by).join(yaw, by, "left").select(by, order, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("yaw_deg", F.lit(0.0)).alias("yaw_deg"), "score", "gravity")
