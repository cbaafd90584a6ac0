"""Structured Streaming twins: the inertial engine with keyed state, and ingestion of label uploads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.kernels.inertial import Engine
from kinelake.operators.filters import ENGINE_COLUMNS, engine_inputs, engine_rows, engine_schema
from kinelake.operators.ingest import UPLOAD_SCHEMA, judged_pairs


def run_engine(samples: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """The engine over a stream of (key, ns, ax, ay, az, gx, gy, gz): one trip a key, its state two arrays.

    Samples of a batch are put in order; samples no later than the last one seen are dropped
    and counted in the state. Position fixes and model speeds come in columns as in the batch twin. A trip idle for ``idle_ms`` is forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        engine = Engine(state.get if state.exists else None)
        rows = engine_rows(engine, key[0], pd.concat(list(frames)).sort_values("ns", kind="stable"))
        if engine.started:  # nothing is known before the first sample
            state.update(engine.state())
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=ENGINE_COLUMNS)

    kind = samples.schema["key"].dataType.simpleString()
    grouped = samples.select(*engine_inputs(samples)).groupBy("key")
    return grouped.applyInPandasWithState(step, engine_schema(kind), "head array<bigint>, body array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(samples: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Segments of a stream by event time: (key, start, stop, n) of (key, ts); rows later than ``late`` are dropped."""
    windowed = samples.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def read_uploads(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(UPLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(uploads: DataFrame, out: str, checkpoint: str):
    """Accepted and rejected pairs as Parquet, in folders by whether they were accepted; a batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = judged_pairs(batch).withColumn("accepted", F.col("reason").isNull())
        rows.write.mode("overwrite").partitionBy("accepted").parquet(f"{out}/batch={number}")

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
