"""Shared scratch tables and skew-safe joins used by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.session import shared_root

#: A key is hot when it holds at least 1/HOT_SHARE of all rows, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000
#: Bytes of an Arrow batch that a Python worker gets at once, where the session hasn't set its own limit.
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as the session has it; scratch tables stand there."""
    return shared_root(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded by bytes, as rows may be long; a task's buffers go back to the system when it ends."""
    conf, limit = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not conf.get(limit, None):
        conf.set(limit, str(BATCH_BYTES))

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(task, schema)


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once results that read them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot_split(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row a key in ``groups``, where ``groups[size]`` counts the key's rows.

    Keys with at least ``total / HOT_SHARE`` rows number HOT_SHARE at most, so that
    side is broadcast; the rest have too few rows each to overload a task.
    """
    hot = F.col(size) >= max(2, total // HOT_SHARE)
    hot_groups = groups.where(hot)
    hot_keys = F.broadcast(hot_groups.select(*keys))
    warm = rows.join(F.broadcast(hot_groups), keys)
    cold = rows.join(hot_keys, keys, "left_anti").join(groups.where(~hot), keys)
    return warm.unionByName(cold)


def key_bitmap(keys: DataFrame, column: Column, bits: int = 23) -> np.ndarray:
    """A bitmap of 2**bits bits (1 MB by default) with the bit of each key's hash set.

    ``column`` gives a non-negative long below 2**bits. The size doesn't depend on
    the data, so the result may be sent to every task; as it fills, it just prunes less.
    """
    words = (
        keys.select(column.alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
        .toArrow()  # as columns, whatever the session's settings: up to 131072 rows by default, which as Row objects fill the driver
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out
