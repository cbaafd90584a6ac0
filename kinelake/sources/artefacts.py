"""JSON artefacts: manifests, registries, baselines, normalisers, map extracts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.scalar import semver_at_least


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents with the file each came from."""
    return spark.read.option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_name"))


def latest_by_name(found: DataFrame) -> DataFrame:
    """The document whose file name is last."""
    return found.join(F.broadcast(found.agg(F.max("file").alias("file"))), "file")


def public_segments(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("segments").alias("s")).select("s.*").where("public_subset")


def compatible_models(models: DataFrame, least: str, version_col: str = "contract_version") -> DataFrame:
    return models.where(semver_at_least(version_col, least))


def latest_model(models: DataFrame, pointer: DataFrame | None = None, name: str = "version") -> DataFrame:
    """The model that the pointer (one column, same name) gives, else the last by name."""
    last = models.agg(F.max(name).alias("_last"))
    if pointer is not None:
        last = last.crossJoin(F.broadcast(pointer.agg(F.max(name).alias("_chosen")))).select(F.coalesce("_chosen", "_last").alias("_last"))
    return models.join(F.broadcast(last), F.col(name) == F.col("_last")).drop("_last")


def refuse_unsigned(models: DataFrame, development: bool, signature: str = "signature") -> DataFrame:
    return models if development else models.where(F.col(signature).isNotNull() & (F.col(signature) != ""))


def normaliser_rows(document: DataFrame, order: list[str]) -> DataFrame:
    """(channel, position, mean, std); another order of channels than expected is an error."""
    rows = document.select(F.posexplode(F.arrays_zip("order", "mean", "std")).alias("position", "c")).select("position", F.col("c.order").alias("channel"), F.col("c.mean").alias("mean"), F.col("c.std").alias("std"))
    found = [r["channel"] for r in rows.orderBy("position").collect()]
    if found != order:
        raise ValueError(f"channels {found}, expected {order}")
    return rows


def map_extract(extracts: DataFrame, regions: list[str], region: str, development: bool) -> DataFrame:
    """Metadata of a region's extract; unknown regions raise, missing ones give a stub in development and raise otherwise."""
    if region not in regions:
        raise ValueError(f"unknown region {region}")
    found = extracts.where(F.col("region") == region)
    if found.isEmpty():
        if not development:
            raise LookupError(region)
        return found.sparkSession.createDataFrame([(region, "stub")], "region string, version string")
    return found


def save_new(rows: DataFrame, path: str, force: bool = False) -> None:
    """An append-only artefact: an existing one is only replaced by force."""
    rows.write.mode("overwrite" if force else "errorifexists").json(path)


def cached(spark: SparkSession, root: str, parts: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, kept as Parquet under ``root`` by a digest of ``parts`` (inputs with their versions, parameters) and read from there from the second time on.

    Only a folder that was written to its end counts; what a failed run left is replaced. ``root`` is a folder that driver and executors share.
    """
    name = hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = f"{root.rstrip('/')}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
