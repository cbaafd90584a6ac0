"""Split assignment, hold-outs, and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinelake.functions.scalar import holdout_bucket
from kinelake.operators.reports import split_counts


def assign_splits(sequences: DataFrame, by_id: dict[str, str], by_family: dict[str, str], id_col: str = "seq_id", family_col: str = "route_family", default: str = "excluded") -> DataFrame:
    """Adds split: an id's own entry comes before its family's. The two tables are small literals."""
    spark = sequences.sparkSession
    ids = spark.createDataFrame(list(by_id.items()) or [(None, None)], "k string, id_split string")
    families = spark.createDataFrame(list(by_family.items()) or [(None, None)], "k string, family_split string")
    out = sequences.join(F.broadcast(ids), F.col(id_col) == ids["k"], "left").drop("k").join(F.broadcast(families), F.col(family_col) == families["k"], "left").drop("k")
    return out.withColumn("split", F.coalesce("id_split", "family_split", F.lit(default))).drop("id_split", "family_split")


def assign_roles(sequences: DataFrame, ood_families: list[str], pretrain_families: list[str], share: float = 0.25, id_col: str = "seq_id", family_col: str = "family") -> DataFrame:
    """Adds role: a fixed share of the out-of-distribution families is tested on, pre-training families train, the rest is held out."""
    out = F.col(family_col).isin(ood_families) & (holdout_bucket(id_col) < int(share * 1000))
    return sequences.withColumn("role", F.when(out, "test_ood_region").when(F.col(family_col).isin(pretrain_families), "pretrain").otherwise("heldout"))


def manifest_digest(files: DataFrame, id_col: str, digests: list[str], by: list[str]) -> DataFrame:
    """SHA-256 over each group's ``id:digest:...`` lines in order of id. Manifests list files, not rows, so a group is small."""
    line = F.concat_ws(":", F.col(id_col), *digests)
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "").cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def file_digests(spark, path: str) -> DataFrame:
    """(path, length, sha256) of each file, read and hashed on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def public_subset(outages: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` outages of all, by key."""
    return outages.orderBy("key").limit(n)


def hours(sequences: DataFrame, rows: str, by: list[str], rate: int = 10) -> DataFrame:
    return sequences.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(rows) / rate / 3600, 2).alias("hours"))


def histogram(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of each of ``values``, absent ones with 0."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def write_manifests(records: DataFrame, digests: DataFrame, folder: str, force: bool = False) -> None:
    """Split manifests: ``records`` (one row a sequence with its split) under ``folder``/sequences by split, and ``folder``/summary, one JSON row a split with counts and the digest of its files.

    Existing manifests are only replaced by force, as results refer to them. ``digests`` (split, digest) come from ``manifest_digest``.
    """
    mode = "overwrite" if force else "errorifexists"
    records.write.mode(mode).partitionBy("split").parquet(f"{folder}/sequences")
    split_counts(records).join(digests.select("split", "digest"), "split", "left").coalesce(1).write.mode(mode).json(f"{folder}/summary")


def read_manifests(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, summary) as ``write_manifests`` wrote them; ``schema`` is that of the records."""
    return spark.read.schema(schema).parquet(f"{folder}/sequences"), spark.read.json(f"{folder}/summary")
