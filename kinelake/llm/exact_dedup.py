"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with one row a
distinct text: (digest, first_id, batch). A batch of new documents is hashed, reduced to
one row a digest, and compared with the index by a sort-merge anti-join that
needs no exchange of the index; the digests that remain are appended, tagged with the
batch's name. A job that dies after that and is run again under the same name finds its own
digests and takes them for new once more, so no text is lost. Texts never enter a shuffle,
only their digests do.

Cases: a null text counts as empty; texts are equal when identical after each run
of blanks (0x20, 0x09-0x0D) becomes one space; null ids come after all others; of
repeated rows (equal id and text) exactly one stays; an empty batch appends
nothing; a text of any length is one digest in the shuffles; columns besides the id and text are ignored by ``deduplicate`` and
carried along by ``keep_first``, whatever their names.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.llm.scratch import join_hot_split, materialise, new_path
from kinelake.session import is_local

BLANKS = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(F.regexp_replace(text, BLANKS, " "), F.lit("")).cast("binary"), 256)


def refuse_local_warehouse(master: str, folder: str) -> None:
    """On a cluster the index can't stand in Spark's default, the driver's working folder, which executors don't share."""
    default = f"{os.getcwd()}/spark-warehouse"
    if not is_local(master) and folder.removeprefix("file:").replace("///", "/").rstrip("/") == default:
        raise ValueError("set spark.sql.warehouse.dir to a folder that the driver and all executors share")


class DigestIndex:
    """The persistent index. ``buckets`` should keep a bucket within an executor's sort memory. Its files stand in the warehouse, or in ``folder``, which ``drop`` then deletes as well."""

    def __init__(self, spark: SparkSession, table: str, id_type: T.DataType | None = None, buckets: int = 64, folder: str | None = None):
        self.spark, self.table, self.buckets, self.folder = spark, table, buckets, folder
        if not folder:
            refuse_local_warehouse(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir"))
        if not spark.catalog.tableExists(table):
            # Not by createDataFrame, whose rows come through RDD workers in Python, which executors keep for a minute beside those of Arrow steps.
            kinds = {"digest": T.StringType(), "first_id": id_type or T.LongType(), "batch": T.StringType()}
            self._append(spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append")
        if self.folder:
            writer = writer.option("path", self.folder)
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Append the digests of ``groups`` (digest, first_id) that the index lacks; returns those, and those that ``batch`` appended in an earlier run."""
        offered = groups.select("digest", "first_id").repartition(self.buckets, "digest")
        index, own = self.read().select("digest", "batch"), F.col("batch") == batch
        fresh = materialise(offered.join(index.where(~own).select("digest").hint("merge"), "digest", "left_anti"), "fresh")
        missing = fresh.repartition(self.buckets, "digest").join(index.where(own).select("digest").hint("merge"), "digest", "left_anti")
        self._append(missing.withColumn("batch", F.lit(batch)))
        return fresh


def first_id(column: Column) -> Column:
    """Aggregate: the smallest id, nulls last."""
    return F.min(F.struct(column.isNull().alias("none"), column.alias("id")))["id"]


def digest_groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, copies) for each distinct pair, and (digest, first_id, group_size) for each digest."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    members = materialise(hashed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    groups = members.groupBy("digest").agg(first_id(F.col("doc_id")).alias("first_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("members"))
    return members, materialise(groups, "digest-groups")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row a document of the batch: doc_id, keep_id, group_size (in the batch), kept, digest.

    keep_id is the id that the index holds for the text: one from an earlier batch
    if there is one, and then no row of this batch is kept. A run that repeats a failed one
    gives the same ``batch``.
    """
    members, groups = digest_groups(docs, id_col, text_col)
    total = members.count()
    fresh = index.add(groups, batch or uuid.uuid4().hex).select("digest", F.lit(True).alias("is_fresh"))
    known = index.read().select("digest", "first_id").hint("merge").withColumnRenamed("first_id", "keep_id")
    resolved = groups.join(fresh, "digest", "left").join(known, "digest")
    rows = join_hot_split(members, resolved, ["digest"], "members", total)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.coalesce(F.col("is_fresh"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that deduplicate() keeps, all columns unchanged. Texts are moved once, to their own digest's partition."""
    _, groups = digest_groups(docs, id_col, text_col)
    fresh = index.add(groups, batch or uuid.uuid4().hex).select(F.col("digest").alias("_digest"), F.col("first_id").alias("_first"))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), digest(F.col(f"`{text_col}`")).alias("_digest"))
    own = carried.join(fresh, (carried["_digest"] == fresh["_digest"]) & carried["_id"].eqNullSafe(fresh["_first"]), "left_semi")
    return own.dropDuplicates(["_digest", "_id"]).select("_row.*")


def scratch_index(spark: SparkSession, id_type: T.DataType | None = None, buckets: int | None = None) -> DigestIndex:
    """An empty index of its own name, for a run that starts from nothing; its files stand with the scratch tables, so no warehouse is needed."""
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    return DigestIndex(spark, name, id_type, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name))
