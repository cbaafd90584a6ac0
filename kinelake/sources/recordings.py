"""Recordings of phone and vehicle: single-byte CSV files with irregular headers, bound by position.

Row order matters and CSV has no row index, so each stretch of a file that Spark reads at once is parsed in its order, and its rows are numbered from the
rows of the stretches before it; no task holds a file. The result belongs in Parquet, partitioned for later scans.
"""

from __future__ import annotations

import csv
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake import schema
from kinelake.functions.nanops import finite
from kinelake.functions.scalar import satellites
from kinelake.session import shared_path

MISSING = ("", "NaN", "nan")
#: Smallest size of a file worth reading, as a pair's discovery has it.
LEAST_BYTES = 1024


#: Rows that a task hands on at once.
ROWS_AT_ONCE = 4096
PARSED = "path string, block long, at long, cells array<string>"
KEY = ["path", "block"]


def of_names(found: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds path, name, folder and kind (S for phone and V for vehicle files, by the name's first letter) from a file source's metadata; other files, and too small ones, go."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = found.where(F.col("_metadata.file_size") > least).withColumn("path", path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    kind = F.upper(F.regexp_extract("name", r"(?i)^([sv])-.*\.csv$", 1))
    return named.withColumn("kind", kind).withColumn("folder", F.element_at(F.split("path", "/"), -2)).where("kind <> ''")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, folder, kind, name) of the files worth reading; their contents aren't read."""
    return of_names(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).select("path", "length", "folder", "kind", "name")


def parsed(lines: Iterable[bytes], encoding: str = "cp1252") -> Iterator[list[str]]:
    return csv.reader((line.decode(encoding) for line in lines), skipinitialspace=True)


def filled(row: list[str]) -> bool:
    return any(x.strip() for x in row)


def tidy(row: list[str]) -> list[str | None]:
    return [None if x.strip() in MISSING else x.strip() for x in row]


class Stretch:
    """What one stretch of a file shows: its header if it is the first, how many rows it has, which columns have values, a quote that a line leaves open, an error."""

    def __init__(self):
        self.header, self.rows, self.used, self.unused, self.opened, self.error = None, 0, set(), [], False, None

    def take(self, row: list[str]) -> None:
        if not filled(row):
            return
        self.rows += 1
        self.unused += range(len(self.used) + len(self.unused), len(row))
        if new := [i for i in self.unused if i < len(row) and row[i].strip() not in MISSING]:
            self.used |= set(new)
            self.unused = [i for i in self.unused if i not in self.used]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(path, block, lines): the lines of a batch, cut where the file or its stretch ends."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "block", "line"))
        for (path, block), group in itertools.groupby(zip(*columns, strict=True), key=lambda r: r[:2]):
            yield path, block, [r[2] for r in group]


def survey(lines: DataFrame) -> DataFrame:
    """(path, block, header, n, used, opened, error) for each stretch of each file."""

    def run(batches):
        seen: dict[tuple[str, int], Stretch] = {}
        for path, block, some in runs(batches):
            first = (path, block) not in seen
            found = seen.setdefault((path, block), Stretch())
            found.opened |= any(line.count(b'"') % 2 for line in some)
            try:
                rows = parsed(some)
                if first and block == 0:
                    found.header = [h.strip() for h in next(rows)]
                for row in rows:
                    found.take(row)
            except UnicodeDecodeError as e:
                found.error = found.error or str(e)[:200]
            except csv.Error as e:  # with an open quote the lines aren't records yet
                found.error = found.error or (None if found.opened else str(e)[:200])
        for (path, block), f in seen.items():
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "header": f.header, "n": f.rows, "used": sorted(f.used), "opened": f.opened, "error": f.error}], SURVEYED)

    return lines.select(*KEY, "line").mapInArrow(run, "path string, block long, header array<string>, n long, used array<int>, opened boolean, error string")


SURVEYED = pa.schema([("path", pa.string()), ("block", pa.int64()), ("header", pa.list_(pa.string())), ("n", pa.int64()), ("used", pa.list_(pa.int32())), ("opened", pa.bool_()), ("error", pa.string())])


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(path, block, at, cells) as Arrow batches of bounded size."""
    for some in itertools.batched(rows, ROWS_AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["path", "block", "at", "cells"])


def rows_of_stretches(lines: DataFrame) -> DataFrame:
    """(path, block, at, cells): the rows of each stretch, numbered within it; every line is a record."""

    def rows(batches):
        counts: dict[tuple[str, int], int] = {}
        for path, block, some in runs(batches):
            first = (path, block) not in counts
            at = counts.get((path, block), 0)
            for row in itertools.islice(parsed(some), int(first and block == 0), None):
                if filled(row):
                    yield path, block, at, tidy(row)
                    at += 1
            counts[path, block] = at

    return lines.select(*KEY, "line").mapInArrow(lambda batches: batches_of(rows(batches)), PARSED)


def rows_across_lines(lines: DataFrame) -> DataFrame:
    """The same for files with records over several lines: a file's lines pass one task in order, which holds a record at a time."""

    def rows(batches):
        flat = ((path, line) for path, _, some in runs(batches) for line in some)
        for path, group in itertools.groupby(flat, key=lambda r: r[0]):
            body = itertools.islice(parsed(line + b"\n" for _, line in group), 1, None)
            for at, row in enumerate(r for r in body if filled(r)):
                yield path, 0, at, tidy(row)

    ordered = lines.repartition("path").sortWithinPartitions("path", "block", "at").select(*KEY, "line")
    return ordered.mapInArrow(lambda batches: batches_of(rows(batches)), PARSED)


def load_text(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of the files of a kind: rows (path, row_idx, cells) and heads (path, header, n, error).

    Blanks after commas, rows without a value, and trailing columns without a name or value go. A file that can't be decoded has an error and no rows.
    """
    text = of_names(spark.read.option("recursiveFileLookup", "true").text(path)).where(F.col("kind") == kind)
    lines = text.select("path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    # A few values a stretch, which every part of the plan below needs; written, they are found once.
    surveyed = shared_path(spark, "survey")
    survey(lines).write.parquet(surveyed)
    found = spark.read.schema(survey(lines).schema).parquet(surveyed)
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = found.select(*KEY, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    raw = F.coalesce(F.max("header"), F.array().cast("array<string>"))  # the first stretch alone has one
    used = F.filter(F.flatten(F.collect_list("used")), lambda i: i < F.size(raw))
    named = F.filter(F.transform(raw, lambda h, i: F.when(h != "", i + 1).otherwise(0)), lambda i: i > 0)
    wide = F.greatest(F.coalesce(F.array_max(named), F.lit(0)), F.coalesce(F.array_max(used) + 1, F.lit(0)))
    heads = found.groupBy("path").agg(F.slice(raw, F.lit(1), wide).alias("header"), F.sum("n").alias("n"), F.min("error").alias("error"), F.max("opened").alias("opened"))
    fine = F.broadcast(heads.where("error is null").select("path", "header", "opened"))
    plain = rows_of_stretches(lines.join(fine.where(~F.col("opened")).select("path"), "path", "left_semi")).join(F.broadcast(before), KEY).select("path", (F.col("at") + F.col("before")).alias("row_idx"), "cells")
    across = rows_across_lines(lines.join(fine.where("opened").select("path"), "path", "left_semi")).select("path", F.col("at").alias("row_idx"), "cells")
    rows = plain.unionByName(across).join(fine.select("path", "header"), "path").select("path", "row_idx", F.slice("cells", F.lit(1), F.size("header")).alias("cells"))
    return rows, heads.drop("opened")


def expected_columns(kind: str) -> list[list[str]]:
    return [schema.PHONE_COLUMNS, schema.PHONE_COLUMNS_REDUCED] if kind == "S" else [schema.VEHICLE_COLUMNS]


def bind(rows: DataFrame, heads: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected): cells bound by position as doubles, unparsable ones NaN; files of another width are rejected with a reason.

    Phone files without the last six columns get NaN there, so both forms are one table.
    """
    widths = [len(c) for c in expected_columns(kind)]
    fine = F.col("error").isNull() & F.size("header").isin(widths)
    reason = F.coalesce("error", F.concat(F.lit("columns: "), F.size("header").cast("string")))
    rejected = heads.where(~fine & ((F.col("n") > 0) | F.col("error").isNotNull())).select("path", reason.alias("reason"))
    nan = F.lit(float("nan"))

    def cell(i: int, name: str):
        text = F.get("cells", F.lit(i))
        return (text if name in ("date_local_raw", "gps_sats") else F.coalesce(text.try_cast("double"), nan)).alias(name)

    samples = rows.join(F.broadcast(heads.where(fine).select("path")), "path", "left_semi").select("path", "row_idx", *[cell(i, n) for i, n in enumerate(expected_columns(kind)[0])])
    return samples.withColumn("gps_sats", F.coalesce(satellites("gps_sats"), nan)), rejected


def to_si(samples: DataFrame, kind: str) -> DataFrame:
    """Speeds from km/h, accelerations of the vehicle from g, headings kept in degrees: the one place where units change."""
    factors = {"gps_speed_mps": 1 / 3.6} if kind == "S" else {"speed_mps": 1 / 3.6, "indicated_speed_mps": 1 / 3.6, "vertical_velocity_mps": 1 / 3.6, "long_accel_mps2": 9.80665, "lat_accel_mps2": 9.80665}
    out = samples
    for name, factor in factors.items():
        out = out.withColumn(name, F.col(name) * factor)
    return out.withColumn("yaw_rate_radps", F.radians("yaw_rate_radps")) if kind == "V" else out


def sequence_ids(found: DataFrame) -> DataFrame:
    """(folder, seq_id, path_s, path_v): folders with a phone and a vehicle file, the first of each; equal ids get the folder's name appended."""
    pairs = found.groupBy("folder").agg(F.min(F.when(F.col("kind") == "S", F.col("path"))).alias("path_s"), F.min(F.when(F.col("kind") == "V", F.col("path"))).alias("path_v")).where("path_s is not null and path_v is not null")
    stem = F.regexp_replace(F.lower(F.regexp_extract("path_s", r"(?i)/s-([^/]*)\.csv$", 1)), "[^a-z0-9]", "")
    twins = pairs.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    named = pairs.withColumn("stem", stem).join(twins, "stem")
    return named.select("folder", F.when(F.col("n") > 1, F.concat_ws("_", "stem", F.lower("folder"))).otherwise(F.col("stem")).alias("seq_id"), "path_s", "path_v").orderBy("seq_id")


def load_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phone, vehicle, rejected): samples with seq_id and row_idx, in SI units, and files that don't fit."""
    found = files(spark, path)
    ids = sequence_ids(found)
    out, bad = [], []
    for kind, column in (("S", "path_s"), ("V", "path_v")):
        samples, rejected = bind(*load_text(spark, path, kind), kind)
        out.append(to_si(samples, kind).join(F.broadcast(ids.select("seq_id", F.col(column).alias("path"))), "path").drop("path"))
        bad.append(rejected)
    return out[0], out[1], bad[0].unionByName(bad[1])


def load_phone_only(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(phone, rejected): samples, in SI units, of phone files without a vehicle's, and files that don't fit, which don't stop the rest.

    The seq_id is the file's name after ``S-`` in small letters and digits; files of equal names in several folders get the folder's appended.
    """
    samples, rejected = bind(*load_text(spark, path, "S"), "S")
    stem = F.regexp_replace(F.lower(F.regexp_extract("path", r"(?i)/s-([^/]*)\.csv$", 1)), "[^a-z0-9]", "")
    # Names come from the list of files, so that samples are read once; rejected files count as twins only of fitting ones that they are not.
    fitting = files(spark, path).where("kind = 'S'").join(rejected.select("path"), "path", "left_anti").select("path", stem.alias("stem"), F.lower("folder").alias("folder"))
    twins = fitting.groupBy("stem").agg((F.count(F.lit(1)) > 1).alias("twin"))
    seq_id = F.when(F.col("twin"), F.concat_ws("_", "stem", "folder")).otherwise(F.col("stem"))
    ids = fitting.join(twins, "stem").select("path", seq_id.alias("seq_id"))
    return to_si(samples, "S").join(F.broadcast(ids), "path").drop("path"), rejected


#: Below which accelerations (m/s2) and wheel rates (rad/s) are credible.
ACCEL_LIMIT, WHEEL_LIMIT = 100.0, 400.0
GYRO = ("gyro_yaw_radps", "gyro_pitch_radps", "gyro_roll_radps")
ACCEL = ("accel_x_mps2", "accel_y_mps2", "accel_z_mps2")
WHEELS = ("wheel_fl_radps", "wheel_fr_radps", "wheel_rl_radps", "wheel_rr_radps")


def sanity(phone: DataFrame | None, vehicle: DataFrame | None = None) -> DataFrame:
    """(seq_id, column, largest, spikes, sane): each sequence's turn rates (99.5 % of them below 10 rad/s; spikes are counted), accelerations, and wheel rates against what is credible.

    A unit that was taken for another shows here: degrees for radians, g for m/s2. Sequences without a finite value in a column are sane there.
    """
    checks = []
    for samples, columns, limit, soft in ((phone, GYRO, 10.0, True), (phone, ACCEL, ACCEL_LIMIT, False), (vehicle, WHEELS, WHEEL_LIMIT, False)):
        if samples is not None:
            checks += [(samples, [(c, limit, soft) for c in columns])]
    if phone is not None:  # all of a stream's columns in one pass
        checks[:2] = [(phone, checks[0][1] + checks[1][1])]
    found = []
    for samples, columns in checks:
        totals = samples.groupBy("seq_id").agg(*[credible(c, limit, soft).alias(c) for c, limit, soft in columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("said")) for c, _, _ in columns])).alias("e")
        found.append(totals.select("seq_id", each).select("seq_id", "e.column", "e.said.*"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def credible(value: str, limit: float, soft: bool, share: float = 0.995) -> Column:
    """Aggregate (largest, spikes, sane): sane if the largest |value| is below the limit or, if ``soft``, its ``share`` quantile is; spikes are counted for soft limits.

    Whether the quantile (between two values, linearly) is below the limit follows from how many values are, the largest of those and the
    smallest of the others, so nothing is sorted or kept.
    """
    size = F.abs(F.when(finite(value), F.col(value)))
    largest = F.max(size)
    if not soft:
        return F.struct(largest.alias("largest"), F.lit(None).cast("long").alias("spikes"), F.coalesce(largest < limit, F.lit(True)).alias("sane"))
    place, below = (F.count(size) - 1) * share, F.count_if(size < limit)
    between = (F.ceil(place) - place) * F.max(F.when(size < limit, size)) + (place - F.floor(place)) * F.min(F.when(size >= limit, size))
    sane = F.when(F.ceil(place) < below, True).when(F.floor(place) >= below, False).otherwise(between < limit)
    return F.struct(largest.alias("largest"), F.count_if(size >= limit).alias("spikes"), F.when(F.count(size) == 0, True).otherwise(sane).alias("sane"))


def load_checked_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(phone, vehicle, rejected, insane): ``load_pairs`` without the sequences of which a column isn't credible; those and their columns are ``insane``."""
    phone, vehicle, rejected = load_pairs(spark, path)
    insane = sanity(phone, vehicle).where(~F.col("sane"))
    bad = insane.select("seq_id").distinct()
    return phone.join(bad, "seq_id", "left_anti"), vehicle.join(bad, "seq_id", "left_anti"), rejected, insane


def header_warnings(heads: DataFrame, titles: list[str]) -> DataFrame:
    """(path, position, found, expected) where a header's text differs from the expected one; binding goes by position all the same."""
    clean = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]", "", s)).strip().lower()
    found = heads.where("n > 0").select("path", F.posexplode("header").alias("position", "found"))
    want = heads.sparkSession.createDataFrame([(i, clean(t)) for i, t in enumerate(titles)], "position int, expected string")
    tidy = F.lower(F.trim(F.regexp_replace(F.regexp_replace("found", r"[^\x00-\x7F]", ""), r"\s+", " ")))
    return found.join(F.broadcast(want), "position").where(tidy != F.col("expected"))
