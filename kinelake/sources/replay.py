"""Replay files: fifteen columns in fixed order; validation as rules over rows, and events for streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.schema import REPLAY_COLUMNS, REPLAY_NULLABLE, replay_schema

GYRO_LIMIT = 10.0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): every line of every file, line 0 the header, with its own line end left out."""
    whole = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    return whole.select("path", F.posexplode(lines).alias("line", "text"))


def parse(lines: DataFrame) -> DataFrame:
    """(path, line, n_fields, raw fields) of the rows below the header."""
    cells = F.split("text", ",", -1)
    return lines.where("line > 0").select("path", "line", F.size(cells).alias("n_fields"), *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(REPLAY_COLUMNS)])


def violations(lines: DataFrame, mode: str = "lenient") -> DataFrame:
    """(path, line, rule) for every rule a line breaks.

    ``strict`` also wants rising timestamps (not only non-falling), a rotation under the limit
    (not up to it), whole numbers of milliseconds, and all four position fields of a valid fix.
    """
    strict = mode == "strict"
    found = []
    head = lines.where("line = 0")
    found.append(head.where(F.col("text").startswith("﻿")).select("path", "line", F.lit("byte_order_mark").alias("rule")))
    found.append(lines.where(F.col("text").contains("\r")).select("path", "line", F.lit("carriage_return").alias("rule")))
    found.append(head.where(F.regexp_replace("text", "[﻿\r]", "") != ",".join(REPLAY_COLUMNS)).select("path", "line", F.lit("columns").alias("rule")))
    rows = parse(lines.withColumn("text", F.regexp_replace("text", "\r", "")))
    number = {c: F.col(c).try_cast("bigint" if c == "timestamp_ms" and strict else "double") for c in REPLAY_COLUMNS}
    time = F.col("timestamp_ms").try_cast("double")
    rows = rows.withColumn("before", F.lag(time).over(W.partitionBy("path").orderBy("line")))
    before = F.col("before")
    fix = [F.col(c) != "" for c in REPLAY_NULLABLE]
    any_fix = fix[0] | fix[1] | fix[2] | fix[3]
    all_fix = fix[0] & fix[1] & fix[2] & fix[3]
    spin = [F.abs(number[c]) for c in ("gyro_x", "gyro_y", "gyro_z")]
    over = [(s >= GYRO_LIMIT) if strict else (s > GYRO_LIMIT) for s in spin]
    valid = number["gnss_valid"]

    def anywhere(columns: list[str], test) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(test(c), F.lit(False))
        return out

    needed = [c for c in REPLAY_COLUMNS if c not in REPLAY_NULLABLE]
    rules = {
        "field_count": F.col("n_fields") != len(REPLAY_COLUMNS),
        "empty_field": anywhere(needed, lambda c: F.col(c) == ""),
        "not_a_number": anywhere(REPLAY_COLUMNS, lambda c: (F.col(c) != "") & number[c].isNull()),
        "not_finite": anywhere(REPLAY_COLUMNS, lambda c: F.isnan(F.col(c).try_cast("double")) | (F.abs(F.col(c).try_cast("double")) == float("inf"))),
        "gnss_valid": ~valid.isin(0, 1),
        "fix_without_valid": (valid == 0) & any_fix,
        "rotation": over[0] | over[1] | over[2],
        "time_order": (time <= before) if strict else (time < before),
    }
    if strict:
        rules["valid_without_fix"] = (valid == 1) & ~all_fix
        for c, low, high in (("gnss_lat", -90, 90), ("gnss_lon", -180, 180), ("gnss_course_deg", 0, 360)):
            rules[f"{c}_range"] = (F.col(c) != "") & ~number[c].between(low, high)
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    found.append(rows.select("path", "line", F.explode(broken).alias("rule")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def load(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Typed rows with path and row_idx; a file that breaks a rule raises with the first few places."""
    lines = read_lines(spark, path)
    bad = violations(lines, mode).orderBy("path", "line").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path'].rsplit('/', 1)[-1]}:{r['line'] + 1} {r['rule']}" for r in bad))
    typed = [F.expr(f"try_cast(nullif(`{f.name}`, '') AS {f.dataType.simpleString()})").alias(f.name) for f in replay_schema()]
    return parse(lines).select("path", (F.col("line") - 1).cast("long").alias("row_idx"), *typed)


def events(rows: DataFrame) -> DataFrame:
    """Sensor events of each row, in the order accelerometer, gyroscope, magnetometer, fix; rows without a fix give three."""

    def event(order: int, kind: str, columns: list[str]) -> Column:
        values = [F.col(c).cast("double") for c in columns]
        return F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), F.array(*values).alias("values"))

    listed = F.array(
        event(0, "accelerometer", ["accel_x", "accel_y", "accel_z"]),
        event(1, "gyroscope", ["gyro_x", "gyro_y", "gyro_z"]),
        event(2, "magnetometer", ["mag_x", "mag_y", "mag_z"]),
        F.when(F.col("gnss_valid") == 1, event(3, "gnss_fix", ["gnss_lat", "gnss_lon", "gnss_speed_mps", "gnss_course_deg"])),
    )
    kept = rows.withColumn("e", F.explode(F.filter(listed, lambda e: e.isNotNull())))
    carried = [c for c in rows.columns if c not in REPLAY_COLUMNS]
    return kept.select(*carried, (F.col("timestamp_ms") * 1_000_000).alias("ns"), "e.ord", "e.kind", "e.values")


def event_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"))


def sample_rows(spark: SparkSession, rows: int = 30, out_from: int = 10, out_to: int = 20) -> DataFrame:
    """A made-up replay at 10 Hz with an outage in the middle."""
    i = F.col("id")
    fix = (i < out_from) | (i >= out_to)
    return spark.range(rows).select(
        (F.lit(1_700_000_000_000) + i * 100).alias("timestamp_ms"),
        *[F.lit(v).alias(c) for c, v in zip(REPLAY_COLUMNS[1:10], (0.1, 0.0, 9.81, 0.0, 0.0, 0.01, 20.0, 5.0, -40.0), strict=True)],
        fix.cast("int").alias("gnss_valid"),
        F.when(fix, 53.0 + i * 1e-6).alias("gnss_lat"),
        F.when(fix, -1.5 + i * 1e-6).alias("gnss_lon"),
        F.when(fix, 10.0).alias("gnss_speed_mps"),
        F.when(fix, 45.0).alias("gnss_course_deg"),
    )


def write(rows: DataFrame, path: str) -> None:
    """As CSV in the contract's columns and order, empty fields for nulls; files have a million rows at most, as they are read whole."""
    rows.select(*REPLAY_COLUMNS).write.option("header", "true").option("emptyValue", "").option("maxRecordsPerFile", 1_000_000).csv(path)
