"""Constraints as data: checks, keys and references of tables, and the rows that break them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """An SQL condition over a row's columns. As in a database a row breaks it if it is false; unknown (null) passes."""

    name: str
    condition: str


@dataclass(frozen=True)
class Key:
    """Columns whose values identify a row: not null together with another row's, and none null."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Columns whose values are those of a row of another table; a null passes."""

    name: str
    columns: tuple[str, ...]
    table: str
    target: tuple[str, ...]


Constraint = Check | Key | Reference
#: Rows whose keys one task counts, about.
KEY_ROWS = 500_000
#: Modes of navigation and how labels come about.
MODES = ("GNSS", "GNSS_DEGRADED", "DR", "REACQUIRING", "CALIBRATING")
#: The relational schema of trips: what each table's rows must be.
TRIP_SCHEMA: dict[str, tuple[Constraint, ...]] = {
    "trip": (Key("trip_key", ("trip_id",)), Check("trip_order", "ended_ns >= started_ns"), Check("trip_consent", "uploaded = false OR consent = true")),
    "pose": (
        Key("pose_key", ("trip_id", "ns")),
        Reference("pose_trip", ("trip_id",), "trip", ("trip_id",)),
        Check("pose_lat", "lat_deg BETWEEN -90 AND 90"),
        Check("pose_lon", "lon_deg BETWEEN -180 AND 180"),
        Check("pose_heading", "heading_deg >= 0 AND heading_deg < 360"),
        Check("pose_speed", "speed_mps BETWEEN 0 AND 100"),
        Check("pose_sigma", "sigma_m > 0"),
        Check("pose_mode", f"mode IN {MODES}"),
    ),
    "mode_event": (Reference("mode_event_trip", ("trip_id",), "trip", ("trip_id",)), Check("mode_event_modes", f"from_mode IN {MODES} AND to_mode IN {MODES}"), Check("mode_event_changes", "from_mode <> to_mode")),
    "label_pair": (Reference("label_pair_trip", ("trip_id",), "trip", ("trip_id",)), Check("label_pair_window", "stop_ns > start_ns"), Check("label_pair_sigma", "label_sigma > 0")),
    "mag_signature": (Key("mag_signature_key", ("way_id", "arc_m")), Check("mag_signature_arc", "arc_m >= 0"), Check("mag_signature_field", "field_ut BETWEEN 0 AND 1000")),
}


def _dealt(keys: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys in as many parts as their number asks for, before they are counted: nearly all are distinct, so a task holds a count for each of its rows."""
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // KEY_ROWS))
    return keys.repartition(parts, *columns)


def violations(tables: dict[str, DataFrame], constraints: dict[str, tuple[Constraint, ...]], id_cols: dict[str, list[str]]) -> DataFrame:
    """(table_name, constraint, id): one row for each row and constraint that it breaks; id is the row's id columns joined by commas, nulls as empty.

    All checks of a table, and whether its keys' columns are null, are found in one pass without a shuffle. A key's duplicates come from counting (each of the duplicates breaks it), a
    reference's missing targets from an anti join with the distinct targets.
    """
    unknown = {c.table for cs in constraints.values() for c in cs if isinstance(c, Reference)} - tables.keys() | constraints.keys() - tables.keys()
    if unknown:
        raise ValueError(f"no table {sorted(unknown)}")
    found = []
    for name, rules in constraints.items():
        rows = tables[name]
        # nulls as empty texts, so that every id has all its columns
        row_id = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols[name]])
        plain = [F.when(~F.expr(r.condition), F.lit(r.name)) for r in rules if isinstance(r, Check)]
        plain += [F.when(F.greatest(*[F.col(c).isNull() for c in (*r.columns, *r.columns)]), F.lit(r.name)) for r in rules if isinstance(r, Key)]
        if plain:
            broken = F.filter(F.array(*plain), lambda x: x.isNotNull())
            found.append(rows.select(row_id.alias("id"), F.explode(broken).alias("constraint")).select(F.lit(name).alias("table_name"), "constraint", "id"))
        for r in rules:
            if isinstance(r, Key):
                twice = _dealt(rows.dropna(subset=list(r.columns)).select(*r.columns), r.columns).groupBy(*r.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*r.columns)
                found.append(rows.join(twice, list(r.columns), "left_semi").select(F.lit(name).alias("table_name"), F.lit(r.name).alias("constraint"), row_id.alias("id")))
            elif isinstance(r, Reference):
                targets = tables[r.table].select(*[F.col(t).alias(c) for t, c in zip(r.target, r.columns, strict=True)]).distinct()
                lost = rows.dropna(subset=list(r.columns)).join(targets, list(r.columns), "left_anti")
                found.append(lost.select(F.lit(name).alias("table_name"), F.lit(r.name).alias("constraint"), row_id.alias("id")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
