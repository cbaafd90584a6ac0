"""Unit conversions, angles, the normal distribution, identifiers and versions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.nanops import col, finite

GRAVITY = 9.80665
EARTH_RADIUS_M = 6_371_000.0


def kmh_to_mps(c) -> Column:
    return col(c) / 3.6


def g_to_mps2(c) -> Column:
    return col(c) * GRAVITY


def deg_to_rad(c) -> Column:
    return F.radians(col(c))


def km_to_m(c) -> Column:
    return col(c) * 1000.0


def magnitude(x, y, z) -> Column:
    x, y, z = col(x), col(y), col(z)
    return F.sqrt(x * x + y * y + z * z)


def angle_gap_deg(a, b) -> Column:
    """Absolute difference of two headings, at most 180."""
    return F.abs(F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0)


def wrapped_rad(delta) -> Column:
    """A difference of unwrapped angles: the nearest to zero."""
    delta = col(delta)
    return delta - 2 * math.pi * F.rint(delta / (2 * math.pi))


def erf(x) -> Column:
    """Error function by the rational approximation of Abramowitz and Stegun, 7.1.26."""
    x = col(x)
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z) -> Column:
    return 0.5 * (1.0 + erf(col(z) / math.sqrt(2.0)))


def erf_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    return f"(sign({x}) * (1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}))))"


def satellites(c) -> Column:
    """The first number of text such as "16 / 18"."""
    return F.expr(f"try_cast(trim(split(`{c}`, '/')[0]) AS double)")


def header_key(c) -> Column:
    """Header text for comparison: ASCII, lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[^\x00-\x7F]", ""), r"\s+", " ")))


def holdout_bucket(c) -> Column:
    """The bytes of an id as a little-endian number, modulo 1000."""
    digits = F.reverse(F.split(F.hex(col(c)), "(?<=\\G..)"))
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 256 + F.conv(d, 16, 10).cast("long")) % 1000)


def semver_at_least(version, least: str) -> Column:
    """Same major version, and minor and patch not below; malformed versions fail."""
    major, minor, patch = (int(x) for x in least.split("."))
    v = col(version)
    parts = F.split(v, "\\.").cast("array<int>")
    fine = F.coalesce(v.rlike(r"^\d{1,9}\.\d{1,9}\.\d{1,9}$"), F.lit(False))
    return F.when(fine, (parts[0] == major) & ((parts[1] > minor) | ((parts[1] == minor) & (parts[2] >= patch)))).otherwise(False)


def epoch_ms(monotonic_ns, anchor_ns, anchor_ms) -> Column:
    """Unix milliseconds of a monotonic clock, from one moment known on both clocks."""
    gap = (col(monotonic_ns) - col(anchor_ns)).cast("long")
    return col(anchor_ms) + (gap / F.lit(1_000_000)).cast("long")


def epoch_us(ts) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def gyro_sanity(samples: DataFrame, value: str, by: list[str], limit: float = 10.0, hard: bool = False) -> DataFrame:
    """Per group: largest and 99.5 % quantile of |value|, how many spike over the limit, and whether the group is sane."""
    size = F.abs(F.when(finite(value), F.col(value)))
    out = samples.groupBy(*by).agg(F.max(size).alias("largest"), F.percentile(size, 0.995).alias("p995"), F.count_if(size >= limit).alias("spikes"))
    return out.withColumn("sane", F.coalesce((F.col("largest") if hard else F.col("p995")) < limit, F.lit(True)))


def range_sanity(samples: DataFrame, value: str, by: list[str], limit: float) -> DataFrame:
    """Per group: largest |value| and whether it is below the limit (accelerations 100, wheel rates 400)."""
    size = F.abs(F.when(finite(value), F.col(value)))
    return samples.groupBy(*by).agg(F.max(size).alias("largest")).withColumn("sane", F.coalesce(F.col("largest") < limit, F.lit(True)))
