"""Sun positions by the low-precision solar formulas, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The observer and the anchor moments of the sun table.
LAT, LON, YEAR, DAY, ZONE = 40.696, -73.970, 2026, 15, "America/New_York"


def position(utc_seconds: Column, lat: float = LAT, lon: float = LON) -> tuple[Column, Column]:
    """Azimuth from north and refracted elevation, both in degrees, at a UTC epoch second."""
    t = (utc_seconds / 86400.0 + 2440587.5 - 2451545.0) / 36525.0
    mean_lon = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(mean_lon + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(apparent))
    y = F.pow(F.tan(tilt / 2), 2)
    l2 = F.radians(mean_lon)
    eq = 4 * F.degrees(y * F.sin(2 * l2) - 2 * ecc * F.sin(anomaly) + 4 * ecc * y * F.sin(anomaly) * F.cos(2 * l2) - 0.5 * y * y * F.sin(4 * l2) - 1.25 * ecc * ecc * F.sin(2 * anomaly))
    minutes = F.pmod(F.pmod(utc_seconds, F.lit(86400)) / 60.0 + eq + 4 * lon, F.lit(1440.0))
    hour = F.radians(minutes / 4 - 180)
    phi = F.radians(F.lit(lat))
    up = F.degrees(F.asin(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour)))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180, F.lit(360.0))
    tan = F.tan(F.radians(up))
    bend = F.when(up > 85, 0.0).when(up > 5, 58.1 / tan - 0.07 / F.pow(tan, 3) + 0.000086 / F.pow(tan, 5))
    bend = bend.when(up > -0.575, 1735 + up * (-518.2 + up * (103.4 + up * (-12.79 + up * 0.711)))).otherwise(-20.774 / tan)
    return azimuth, up + bend / 3600.0


def sun_table(spark: SparkSession) -> DataFrame:
    """month, hour, slot, azimuth, elevation for 12 x 24 anchors; null at night."""
    grid = spark.range(288).select((F.col("id") / 24).cast("int").alias("m"), (F.col("id") % 24).cast("int").alias("hour"), F.col("id").alias("slot"))
    local = F.make_timestamp_ntz(F.lit(YEAR), F.col("m") + 1, F.lit(DAY), F.col("hour"), F.lit(0), F.lit(0))
    utc = F.unix_seconds(F.to_utc_timestamp(local.cast("timestamp"), ZONE))
    azimuth, elevation = position(utc)
    rows = grid.select((F.col("m") + 1).alias("month"), "hour", "slot", F.round(azimuth, 3).alias("azimuth"), F.round(elevation, 3).alias("elevation"))
    day = F.col("elevation") > 0
    return rows.select("month", "hour", "slot", F.when(day, F.col("azimuth")).alias("azimuth"), F.when(day, F.col("elevation")).alias("elevation"))
