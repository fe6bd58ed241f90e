"""Whole files as tables: GeoJSON features, box scans that reach the files, and tables that are fetched once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Polygons of GeoJSON files: the properties (a schema text) and polygon, an array of rings of [lon, lat]; one row a part.

    Features without a usable polygon are left out.
    """
    shape = f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{properties}>>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.geometry.*", "f.properties.*")
    one, many = F.from_json("coordinates", "array<array<array<double>>>"), F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("type") == "Polygon", F.array(one)).when(F.col("type") == "MultiPolygon", many)
    names = [c for c in rows.columns if c not in ("type", "coordinates")]
    out = rows.select(*names, F.explode(parts).alias("polygon"))
    return out.where((F.size("polygon") > 0) & F.forall("polygon", lambda r: F.size(r) > 2))


def scan_box(spark: SparkSession, path: str, columns: list[str], west: float, south: float, east: float, north: float) -> DataFrame:
    """Columns of the rows whose lon and lat lie in a box, bounds included; both reach the Parquet scan."""
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return spark.read.parquet(path).where(inside).select(*columns)


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``; made by ``fetch`` and written if it is not there yet or is to be made anew."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_findings(rows: DataFrame, path: str, lon: str, lat: str) -> None:
    """Points of an audit as lines of GeoJSON features, with the other columns as properties."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    others = F.struct(*(c for c in rows.columns if c not in (lon, lat)))
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), others.alias("properties"))).alias("value")).write.mode("overwrite").text(path)
