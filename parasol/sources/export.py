"""The graph's export: Parquet tables, a compatible JSON form, and reading them back checked."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_export(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes with six decimals; edges without empty fold names or shade rows of zeros.

    Both tables are written to a folder of their own; a row that points to it is
    added last, so readers see both of one export or both of
    the one before.
    """
    version = f"{path}/v-{uuid.uuid4().hex}"
    nodes.select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")).write.parquet(f"{version}/nodes")
    shade = F.when(F.col("building_shade").rlike(r"[^\x00]") if dict(edges.dtypes)["building_shade"] == "string" else F.ltrim(F.hex("building_shade"), F.lit("0")) != "", F.col("building_shade"))
    names = F.when(F.size("fold_names") > 0, F.slice("fold_names", 1, 3))
    ready = edges.withColumn("building_shade", shade).withColumn("fold_names", names).withColumn("tree_park_canopy", F.round("tree_park_canopy", 3))
    ready.write.parquet(f"{version}/edges")
    spark = nodes.sparkSession
    spark.createDataFrame([(version.rsplit("/", 1)[-1], time.time_ns())], "version string, at long").coalesce(1).write.mode("append").parquet(f"{path}/current")


def _current(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole export."""
    newest = spark.read.parquet(f"{path}/current").agg(F.max_by("version", "at")).first()[0]
    return f"{path}/{newest}"


def as_json(edges: DataFrame) -> DataFrame:
    """One JSON text an edge; null fields are left out, bytes are base64."""
    columns = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in edges.dtypes]
    return edges.select(F.to_json(F.struct(*columns)).alias("edge"))


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (the first of an id) and edges, with what newer columns default to, and lengths of at least a centimetre."""
    path = _current(spark, path)
    nodes = spark.read.parquet(f"{path}/nodes").dropDuplicates(["id"])
    edges = spark.read.parquet(f"{path}/edges")
    for name, default in (("kind", F.lit("")), ("tree_park_canopy", F.lit(0.0)), ("fold_names", F.array().cast("array<string>"))):
        edges = edges.withColumn(name, F.coalesce(F.col(name), default) if name in edges.columns else default)
    return nodes, edges.withColumn("length_m", F.greatest("length_m", F.lit(0.01)))


def verify_export(spark: SparkSession, path: str, n_nodes: int, n_edges: int) -> bool:
    """Whether the counts are as written and at least one edge has shade."""
    nodes, edges = read_export(spark, path)
    got = edges.agg(F.count("*").alias("n"), F.count("building_shade").alias("shaded")).first()
    return nodes.count() == n_nodes and got["n"] == n_edges and got["shaded"] >= 1
