"""Deterministic projections of the shared test tables into graphs, rasters and point sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfabric.operators.spatial_join import grid_distance_join

WIDTH = 64
EDGE_RADIUS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar points (img_id, node_id, x, y) from the first two components of each vector."""

    def axis(i: int) -> Column:
        return F.round(600 + 1500 * F.element_at("embedding", i).cast("double")).cast("int")

    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit(0).cast("long").alias("img_id"), F.col("vec_id").alias("node_id"), axis(1).alias("x"), axis(2).alias("y"))


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius graph (a, b, length, w) over the points; w is the length in thousandths, rounded."""
    nodes = geo_nodes(spark, sf_dir)
    met = grid_distance_join(nodes, nodes, float(EDGE_RADIUS), ("img_id",)).where("l.node_id < r.node_id")
    return met.select(
        F.col("l.node_id").alias("a"), F.col("r.node_id").alias("b"), F.col("dist").alias("length"), F.round(1000 * F.col("dist")).cast("long").alias("w")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster (img_id, y, x, v): a row per vector, a column per component."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return rows.select(F.lit(0).cast("long").alias("img_id"), F.col("vec_id").cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))


def raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (img_id, h, w)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.agg((F.max("vec_id") + 1).cast("int").alias("h")).select(F.lit(0).cast("long").alias("img_id"), "h", F.lit(WIDTH).alias("w"))


def foreground(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Cells above a value."""
    return cells(spark, sf_dir).where(F.col("v") > least).select("img_id", "y", "x")


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction shifted by a column against the truth."""
    rows = cells(spark, sf_dir).where("v > 0.12")
    return rows.select("img_id", "y", ((F.col("x") + 1) % WIDTH).cast("int").alias("x"))


def _neighbours(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    """(img_id, y, x, c0, c1, ...): a cell with the values of the cells to its right, around the row's end."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("x", "v"))
    cols = [F.element_at("embedding", ((F.col("x") + k) % WIDTH + 1).cast("int")).cast("double").alias(f"c{k}") for k in range(count)]
    return rows.select(F.lit(0).cast("long").alias("img_id"), F.col("vec_id").cast("int").alias("y"), "x", *cols)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB pixels (img_id, y, x, r, g, b) of three neighbouring cells."""

    def channel(c: str) -> Column:
        return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 300 * F.col(c)))).cast("int")

    rows = _neighbours(spark, sf_dir, 3)
    return rows.select("img_id", "y", "x", channel("c0").alias("r"), channel("c1").alias("g"), channel("c2").alias("b"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spectral bands (img_id, y, x, red, nir)."""

    def band(c: str) -> Column:
        return F.floor(1000 * (F.col(c) + 0.5)).cast("int")

    return _neighbours(spark, sf_dir, 2).select("img_id", "y", "x", band("c0").alias("red"), band("c1").alias("nir"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (user_id, event_id, px, py): time in seconds and value of each event."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("px"), F.col("value").alias("py"))


def parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (a, b, length) with many parallels."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("length")
    )


#: Occluding shapes of the fixture raster: (img_id, kind, cx, cy, rx, ry).
SHAPES = [(0, "disc", 12, 40, 9, 9), (0, "disc", 50, 120, 14, 14), (0, "disc", 30, 300, 16, 16), (0, "box", 20, 200, 10, 20), (0, "box", 40, 420, 25, 12)]


def shapes(spark: SparkSession) -> DataFrame:
    """The fixture's occluding shapes."""
    return spark.createDataFrame(SHAPES, "img_id long, kind string, cx int, cy int, rx int, ry int")
