"""Sources of rasters and vectors: image files, GeoTIFF windows, road files, GeoJSON, and the mode registry."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfabric.config import MODES, Settings
from wayfabric.functions.pixels import is_vegetation, ndvi, road_mask, stretch
from wayfabric.operators.raster import clean, rasterise_roads
from wayfabric.scratch import materialize
from wayfabric.sources.roads import Fetch, download_roads, post


def has(library: str) -> bool:
    """Whether an optional library is installed."""
    return importlib.util.find_spec(library) is not None


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, meta) of all images under ``path`` that the JVM decodes; ids are hashes of the paths.

    The decoder's bytes run row by row in the order blue, green, red (and alpha).
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    rows = rows.select(F.pmod(F.xxhash64("origin"), F.lit(1 << 19)).alias("img_id"), "height", "width", "nChannels", "data")
    meta = rows.select("img_id", F.col("height").alias("h"), F.col("width").alias("w"))
    at = rows.withColumn("p", F.explode(F.expr("sequence(0, height * width - 1)")))

    def byte(k: str):
        text = F.expr(f"conv(hex(substring(data, p * nChannels + {k} + 1, 1)), 16, 10)").cast("int")
        return text

    last = "if(nChannels >= 3, {}, 0)"
    pixels = at.select(
        "img_id", F.expr("cast(p div width as int)").alias("y"), F.expr("cast(p % width as int)").alias("x"),
        byte(last.format(2)).alias("r"), byte(last.format(1)).alias("g"), byte("0").alias("b"),
    )
    return pixels, meta


def image_masks(spark: SparkSession, path: str, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """(clean road mask, meta) of image files."""
    pixels, meta = read_images(spark, path)
    return clean(road_mask(pixels, cfg.mask.threshold), meta, cfg.mask.close_kernel, cfg.mask.min_component), meta


class RasterWindows(DataSource):
    """Python data source ``geotiff``: windows of a raster file as rows (img_id, band, y, x, v).

    Options: ``path``, ``bands`` (comma-separated, clamped to the file's count), ``rows`` per partition. Needs rasterio.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "img_id long, band int, y int, x int, v double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        if not has("rasterio"):
            raise RuntimeError("reading GeoTIFF needs rasterio")
        return _WindowReader(self.options)


class _WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", 256))
        self.bands = [int(b) for b in options.get("bands", "4,3,2,8").split(",")]

    def partitions(self) -> list[InputPartition]:
        import rasterio

        with rasterio.open(self.path) as f:
            return [InputPartition(y) for y in range(0, f.height, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import rasterio
        from rasterio.windows import Window

        with rasterio.open(self.path) as f:
            y0 = partition.value
            window = Window(0, y0, f.width, min(self.rows, f.height - y0))
            for band in self.bands:
                yield window_rows(f.read(min(band, f.count), window=window), band, y0)


def window_rows(data: np.ndarray, band: int, y0: int) -> pa.RecordBatch:
    """The pixels of a window that starts at row ``y0`` as one batch of (img_id, band, y, x, v)."""
    h, w = data.shape
    columns = {
        "img_id": np.zeros(h * w, dtype=np.int64), "band": np.full(h * w, band, dtype=np.int32), "y": np.repeat(np.arange(y0, y0 + h, dtype=np.int32), w),
        "x": np.tile(np.arange(w, dtype=np.int32), h), "v": data.astype(np.float64).ravel(),
    }
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def spectral(bands: DataFrame, red: int = 4, green: int = 3, blue: int = 2, nir: int = 8) -> tuple[DataFrame, DataFrame]:
    """(RGB pixels, vegetation pixels) of band rows (img_id, band, y, x, v).

    Colours are stretched between percentiles; vegetation comes from the raw bands.
    """
    wide = bands.groupBy("img_id", "y", "x").agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(n) for n, b in (("r", red), ("g", green), ("b", blue), ("n", nir))])
    rgb = wide
    for c in ("r", "g", "b"):
        rgb = stretch(rgb, value=c).drop(c).withColumnRenamed("byte", c)
    green_pixels = wide.where(is_vegetation(ndvi(F.col("r"), F.col("n")))).select("img_id", "y", "x")
    return rgb.select("img_id", "y", "x", "r", "g", "b"), green_pixels


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """Road polylines (img_id, u, v, geometry: array of lon, lat) from JSON lines."""
    schema = "img_id long, u long, v long, geometry array<struct<lon:double,lat:double>>"
    return spark.read.schema(schema).json(path)


def road_masks(roads: DataFrame, cfg: Settings, width: int = 1245, height: int = 636, line: float = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean mask, meta, bounds) of road edges."""
    mask, bounds = rasterise_roads(roads, width, height, line)
    meta = bounds.select("img_id", F.lit(height).alias("h"), F.lit(width).alias("w"))
    return clean(mask, meta, cfg.mask.close_kernel, cfg.mask.min_component), meta, bounds


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(features, CRS name) of a GeoJSON collection; a feature is (kind, coordinates as JSON, properties)."""
    schema = "crs struct<properties:struct<name:string>>, features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    name = whole.select("crs.properties.name").first()
    features = whole.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))
    return features, name[0] if name else None


def resolve(spark: SparkSession, cfg: Settings, path: str | None = None, scorer: Callable | None = None, fetch: Fetch = post) -> dict:
    """Mask, meta and notes of the configured mode; ValueError for an unknown mode.

    Roads come from the file ``path`` or, without one, from the map servers for the configured area. Where neither
    gives any, the synthetic source steps in, and the notes say so.
    """
    from wayfabric.operators.tiles import load_scorer, mosaic, score_tiles
    from wayfabric.sources.synthetic import synthetic_mask

    if cfg.mode not in MODES:
        raise ValueError(f"unknown mode {cfg.mode!r}; known: {MODES}")
    if cfg.mode == "image":
        mask, meta = image_masks(spark, path or "road.png", cfg)
        return {"mask": mask, "meta": meta, "notes": {"input": "image"}}
    if cfg.mode == "satellite":
        spark.dataSource.register(RasterWindows)
        score = scorer or load_scorer(cfg.weights)
        rgb, green = spectral(spark.read.format("geotiff").option("path", path).load())
        meta = rgb.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        raw = mosaic(score_tiles(rgb, meta, score)).where("road").select("img_id", "y", "x")
        return {"mask": clean(raw, meta, cfg.mask.close_kernel, cfg.mask.min_component), "meta": meta, "region": green, "notes": {"input": "satellite"}}
    if cfg.mode == "osm":
        try:
            roads = materialize(read_roads(spark, path) if path else download_roads(spark, cfg.area, fetch), "roads")
            mask, meta, bounds = road_masks(roads, cfg)
            if bounds.isEmpty():
                raise ValueError("no roads")
            crossings = roads.select(F.explode(F.array("u", "v")).alias("n")).distinct().count()
            return {"mask": mask, "meta": meta, "bounds": bounds, "notes": {"input": "osm", "osm_nodes": crossings, "osm_edges": roads.count()}}
        except (OSError, RuntimeError, ValueError, PySparkException, Py4JError) as error:  # the source failed: the contract is the fallback
            mask, meta = synthetic_mask(spark, cfg)
            return {"mask": mask, "meta": meta, "notes": {"input": "synthetic_fallback", "osm_error": str(error)[:200]}}
    mask, meta = synthetic_mask(spark, cfg)
    return {"mask": mask, "meta": meta, "notes": {"input": "synth"}}
