"""Seeded synthetic road grids, as segments and as masks, and synthetic training tiles."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wayfabric.config import Settings
from wayfabric.operators.raster import clean, rasterise_segments


def road_grid(height: int = 636, width: int = 1245, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Segments (x0, y0, x1, y1): 7 near-vertical and 5 near-horizontal roads and 2 diagonals.

    Fixed values: the counts, the 60-pixel margin and the 6-pixel drift.
    """
    rng = random.Random(seed)
    xs = sorted(rng.sample(range(60, width - 60), 7))
    ys = sorted(rng.sample(range(60, height - 60), 5))
    down = [(x, 0, x + rng.randint(-6, 6), height) for x in xs]
    across = [(0, y, width, y + rng.randint(-6, 6)) for y in ys]
    return [*down, *across, (xs[0], ys[0], xs[-1], ys[-1]), (xs[-1], ys[0], xs[len(xs) // 2], ys[-1])]


def synthetic_segments(spark: SparkSession, images: int = 1, height: int = 636, width: int = 1245, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(segments, meta) of ``images`` road grids with consecutive seeds."""
    rows = [(i, *s) for i in range(images) for s in road_grid(height, width, seed + i)]
    meta = spark.createDataFrame([(i, height, width) for i in range(images)], "img_id long, h int, w int")
    return spark.createDataFrame(rows, "img_id long, x0 int, y0 int, x1 int, y1 int"), meta


def synthetic_mask(spark: SparkSession, cfg: Settings = Settings(), images: int = 1, height: int = 636, width: int = 1245, road: float = 14) -> tuple[DataFrame, DataFrame]:
    """(clean mask, meta) of synthetic road grids."""
    segments, meta = synthetic_segments(spark, images, height, width, cfg.mask.seed)
    return clean(rasterise_segments(segments, meta, road), meta, cfg.mask.close_kernel, cfg.mask.min_component), meta


def training_tile(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(RGB tile, mask) of slanted roads on a textured ground; image and mask share each road's slant."""
    rng = np.random.default_rng(seed)
    image = rng.integers(60, 120, (size, size, 3)).astype(np.float64)
    mask = np.zeros((size, size), dtype=bool)
    yy, xx = np.mgrid[:size, :size].astype(np.float64)
    for along, cross in ((yy, xx), (xx, yy)):
        for _ in range(rng.integers(3, 6)):
            at, slant, half = rng.uniform(0, size), rng.uniform(-0.15, 0.15), rng.uniform(2, 4)
            road = np.abs(cross - at - slant * along) <= half
            image[road] = rng.uniform(140, 200)
            mask |= road
    image += rng.normal(0, 8, image.shape)
    return image.clip(0, 255).astype(np.uint8), mask


def training_tiles(spark: SparkSession, count: int, size: int = 128, seed: int = 0) -> DataFrame:
    """Rows (tile_id, size, img, mask), made in parallel, each from its own seed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [training_tile(size, seed + int(i)) for i in frame["id"]]
            yield pd.DataFrame({"tile_id": frame["id"], "size": size, "img": [a.tobytes() for a, _ in made], "mask": [m.astype(np.uint8).tobytes() for _, m in made]})

    return spark.range(count).mapInPandas(run, "tile_id long, size int, img binary, mask binary")


def training_pairs(pixels: DataFrame, mask: DataFrame, meta: DataFrame, tile: int = 256, step: int = 192, least: float = 0.01, most: int = 400) -> DataFrame:
    """Rows (tile_id, size, img, mask) cut from real images: the tiles of ``training_tiles`` with their pixels.

    ``mask`` are roads drawn in the images' frame. A tile is one group of tile * tile pixels.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wayfabric.operators.tiles import in_tiles
    from wayfabric.operators.tiles import training_tiles as chosen_tiles

    chosen = chosen_tiles(mask, meta, tile, step, least, most)
    order = Window.orderBy("img_id", "ty", "tx")  # at most ``most`` rows
    numbered = chosen.select("img_id", "ty", "tx", (F.row_number().over(order) - 1).cast("long").alias("tile_id"))
    rows = in_tiles(pixels, meta, tile, step, True).join(F.broadcast(numbered), ["img_id", "ty", "tx"])
    flagged = rows.join(mask.select("img_id", "y", "x", F.lit(1).alias("t")), ["img_id", "y", "x"], "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image, truth = np.zeros((tile, tile, 3), dtype=np.uint8), np.zeros((tile, tile), dtype=np.uint8)
        y, x = (frame["y"] - frame["ty"]).to_numpy(), (frame["x"] - frame["tx"]).to_numpy()
        image[y, x] = frame[["r", "g", "b"]].to_numpy()
        truth[y, x] = frame["t"].fillna(0).to_numpy()
        return pd.DataFrame({"tile_id": [frame["tile_id"].iloc[0]], "size": [tile], "img": [image.tobytes()], "mask": [truth.tobytes()]})

    return flagged.groupBy("tile_id").applyInPandas(run, "tile_id long, size int, img binary, mask binary")


def raster_pairs(pixels: DataFrame, frame: DataFrame, roads: DataFrame, width: int, height: int, line: float = 3, **tiles: int) -> DataFrame:
    """Training pairs of a georeferenced image and the roads of its area, drawn in the image's own ``frame`` (img_id and bounds).

    The width of the lines is a fixed value.
    """
    from pyspark.sql import functions as F

    from wayfabric.operators.raster import rasterise_roads

    mask, _ = rasterise_roads(roads, width, height, line, frame)
    meta = frame.select("img_id", F.lit(height).alias("h"), F.lit(width).alias("w"))
    return training_pairs(pixels, mask, meta, **tiles)
