"""Stencils over sparse rasters (img_id, y, x): dilation, erosion, neighbour counts, gradients.

A pixel sends its contribution to each place that its stencil touches and one aggregate collects
them: one shuffle by (img_id, y, x), no join, and no place is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight neighbours, by row and column; the position in this list is a step's index.
NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a filled ellipse of odd ``size``.

    Row dy of a radius-r ellipse reaches round(r * sqrt(1 - dy^2 / r^2)) to both sides.
    """
    r = size // 2
    reach = {dy: round(r * (1 - dy * dy / (r * r)) ** 0.5) if r else 0 for dy in range(-r, r + 1)}
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-reach[dy], reach[dy] + 1)]


def _offsets(offsets: Iterable[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))


def inside(meta: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels within their images' bounds; ``meta`` has (img_id, h, w), a row per image."""
    return pixels.join(meta, "img_id").where("y >= 0 and x >= 0 and y < h and x < w").select(*pixels.columns)


def shifted(mask: DataFrame, offsets: Iterable[tuple[int, int]]) -> DataFrame:
    """Every pixel moved by every offset, with repetitions."""
    at = mask.select("img_id", "y", "x", _offsets(offsets).alias("o"))
    return at.select("img_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))


def dilate(mask: DataFrame, meta: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Places that an offset of a pixel reaches."""
    return inside(meta, shifted(mask, offsets).distinct())


def erode(mask: DataFrame, meta: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose offsets inside the image are foreground (the outside never erodes)."""
    hits = shifted(mask, [(-dy, -dx) for dy, dx in offsets]).groupBy("img_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    within = F.lit(0)
    for dy, dx in offsets:
        ok = (F.col("y") + dy).between(0, F.col("h") - 1) & (F.col("x") + dx).between(0, F.col("w") - 1)
        within = within + ok.cast("int")
    at = hits.join(meta, "img_id").where("y >= 0 and x >= 0 and y < h and x < w")
    return at.where(F.col("n") == within).select("img_id", "y", "x")


def close(mask: DataFrame, meta: DataFrame, size: int = 5) -> DataFrame:
    """Morphological closing with an ellipse; sizes up to 1 change nothing."""
    if size <= 1:
        return mask.select("img_id", "y", "x")
    kernel = ellipse(size)
    return erode(dilate(mask, meta, kernel), meta, kernel)


def neighbour_count(mask: DataFrame) -> DataFrame:
    """Rows (img_id, y, x, n): foreground pixels with their number of foreground neighbours."""
    own = mask.select("img_id", "y", "x", F.lit(1).alias("own"), F.lit(0).alias("nbr"))
    sent = shifted(mask, NEIGHBOURS).select("img_id", "y", "x", F.lit(0).alias("own"), F.lit(1).alias("nbr"))
    both = own.unionByName(sent).groupBy("img_id", "y", "x").agg(F.max("own").alias("own"), F.sum("nbr").cast("int").alias("n"))
    return both.where("own = 1").select("img_id", "y", "x", "n")


def convolve(raster: DataFrame, meta: DataFrame, weights: dict[tuple[int, int], float], value: str = "v") -> DataFrame:
    """Rows (img_id, y, x, v): at each place the weighted sum of the pixels at its offsets; zero outside."""
    rows = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(float(w)).alias("k")) for (dy, dx), w in weights.items()])
    sent = raster.select("img_id", "y", "x", F.col(value).alias("v"), F.explode(rows).alias("o"))
    moved = sent.select("img_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("v") * F.col("o.k")).alias("v"))
    return inside(meta, moved.groupBy("img_id", "y", "x").agg(F.sum("v").alias("v")))


# The horizontal Sobel kernel; the vertical one is its transpose.
SOBEL_X = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
SOBEL_Y = {(dx, dy): w for (dy, dx), w in SOBEL_X.items()}


def gradient(raster: DataFrame, meta: DataFrame, value: str = "v", eps: float = 1e-6) -> DataFrame:
    """Rows (img_id, y, x, v): Sobel gradient magnitude sqrt(gx^2 + gy^2 + eps) of a dense raster."""
    both = F.array(
        *[
            F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(float(SOBEL_X.get((dy, dx), 0))).alias("kx"), F.lit(float(SOBEL_Y.get((dy, dx), 0))).alias("ky"))
            for dy, dx in [*NEIGHBOURS, (0, 0)]
        ]
    )
    sent = raster.select("img_id", "y", "x", F.col(value).alias("v"), F.explode(both).alias("o"))
    moved = sent.select(
        "img_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
        (F.col("v") * F.col("o.kx")).alias("gx"), (F.col("v") * F.col("o.ky")).alias("gy"),
    )
    total = moved.groupBy("img_id", "y", "x").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    return inside(meta, total.select("img_id", "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + eps).alias("v")))
