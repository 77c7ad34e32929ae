"""Pixel expressions: colour rules, thresholds, stretches, vegetation and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of an RGB pixel as an integer (fixed values: the ITU-R 601 weights)."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def is_road_colour(r: Column, g: Column, b: Column) -> Column:
    """Whether a map pixel has a road colour: gray, white or orange, and neither green nor dark.

    The bounds are fixed values.
    """
    total, high, low = r + g + b, F.greatest(r, g, b), F.least(r, g, b)
    green = (g > r + 12) & (g > b + 12) & (g > 120)
    dark = total < 3 * 60
    grayish = (high - low < 25) & (total > 3 * 90) & (total < 3 * 235)
    white = low > 230
    orange = (r > 220) & (g > 140) & (g < 215) & (b < 130)
    return (grayish | white | orange) & ~green & ~dark


def two_tone(pixels: DataFrame, most: int = 6) -> DataFrame:
    """Rows (img_id, tones, two_tone): images of at most ``most`` gray levels are two-tone."""
    tones = pixels.groupBy("img_id").agg(F.count_distinct(gray(F.col("r"), F.col("g"), F.col("b"))).alias("tones"))
    return tones.withColumn("two_tone", F.col("tones") <= most)


def road_mask(pixels: DataFrame, threshold: int = 127, least: float = 0.01, most_tones: int = 6) -> DataFrame:
    """Foreground (img_id, y, x) of every image.

    Two-tone images, and images of which the colour rule takes less than ``least``, take the gray
    threshold in the polarity that marks fewer pixels (the bright one on ties); others take the
    colour rule. One aggregate per image decides; the choice is joined back, so many images run
    in one plan.
    """
    level = gray(F.col("r"), F.col("g"), F.col("b"))
    marked = pixels.withColumn("gray", level).withColumn("colour", is_road_colour(F.col("r"), F.col("g"), F.col("b")))
    stats = marked.groupBy("img_id").agg(
        (F.count_distinct("gray") <= most_tones).alias("two_tone"),
        F.avg(F.col("colour").cast("int")).alias("share"),
        F.avg((F.col("gray") > threshold).cast("int")).alias("bright"),
    )
    choice = stats.select(
        "img_id", (F.col("two_tone") | (F.col("share") < least)).alias("by_gray"), (F.col("bright") <= 0.5).alias("take_bright")
    )
    bright = F.col("gray") > threshold
    keep = F.when(F.col("by_gray"), bright == F.col("take_bright")).otherwise(F.col("colour"))
    return marked.join(choice, "img_id").where(keep).select("img_id", "y", "x")


def stretch(band: DataFrame, low: float = 0.02, high: float = 0.98, value: str = "v") -> DataFrame:
    """Adds ``byte``: values between two percentiles of their image stretched over 0..255."""
    cut = band.groupBy("img_id").agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("p"))
    lo = F.col("p")[0]
    hi = F.when(F.col("p")[1] <= lo, lo + 1).otherwise(F.col("p")[1])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / (hi - lo)))
    return band.join(cut, "img_id").withColumn("byte", F.floor(share * 255).cast("int")).drop("p")


def ndvi(red: Column, nir: Column) -> Column:
    """Normalized difference of two bands; a zero sum counts as 1e-6."""
    total = (nir + red).cast("double")
    return (nir - red).cast("double") / F.when(total == 0, F.lit(EPS)).otherwise(total)


def is_vegetation(index: Column, least: float = 0.3) -> Column:
    """Whether a vegetation index passes; null stays null."""
    return index > least


def to_crs(px: Column, py: Column, transform: tuple[float, ...], scale: tuple[float, float] = (1.0, 1.0)) -> tuple[Column, Column]:
    """Coordinates of a pixel's centre under an affine transform (a, b, c, d, e, f), in its CRS.

    ``scale`` is original over working size in x and y.
    """
    a, b, c, d, e, f = transform
    col, row = px * scale[0] + 0.5, py * scale[1] + 0.5
    return c + a * col + b * row, f + d * col + e * row


def lonlat_of_pixel(px: Column, py: Column, bounds: tuple[float, float, float, float], size: tuple[int, int]) -> tuple[Column, Column]:
    """Inverse of the vector rasteriser's mapping: (minx, miny, maxx, maxy), (w, h) to longitude, latitude."""
    minx, miny, maxx, maxy = bounds
    w, h = size
    return minx + px / (w - 1) * (maxx - minx), maxy - py / (h - 1) * (maxy - miny)


def over(probability: Column, threshold: float = 0.5) -> Column:
    """Strict probability threshold."""
    return probability > threshold


def resample(band: DataFrame, meta: DataFrame, height: int, width: int, value: str = "v") -> DataFrame:
    """Rows (img_id, y, x, v): a dense raster resampled bilinearly by pixel centres to a new size.

    Each new pixel asks for its four neighbours (edges repeat), which is one equi-join and one aggregate.
    """

    def axis(c: str, size: str, new: int) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), F.least((F.col(c) + 0.5) * F.col(size) / new - 0.5, F.col(size) - F.lit(1.0)))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.col(size) - 1), at - low

    grid = meta.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    y0, y1, fy = axis("y", "h", height)
    x0, x1, fx = axis("x", "w", width)
    corners = F.array(*[F.struct(a.alias("sy"), b.alias("sx"), (p * q).alias("k")) for a, p in ((y0, 1 - fy), (y1, fy)) for b, q in ((x0, 1 - fx), (x1, fx))])
    asked = grid.select("img_id", "y", "x", F.explode(corners).alias("c")).select("img_id", "y", "x", "c.sy", "c.sx", "c.k")
    source = band.select("img_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v"))
    return asked.join(source, ["img_id", "sy", "sx"]).groupBy("img_id", "y", "x").agg(F.sum(F.col("v") * F.col("k")).alias("v"))
