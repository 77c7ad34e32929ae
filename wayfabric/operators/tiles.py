"""Overlapping tiles: training tiles, tiled scoring and the mosaic of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_starts(meta: DataFrame, tile: int, step: int, full_only: bool) -> DataFrame:
    """Rows (img_id, ty, tx): the upper left corners of an image's tiles."""

    def starts(size: str):
        last = f"greatest(1, {size} - {tile} + 1)" if full_only else f"greatest(1, {size} - 1)"
        return F.expr(f"sequence(0, cast({last} - 1 as int), {step})")

    rows = meta.withColumn("ty", F.explode(starts("h"))).withColumn("tx", F.explode(starts("w")))
    rows = rows.where(f"ty + {tile} <= h and tx + {tile} <= w") if full_only else rows
    return rows.select("img_id", "ty", "tx")


def in_tiles(pixels: DataFrame, meta: DataFrame, tile: int, step: int, full_only: bool = False) -> DataFrame:
    """Pixels with the corner (ty, tx) of every tile that holds them; the tiles follow from the position alone."""

    def covering(c: str, size: str):
        low = f"cast(greatest(0, ceil(({c} - {tile} + 1) / {step})) as int)"
        last = f"greatest(1, {size} - {tile} + 1) - 1" if full_only else f"greatest(1, {size} - 1) - 1"
        high = f"cast(least(floor({c} / {step}), floor(({last}) / {step})) as int)"
        return F.expr(f"transform(if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>)), i -> i * {step})")

    rows = pixels.join(meta, "img_id").withColumn("ty", F.explode(covering("y", "h"))).withColumn("tx", F.explode(covering("x", "w")))
    rows = rows.where(f"ty + {tile} <= h and tx + {tile} <= w") if full_only else rows
    return rows.select(*pixels.columns, "ty", "tx")


def training_tiles(mask: DataFrame, meta: DataFrame, tile: int = 256, step: int = 192, least: float = 0.01, most: int = 400) -> DataFrame:
    """Rows (img_id, ty, tx, share): full tiles with enough foreground, the first ``most`` in row-major order."""
    filled = in_tiles(mask.select("img_id", "y", "x"), meta, tile, step, True).groupBy("img_id", "ty", "tx").agg(F.count(F.lit(1)).alias("n"))
    share = filled.select("img_id", "ty", "tx", (F.col("n") / (tile * tile)).alias("share"))
    return share.where(F.col("share") >= least).orderBy("img_id", "ty", "tx").limit(most)


def mosaic(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (img_id, y, x, p, road): the mean of the tiles' probabilities, strictly thresholded."""
    return scored.groupBy("img_id", "y", "x").agg(F.avg("p").alias("p")).withColumn("road", F.col("p") > threshold)


def score_tiles(pixels: DataFrame, meta: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], tile: int = 128, overlap: int = 32) -> DataFrame:
    """Rows (img_id, y, x, ty, tx, p): a scorer of zero-padded RGB tiles (tile, tile, 3) applied tile by tile.

    A tile is a group of at most tile * tile rows, whatever the image's size.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(frame["ty"].iloc[0]), int(frame["tx"].iloc[0])
        y, x = (frame["y"] - ty).to_numpy(), (frame["x"] - tx).to_numpy()
        image = np.zeros((tile, tile, 3), dtype=np.uint8)
        image[y, x] = frame[["r", "g", "b"]].to_numpy()
        p = scorer(image)
        return frame[["img_id", "y", "x", "ty", "tx"]].assign(p=p[y, x].astype("float64"))

    rows = in_tiles(pixels.select("img_id", "y", "x", "r", "g", "b"), meta, tile, tile - overlap)
    return rows.groupBy("img_id", "ty", "tx").applyInPandas(run, "img_id long, y int, x int, ty int, tx int, p double")


def load_scorer(weights: str) -> Callable[[np.ndarray], np.ndarray]:
    """Scorer of the segmentation network from an ``.npz`` file of its weights or an ONNX export.

    FileNotFoundError without the file, RuntimeError for an export without the runtime. Sessions are made once per worker.
    """
    import importlib.util
    import os

    if weights.endswith(".npz"):
        from wayfabric.operators.network import load

        return load(weights)
    if importlib.util.find_spec("onnxruntime") is None:
        raise RuntimeError("tile scoring needs onnxruntime")
    if not os.path.exists(weights):
        raise FileNotFoundError(f"no weights at {weights}; train and export the network first")
    sessions: dict = {}

    def score(image: np.ndarray) -> np.ndarray:
        import onnxruntime

        if "s" not in sessions:
            sessions["s"] = onnxruntime.InferenceSession(weights)
        session = sessions["s"]
        batch = (image.astype(np.float32) / 255).transpose(2, 0, 1)[None]
        z = session.run(None, {session.get_inputs()[0].name: batch})[0][0, 0]
        return 1 / (1 + np.exp(-z))

    return score


def occluded(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The image with 4 to 9 dark discs of radius 8 to 25 and grey 20 to 69 (fixed values)."""
    out = image.copy()
    h, w = out.shape[:2]
    yy, xx = np.mgrid[:h, :w]
    for _ in range(rng.integers(4, 10)):
        cy, cx, r = rng.integers(0, h), rng.integers(0, w), rng.integers(8, 26)
        out[(yy - cy) ** 2 + (xx - cx) ** 2 <= r * r] = rng.integers(20, 70)
    return out


def shift_colours(image: np.ndarray, hue: float, saturation: float, value: float) -> np.ndarray:
    """RGB bytes with the hue turned by ``hue`` half degrees, and saturation and value moved (of 255)."""
    x = image.astype(np.float64) / 255
    top, low = x.max(axis=2), x.min(axis=2)
    spread = top - low
    safe = np.where(spread > 0, spread, 1)
    r, g, b = (x[..., k] for k in range(3))
    sector = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
    h = (sector + hue / 30) % 6
    s = np.clip(np.where(top > 0, spread / np.where(top > 0, top, 1), 0) + saturation / 255, 0, 1)
    v = np.clip(top + value / 255, 0, 1)
    parts = [v - v * s * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1) for n in (5, 3, 1)]
    return (np.stack(parts, axis=2) * 255).round().astype(np.uint8)


def resized(image: np.ndarray, size: int) -> np.ndarray:
    """Bytes (height, width, channels) resampled bilinearly to a square."""
    from wayfabric.operators.network import resize

    out = resize(image.astype(np.float32).transpose(2, 0, 1), size, size).transpose(1, 2, 0)
    return out.round().clip(0, 255).astype(np.uint8)


def augmented(image: np.ndarray, mask: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Image and mask (of one square size) after seven random changes, places changed alike in both.

    Fixed values: quarter turns (chance 0.5), mirrored sideways (0.5) and upside down (0.3), brightness and contrast
    by up to 0.2 (0.5), hue, saturation and value by up to 10, 15 and 10 (0.3), noise (0.2), and a crop of 0.7 to
    1.0 of the area, scaled back (0.3). The noise's variance is 10 to 50, the crop's sides are 3:4 to 4:3.
    """
    size = len(image)
    if rng.random() < 0.5:
        turns = int(rng.integers(0, 4))
        image, mask = np.rot90(image, turns), np.rot90(mask, turns)
    if rng.random() < 0.5:
        image, mask = image[:, ::-1], mask[:, ::-1]
    if rng.random() < 0.3:
        image, mask = image[::-1], mask[::-1]
    if rng.random() < 0.5:
        bright, contrast = rng.uniform(-0.2, 0.2, 2)
        image = (image * (1 + contrast) + 255 * bright).clip(0, 255).astype(np.uint8)
    if rng.random() < 0.3:
        image = shift_colours(image, *(rng.uniform(-k, k) for k in (10, 15, 10)))
    if rng.random() < 0.2:
        noise = rng.normal(0, np.sqrt(rng.uniform(10, 50)), image.shape)
        image = (image + noise).round().clip(0, 255).astype(np.uint8)
    if rng.random() < 0.3:
        area, ratio = rng.uniform(0.7, 1.0) * size * size, np.exp(rng.uniform(np.log(3 / 4), np.log(4 / 3)))
        h, w = (max(1, min(size, round(np.sqrt(area * k)))) for k in (1 / ratio, ratio))
        y, x = int(rng.integers(0, size - h + 1)), int(rng.integers(0, size - w + 1))
        rows, cols = y + (np.arange(size) * h // size), x + (np.arange(size) * w // size)
        image, mask = resized(image[y : y + h, x : x + w], size), mask[rows][:, cols]
    return np.ascontiguousarray(image), np.ascontiguousarray(mask)


def prepared(image: np.ndarray, mask: np.ndarray, size: int, rng: np.random.Generator, occlude: bool = True, augment: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(values in 0..1 (3, size, size), target 0 or 1 (size, size)) of a training tile of any size.

    The image alone is occluded; both are augmented.
    """
    if image.shape[:2] != (size, size):
        image, mask = resized(image, size), resized(255 * (mask > 0)[..., None].astype(np.uint8), size)[..., 0]
    if occlude:
        image = occluded(image, rng)
    if augment:
        image, mask = augmented(image, mask, rng)
    return image.astype(np.float32).transpose(2, 0, 1) / 255, (mask > 0).astype(np.float32)


def decoded(row_size: int, img: bytes, mask: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a (size, img, mask) row."""
    return np.frombuffer(img, dtype=np.uint8).reshape(row_size, row_size, 3), np.frombuffer(mask, dtype=np.uint8).reshape(row_size, row_size)


def training_set(tiles: DataFrame, size: int, occlude: bool = True, augment: bool = True, seed: int = 0) -> DataFrame:
    """Rows (tile_id, size, x, t): ``prepared`` tiles as bytes of 32-bit floats, each by a generator seeded with its id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [
                prepared(*decoded(n, img, mask), size, np.random.default_rng([seed, int(i)]), occlude, augment)
                for i, n, img, mask in zip(frame["tile_id"], frame["size"], frame["img"], frame["mask"], strict=True)
            ]
            yield pd.DataFrame({"tile_id": frame["tile_id"], "size": size, "x": [x.tobytes() for x, _ in made], "t": [t.tobytes() for _, t in made]})

    return tiles.select("tile_id", "size", "img", "mask").mapInPandas(run, "tile_id long, size int, x binary, t binary")


def occlude_tiles(tiles: DataFrame, seed: int = 0) -> DataFrame:
    """Training augmentation: dark discs on the image of (tile_id, size, img, mask) rows, masks untouched.

    Also flips and transposes image and mask together, by a generator seeded with the tile's id.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images, masks = [], []
            for tile_id, size, img, mask in zip(frame["tile_id"], frame["size"], frame["img"], frame["mask"], strict=True):
                rng = np.random.default_rng([seed, int(tile_id)])
                image, truth = decoded(size, img, mask)
                image = occluded(image, rng)
                if rng.random() < 0.5:
                    image, truth = image[:, ::-1], truth[:, ::-1]
                if rng.random() < 0.5:
                    image, truth = image.transpose(1, 0, 2), truth.T
                images.append(image.tobytes())
                masks.append(truth.tobytes())
            yield frame.assign(img=images, mask=masks)

    return tiles.select("tile_id", "size", "img", "mask").mapInPandas(run, "tile_id long, size int, img binary, mask binary")
