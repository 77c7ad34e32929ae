"""Thinning, and extraction of nodes and edges from one-pixel-wide skeletons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfabric.functions.stencil import NEIGHBOURS, neighbour_count
from wayfabric.operators.components import components
from wayfabric.operators.raster import adjacency, pixel_key


def thin(image: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of a boolean image: two conditional deletions in turn until nothing changes; then staircases go."""
    img = np.pad(image.astype(np.uint8), 1)
    while True:
        changed = False
        for phase in (0, 1):
            p2, p3, p4 = img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:]
            p5, p6, p7 = img[2:, 2:], img[2:, 1:-1], img[2:, :-2]
            p8, p9 = img[1:-1, :-2], img[:-2, :-2]
            ring = [p2, p3, p4, p5, p6, p7, p8, p9]
            count = sum(r.astype(np.int8) for r in ring)
            turns = sum(((a == 0) & (b == 1)).astype(np.int8) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            if phase == 0:
                side = (p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0)
            else:
                side = (p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0)
            gone = (img[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & side
            if gone.any():
                img[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return without_stairs(img[1:-1, 1:-1].astype(bool))


def without_stairs(skeleton: np.ndarray) -> np.ndarray:
    """A thinned image without the inner corners of staircases, which would count as junctions (Holt et al., 1987).

    A corner goes whose two sides touch each other diagonally, those below an upper side first, then those
    above a lower one; what it joined stays joined.
    """
    img = np.pad(skeleton, 1)
    for up, down in ((slice(0, -2), slice(2, None)), (slice(2, None), slice(0, -2))):
        mid, left, right = slice(1, -1), slice(0, -2), slice(2, None)
        north, south, east, west = img[up, mid], img[down, mid], img[mid, right], img[mid, left]
        to_east = east & ~img[up, right] & ~img[down, left] & (~west | ~south)
        to_west = west & ~img[up, left] & ~img[down, right] & (~east | ~south)
        img[mid, mid] &= ~(north & (to_east | to_west))
    return img[1:-1, 1:-1]


def skeletonize(mask: DataFrame) -> DataFrame:
    """One-pixel-wide skeletons, one image per task.

    Thinning goes round by round over a whole image, so an image must fit a task; cut larger rasters into
    images (tiles with an overlap of at least the widest road) first.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(frame["y"].min()), int(frame["x"].min())
        image = np.zeros((int(frame["y"].max()) - y0 + 1, int(frame["x"].max()) - x0 + 1), dtype=bool)
        image[frame["y"] - y0, frame["x"] - x0] = True
        y, x = np.nonzero(thin(image))
        return pd.DataFrame({"img_id": frame["img_id"].iloc[0], "y": (y + y0).astype("int32"), "x": (x + x0).astype("int32")})

    rows = mask.select(F.col("img_id").cast("long").alias("img_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return rows.groupBy("img_id").applyInPandas(run, "img_id long, y int, x int")


def node_pixels(skeleton: DataFrame) -> DataFrame:
    """Rows (img_id, node_id, x, y, n): end points (one neighbour) and junctions (three or more).

    Ids follow the scan order of each image from 0. Isolated pixels are no nodes; adjacent junction
    pixels are separate nodes.
    """
    nodes = neighbour_count(skeleton).where("n = 1 or n >= 3")
    order = Window.partitionBy("img_id").orderBy("y", "x")
    return nodes.select("img_id", (F.row_number().over(order) - 1).cast("long").alias("node_id"), "x", "y", "n")


def trace_edges(skeleton: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a skeleton; edges (img_id, a, b, length, n_pix), a < b, one per pair of nodes.

    Pixels with two neighbours form chains; the connected components of the chain pixels are the
    segments, and the nodes next to a component are its ends, so no walk is needed. Of segments of a
    pair with equal numbers of pixels the first counts, of those left the shortest. Segments that
    return to their node, dangling ones and rings without a node give no edge.
    """
    counted = neighbour_count(skeleton)
    nodes = node_pixels(skeleton)
    chain = counted.where("n = 2").select("img_id", "y", "x")
    keyed = chain.select("img_id", pixel_key().alias("key"))
    labels = components(keyed, adjacency(chain), node="key")
    named = nodes.select("img_id", "node_id", F.col("y"), F.col("x"), pixel_key().alias("nkey"))

    arrows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(NEIGHBOURS)]))
    sent = named.select("img_id", "node_id", arrows.alias("o"), "y", "x")
    sent = sent.select(
        "img_id", "node_id", F.col("o.i").alias("step"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
        F.sqrt((F.abs("o.dy") + F.abs("o.dx")).cast("double")).alias("len"),
    )
    touch = sent.join(chain, ["img_id", "y", "x"]).select("img_id", "node_id", "step", "len", pixel_key().alias("key")).join(labels, "key")

    inner = adjacency(chain).join(labels, F.col("a") == F.col("key"))
    dy = F.floor(F.col("b") / (1 << 22)) - F.floor(F.col("a") / (1 << 22))
    dx = F.pmod("b", F.lit(1 << 22)) - F.pmod("a", F.lit(1 << 22))
    lengths = inner.groupBy("component").agg(F.sum(F.sqrt((F.abs(dy) + F.abs(dx)).cast("double"))).alias("inside"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("pixels"))
    ends = touch.groupBy("img_id", "component").agg(
        F.count(F.lit(1)).alias("k"), F.sum("len").alias("outside"), F.min(F.struct("node_id", "step")).alias("a"), F.max("node_id").alias("b")
    )
    chains = ends.where("k = 2").join(sizes, "component").join(lengths, "component", "left").select(
        "img_id", F.col("a.node_id").alias("a"), "b", F.col("a.step").alias("step"),
        (F.col("outside") + F.coalesce("inside", F.lit(0.0))).alias("length"), (F.col("pixels") + 2).cast("long").alias("n_pix"),
    )
    direct = sent.join(named.select("img_id", "y", "x", F.col("node_id").alias("other")), ["img_id", "y", "x"]).where("node_id < other")
    direct = direct.select("img_id", F.col("node_id").alias("a"), F.col("other").alias("b"), "step", F.col("len").alias("length"), F.lit(2).cast("long").alias("n_pix"))
    raw = chains.where("a < b").unionByName(direct)
    first = Window.partitionBy("img_id", "a", "b", "n_pix").orderBy("step", "length")
    kept = raw.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    best = kept.groupBy("img_id", "a", "b").agg(F.min_by(F.struct("length", "n_pix"), F.struct("length", "step", "n_pix")).alias("m"))
    return nodes, best.select("img_id", "a", "b", "m.length", "m.n_pix")


def polyline_lengths(points: DataFrame, keys: list[str], order: list[str], x: str = "px", y: str = "py") -> DataFrame:
    """Rows (keys..., n_points, length): Euclidean lengths of point sequences."""
    w = Window.partitionBy(*keys).orderBy(*order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    steps = points.select(*keys, F.sqrt(dx * dx + dy * dy).alias("d"))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def trace_polylines(skeleton: DataFrame) -> DataFrame:
    """Rows (img_id, a, b, poly): the ordered pixels of each edge from a to b, one image per task.

    Only the figures and the stub directions need pixel order; lengths come from ``trace_edges``.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pixels = set(zip(frame["y"].tolist(), frame["x"].tolist(), strict=True))
        near = {p: [(p[0] + dy, p[1] + dx) for dy, dx in NEIGHBOURS if (p[0] + dy, p[1] + dx) in pixels] for p in pixels}
        ids = {p: i for i, p in enumerate(sorted(p for p in pixels if len(near[p]) == 1 or len(near[p]) >= 3))}
        seen, best = set(), {}
        for start, a in ids.items():
            for first in near[start]:
                path, here = [start, first], first
                while here not in ids:
                    onward = [q for q in near[here] if q != path[-2]]
                    if not onward:
                        break
                    here = onward[0]
                    path.append(here)
                if here not in ids or ids[here] == a:
                    continue
                b = ids[here]
                pair = (min(a, b), max(a, b))
                if (pair, len(path)) in seen:
                    continue
                seen.add((pair, len(path)))
                length = sum(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 for p, q in zip(path, path[1:], strict=False))
                if pair not in best or length < best[pair][0]:
                    best[pair] = (length, path if a < b else path[::-1])
        rows = [(frame["img_id"].iloc[0], a, b, [{"x": x, "y": y} for y, x in path]) for (a, b), (_, path) in best.items()]
        return pd.DataFrame(rows, columns=["img_id", "a", "b", "poly"])

    return skeleton.select("img_id", "y", "x").groupBy("img_id").applyInPandas(run, "img_id long, a long, b long, poly array<struct<x:int,y:int>>")
