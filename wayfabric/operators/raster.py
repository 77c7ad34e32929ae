"""Raster operators: cleaning, simulated occlusion, vector rasterising, recovered masks."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfabric.functions.stencil import NEIGHBOURS, close, inside, shifted
from wayfabric.operators.components import components

#: A pixel's place in its image as one long: 20 bits of image, 22 of y, 22 of x.
_Y, _IMG = 1 << 22, 1 << 44


def pixel_key() -> Column:
    """One long that names a pixel (img_id, y, x)."""
    return (F.col("img_id") * _IMG + F.col("y").cast("long") * _Y + F.col("x").cast("long")).cast("long")


def adjacency(mask: DataFrame, forward_only: bool = True) -> DataFrame:
    """8-neighbour pairs of foreground pixels as pixel keys (a, b); each pair once if ``forward_only``."""
    steps = [(dy, dx) for dy, dx in NEIGHBOURS if not forward_only or (dy, dx) > (0, 0)]
    arrows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    sent = mask.select(pixel_key().alias("a"), "img_id", "y", "x", arrows.alias("o"))
    sent = sent.select("a", "img_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return sent.join(mask.select("img_id", "y", "x"), ["img_id", "y", "x"]).select("a", pixel_key().alias("b"))


def label_components(mask: DataFrame) -> DataFrame:
    """Rows (img_id, y, x, component): 8-connected components, named by their smallest pixel key."""
    keyed = mask.select("img_id", "y", "x", pixel_key().alias("key"))
    found = components(keyed, adjacency(mask), node="key")
    return keyed.join(found, "key").select("img_id", "y", "x", "component")


def drop_small(mask: DataFrame, least: int = 60) -> DataFrame:
    """Pixels of 8-connected components of at least ``least`` pixels."""
    named = label_components(mask)
    large = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return named.join(large, "component", "left_semi").select("img_id", "y", "x")


def clean(mask: DataFrame, meta: DataFrame, kernel: int = 5, least: int = 60) -> DataFrame:
    """Closing, then removal of small components."""
    return drop_small(close(mask, meta, kernel), least)


def occlude(mask: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pixels outside every shape of their image.

    ``shapes`` has (img_id, kind, cx, cy, rx, ry): discs of radius rx, or boxes of half sizes rx, ry. A shape
    lists the rows that it touches, so the anti join has an equality on (img_id, y).
    """
    rows = shapes.select("*", F.explode(F.expr("sequence(cy - if(kind = 'disc', rx, ry), cy + if(kind = 'disc', rx, ry))")).alias("sy"))
    spans = rows.select(
        F.col("img_id").alias("s_img"),
        "sy",
        F.col("cx").alias("s_cx"),
        F.when(F.col("kind") == "disc", F.col("rx") * F.col("rx") - (F.col("sy") - F.col("cy")) * (F.col("sy") - F.col("cy")))
        .otherwise(F.col("rx") * F.col("rx"))
        .alias("reach2"),
    )
    hit = (F.col("img_id") == F.col("s_img")) & (F.col("y") == F.col("sy"))
    hit = hit & ((F.col("x") - F.col("s_cx")) * (F.col("x") - F.col("s_cx")) <= F.col("reach2"))
    return mask.join(spans, hit, "left_anti").select("img_id", "y", "x")


def random_shapes(mask: DataFrame, count: int = 40, max_radius: int = 16, seed: int = 7) -> DataFrame:
    """Seeded discs and, for every six of them (three at least), boxes, centred on foreground pixels.

    The draws choose ranks among the pixels in the order of md5(seed:pixel), so they do not depend on
    partitioning; an empty image gets no shapes.
    """
    rng = random.Random(seed)
    total = count + max(3, count // 6)
    plan = []
    for i in range(total):
        if i < count:
            r = rng.randint(6, max_radius)
            plan.append((i + 1, "disc", r, r))
        else:
            half, thick = rng.randint(14, 25), rng.randint(10, 17)
            plan.append((i + 1, "box", *((thick, half) if rng.random() < 0.5 else (half, thick))))
    spark = mask.sparkSession
    drawn = spark.createDataFrame(plan, "nth int, kind string, rx int, ry int")
    order = F.md5(F.concat(F.lit(f"{seed}:"), pixel_key().cast("string")))
    first = mask.withColumn("_o", order).groupBy("img_id", F.substring("_o", 1, 3).alias("_b")).agg(F.min(F.struct("_o", "x", "y")).alias("m"))
    nth = F.row_number().over(Window.partitionBy("img_id").orderBy("m"))
    centres = first.withColumn("nth", nth).where(F.col("nth") <= total)
    return centres.join(F.broadcast(drawn), "nth").select("img_id", "kind", F.col("m.x").alias("cx"), F.col("m.y").alias("cy"), "rx", "ry")


def rasterise_segments(segments: DataFrame, meta: DataFrame, width: float) -> DataFrame:
    """Pixels (img_id, y, x) within width / 2 of a segment (img_id, x0, y0, x1, y1), inside their image.

    Coverage is by distance of pixel centres. A segment lists the rows of its bounding box and, in each,
    only the columns that the row can touch, so long diagonals do not list their whole box.
    """
    half = width / 2
    d = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    seg = segments.select("img_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    seg = seg.withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0"))
    low, high = F.least("y0", "y1") - half, F.greatest("y0", "y1") + half
    rows = seg.withColumn("y", F.explode(F.sequence(F.ceil(low).cast("int"), F.floor(high).cast("int"))))
    # part of the segment whose rows are within half of this one
    t0 = F.when(F.col("dy") == 0, 0.0).otherwise((F.col("y") - half - F.col("y0")) / F.col("dy"))
    t1 = F.when(F.col("dy") == 0, 1.0).otherwise((F.col("y") + half - F.col("y0")) / F.col("dy"))
    a, b = F.greatest(F.lit(0.0), F.least(t0, t1)), F.least(F.lit(1.0), F.greatest(t0, t1))
    xa, xb = F.col("x0") + a * F.col("dx"), F.col("x0") + b * F.col("dx")
    rows = rows.withColumn("_lo", F.ceil(F.least(xa, xb) - half).cast("int")).withColumn("_hi", F.floor(F.greatest(xa, xb) + half).cast("int"))
    cells = rows.where("_lo <= _hi").withColumn("x", F.explode(F.sequence("_lo", "_hi")))
    t = F.when(d == 0, 0.0).otherwise(((F.col("x") - F.col("x0")) * F.col("dx") + (F.col("y") - F.col("y0")) * F.col("dy")) / d)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = F.col("x") - F.col("x0") - t * F.col("dx"), F.col("y") - F.col("y0") - t * F.col("dy")
    hit = cells.where(ex * ex + ey * ey <= half * half).select("img_id", "y", "x").distinct()
    return inside(meta, hit)


def polyline_segments(lines: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Consecutive vertices (keys..., x0, y0, x1, y1) of polylines ``points`` (array of x, y); nulls give none."""
    pair = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))
    rows = lines.where(F.col(points).isNotNull() & (F.size(points) > 1)).select(*keys, F.explode(pair).alias("p"))
    return rows.select(*keys, F.col("p.a.x").alias("x0"), F.col("p.a.y").alias("y0"), F.col("p.b.x").alias("x1"), F.col("p.b.y").alias("y1"))


def rasterise_roads(edges: DataFrame, width: int, height: int, line: float = 6, frame: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Longitude/latitude polylines (img_id, geometry) as pixels, with the bounds used per image.

    The bounds are those of the polylines, or ``frame`` (img_id, minx, miny, maxx, maxy), such as a raster's own. Spans are floored at 1e-9, coordinates are truncated to pixels, latitude points up.
    """
    vertex = edges.where("geometry is not null").select("img_id", F.explode("geometry").alias("p"))
    bounds = vertex.groupBy("img_id").agg(
        F.min("p.lon").alias("minx"), F.min("p.lat").alias("miny"), F.max("p.lon").alias("maxx"), F.max("p.lat").alias("maxy")
    )
    bounds = bounds if frame is None else frame.select(*bounds.columns)
    eps = 1e-9

    def pixel(p: Column) -> Column:
        px = ((p["lon"] - F.col("minx")) / F.greatest(F.col("maxx") - F.col("minx"), F.lit(eps)) * (width - 1)).cast("int")
        py = ((F.col("maxy") - p["lat"]) / F.greatest(F.col("maxy") - F.col("miny"), F.lit(eps)) * (height - 1)).cast("int")
        return F.struct(px.alias("x"), py.alias("y"))

    lines = edges.where("geometry is not null").join(bounds, "img_id").select("img_id", F.transform("geometry", pixel).alias("points"))
    meta = bounds.select("img_id", F.lit(height).alias("h"), F.lit(width).alias("w"))
    return rasterise_segments(polyline_segments(lines, ["img_id"]), meta, line), bounds


def occluded_region(whole: DataFrame, occluded: DataFrame) -> DataFrame:
    """Pixels that the occlusion took away."""
    return whole.select("img_id", "y", "x").join(occluded, ["img_id", "y", "x"], "left_anti")


def recovered(working: DataFrame, meta: DataFrame, nodes: DataFrame, bridges: DataFrame, width: float = 6) -> DataFrame:
    """The working mask with every bridge (a, b) of a node table drawn in."""
    at = nodes.select("img_id", "node_id", "x", "y")
    a = at.select("img_id", F.col("node_id").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = at.select("img_id", F.col("node_id").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    segments = bridges.select("a", "b").join(a, "a").join(b, ["img_id", "b"])
    return working.select("img_id", "y", "x").unionByName(rasterise_segments(segments, meta, width)).distinct()
