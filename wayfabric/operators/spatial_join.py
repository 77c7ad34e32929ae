"""Distance joins on a grid: the range predicate becomes an equi-join on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.scratch import materialize


def grid_distance_join(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows with 0 < distance <= radius, as structs ``l`` and ``r`` with ``dist``.

    Both sides have (x, y); ``keys`` (such as img_id) must agree. A right row is filed in its cell, a
    left row looks into the nine cells around its own, so each pair meets once. Null coordinates
    match nothing.
    """
    cell = [(F.floor(F.col(c) / radius)).cast("long") for c in ("x", "y")]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    keyed = [F.col(k).alias(f"_k_{k}") for k in keys]
    a = left.select(F.struct(*left.columns).alias("l"), cell[0].alias("_cx"), cell[1].alias("_cy"), around.alias("_o"), *keyed)
    a = a.select("l", (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"), *[f"_k_{k}" for k in keys])
    b = right.select(F.struct(*right.columns).alias("r"), cell[0].alias("_cx"), cell[1].alias("_cy"), *keyed)
    dx, dy = (F.col(f"l.{c}").cast("double") - F.col(f"r.{c}") for c in ("x", "y"))
    square = dx * dx + dy * dy
    met = a.join(b, ["_cx", "_cy", *[f"_k_{k}" for k in keys]])
    return met.where((square > 0) & (square <= radius * radius)).select("l", "r", F.sqrt(square).alias("dist"))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, right_count_limit: int = 20_000) -> DataFrame:
    """Rows (left_id, right_id, dist): the nearest right row of each left row, ties to the smallest id.

    The grid finds everything nearer than ``radius``; left rows without a neighbour there look again at
    twice the radius, and so on until the radius spans all places, each round from a written table. Left
    rows without coordinates, and all of them where the right side is empty, have no row. A right side of
    at most ``right_count_limit`` rows (counted) is broadcast instead.
    """
    pick = F.min(F.struct("dist", "rid")).alias("m")
    if right.limit(right_count_limit + 1).count() <= right_count_limit:
        near = F.broadcast(right.select(F.col(right_id).alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")))
        dx, dy = (F.col(c).cast("double") - F.col(f"r{c}") for c in ("x", "y"))
        square = dx * dx + dy * dy
        met = left.join(near).select(F.col(left_id).alias("lid"), "rid", F.sqrt(square).alias("dist"))
        best = met.groupBy("lid").agg(pick)
        return best.select(F.col("lid").alias(left_id), F.col("m.rid").alias(right_id), F.col("m.dist").alias("dist"))
    right, todo = materialize(right.select(F.col(right_id).alias("rid"), "x", "y"), "right"), materialize(left, "todo")
    if right.isEmpty():
        none = F.lit(None).cast(right.schema["rid"].dataType)
        return todo.limit(0).select(left_id, none.alias(right_id), F.lit(None).cast("double").alias("dist"))
    ends = [F.coalesce(f(c).cast("double"), F.lit(0.0)) for c in ("x", "y") for f in (F.min, F.max)]
    box = right.select("x", "y").unionByName(todo.select("x", "y")).agg(*ends).first()
    reach = abs(box[1] - box[0]) + abs(box[3] - box[2])  # no two places are farther apart
    out = None
    while True:
        met = grid_distance_join(todo, right, radius).select(F.col(f"l.{left_id}").alias("lid"), F.col("r.rid").alias("rid"), "dist")
        same = todo.join(right, ["x", "y"]).select(F.col(left_id).alias("lid"), "rid", F.lit(0.0).alias("dist"))
        best = met.unionByName(same).groupBy("lid").agg(pick)
        found = materialize(best.select(F.col("lid").alias(left_id), F.col("m.rid").alias(right_id), F.col("m.dist").alias("dist")), "nearest")
        out = found if out is None else out.unionByName(found)
        if radius > reach:
            return out
        todo = materialize(todo.join(found.select(left_id), left_id, "left_anti"), "todo")
        if todo.isEmpty():
            return out
        radius *= 2
