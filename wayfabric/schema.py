"""Schemas of the engine's tables. Rasters are sparse: a row per foreground pixel of an image."""

from __future__ import annotations

PIXELS = "img_id long, y int, x int, r int, g int, b int"
MASK = "img_id long, y int, x int"
NODES = "img_id long, node_id long, x int, y int"
EDGES = "img_id long, a long, b long, length double, poly array<struct<x:int,y:int>>, healed boolean"
BRIDGES = "a long, b long, dist double, pass string"
STEPS = (
    "step int, removed_node long, removed_count int, avg_path_len double, resilience_index double,"
    " efficiency double, efficiency_retained double, lcc_frac double, reachable_pairs long"
)
