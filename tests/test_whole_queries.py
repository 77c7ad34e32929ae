"""Queries over whole tables against brute force on the smallest ones."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pytest

from wayfabric.queries import QUERIES
from wayfabric.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def distances(spark):
    """All (src, dst): distance of the fixture graph, by Dijkstra from every node."""
    steps = defaultdict(list)
    for r in fx.geo_edges(spark, SF).collect():
        steps[r["a"]].append((r["b"], r["w"]))
        steps[r["b"]].append((r["a"], r["w"]))
    out = {}
    for r in fx.geo_nodes(spark, SF).collect():
        src, heap = r["node_id"], [(0, r["node_id"])]
        while heap:
            d, v = heapq.heappop(heap)
            if (src, v) not in out:
                out[src, v] = d
                for u, w in steps[v]:
                    heapq.heappush(heap, (d + w, u))
    return out


@pytest.mark.parametrize("name", ["shortest_paths", "shortest_paths_relaxed"])
def test_distances_from_every_node(spark, distances, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == len(distances) and {(r["src"], r["dst"]): r["dist"] for r in rows} == distances


def test_mean_path_of_all_pairs(spark, distances):
    reached = defaultdict(set)
    for a, b in distances:
        reached[a].add(b)
    core = min((reached[a] for a in reached), key=lambda c: (-len(c), min(c)))
    want = [d for (a, b), d in distances.items() if a in core and a < b]
    got = QUERIES["mean_path_on_largest"](spark, SF).collect()
    assert len(got) == 1 and got[0]["pairs"] == len(want)
    assert got[0]["avg_path_len"] == pytest.approx(sum(want) / len(want), abs=1e-4)


def test_every_segment_is_drawn(spark):
    rows = [(r["vec_id"], math.floor(float(r["embedding"][2]) * 60 + 32)) for r in fx.table(spark, SF, "embeddings").collect()]
    height, want = max(y for y, _ in rows) + 1, set()
    for y0, x1 in rows:
        dx, dy = x1 - 5, 4
        for y in range(max(0, y0 - 3), min(height, y0 + 8)):
            for x in range(64):
                t = max(0.0, min(1.0, ((x - 5) * dx + (y - y0) * dy) / (dx * dx + dy * dy)))
                if (x - 5 - t * dx) ** 2 + (y - y0 - t * dy) ** 2 <= 2.25:
                    want.add((y, x))
    assert {(r["y"], r["x"]) for r in QUERIES["vector_raster"](spark, SF).collect()} == want


def test_stress_queries_use_250_pairs(spark):
    pairs = QUERIES["connected_pairs"](spark, SF).collect()
    assert [r["pair_id"] for r in pairs] == list(range(250))
    steps = QUERIES["stress_by_degree"](spark, SF).orderBy("step").collect()
    assert len(steps) == 9 and steps[0]["reachable_pairs"] == 250
    whatif = QUERIES["what_if"](spark, SF).collect()
    three = steps[3]
    # what_if draws 250 of 250: the core is connected, so its pairs are the same
    assert whatif[0]["reachable_pairs"] == three["reachable_pairs"] and abs(whatif[0]["resilience_index"] - three["resilience_index"]) < 1e-3
