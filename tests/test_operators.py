"""Hand-made cases and brute-force comparisons of the graph engine's operators."""

from __future__ import annotations

import json
import random
import tracemalloc
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest

from wayfabric.config import HealSettings, Settings, area_bounds
from wayfabric.functions import pixels, stencil
from wayfabric.operators import ablation, graph, heal, paths, raster, skeleton
from wayfabric.operators import components as components_module
from wayfabric.operators.components import components, components_of_edges
from wayfabric.operators.spatial_join import nearest
from wayfabric.plans import export


def mask_of(spark, text: list[str]):
    rows = [(0, y, x) for y, line in enumerate(text) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "img_id long, y int, x int")


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "a long, b long, length double")


def nodes_of(spark, points):
    return spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(points)], "img_id long, node_id long, x int, y int")


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_slanted_lines_have_no_junctions():
    rng = np.random.default_rng(4)
    yy, xx = np.mgrid[:90, :140]
    for _ in range(30):
        y0, x0, y1, x1 = rng.uniform(15, 75), rng.uniform(15, 125), rng.uniform(15, 75), rng.uniform(15, 125)
        d = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = np.clip(((xx - x0) * (x1 - x0) + (yy - y0) * (y1 - y0)) / d, 0, 1)
        line = np.pad(skeleton.thin((xx - x0 - t * (x1 - x0)) ** 2 + (yy - y0 - t * (y1 - y0)) ** 2 <= 9), 1).astype(int)
        count = sum(np.roll(line, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - line
        assert (count[line == 1] <= 2).all() and (count[line == 1] == 1).sum() == (2 if line.sum() > 1 else 0)


def test_thinning_keeps_components():
    def groups(image):
        at = {tuple(p) for p in np.argwhere(image).tolist()}
        pairs = [((y, x), (y + dy, x + dx)) for y, x in at for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)) if (y + dy, x + dx) in at]
        return len(set(union_find(pairs, at).values()))

    rng = np.random.default_rng(0)
    for k in range(60):
        image = rng.random((24, 30)) < 0.3 + 0.4 * rng.random()
        for _ in range(k % 3):
            image = image | np.roll(image, 1, 0) | np.roll(image, 1, 1)
        stairs = image & (rng.random(image.shape) < 0.8)
        assert groups(skeleton.without_stairs(stairs)) == groups(stairs)


@pytest.mark.parametrize("seed", range(2))
def test_star_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long")
    want = union_find(pairs, {x for p in pairs for x in p})
    assert {r["node"]: r["component"] for r in components_of_edges(df).collect()} == want
    nodes = spark.range(0, 240).withColumnRenamed("id", "node_id")
    small = {r["node_id"]: r["component"] for r in components(nodes, df).collect()}
    large = {r["node_id"]: r["component"] for r in components(nodes, df, one_task=0).collect()}
    assert small == large == union_find(pairs, range(240))


def test_small_components_need_no_rounds(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(2500)] + [(i, i + 1) for i in range(5000, 8000)] + [(9000, 9000)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = union_find(pairs, {x for p in pairs for x in p})
    assert {r["node"]: r["component"] for r in components_of_edges(df, one_task=0).collect()} == want
    monkeypatch.setattr(components_module, "CHUNK", 100)
    monkeypatch.setattr(components_module, "_star", None)  # the rounds
    assert {r["node"]: r["component"] for r in components_of_edges(df).collect()} == want


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components_of_edges(none).count() == 0
    assert graph.largest_component(spark.createDataFrame([], "node_id long"), none).count() == 0


def test_ring_without_nodes_vanishes(spark):
    _, edges = skeleton.trace_edges(mask_of(spark, [".##.", "#..#", "#..#", ".##."]))
    assert edges.count() == 0


def test_line_and_isolated_pixel(spark):
    nodes, edges = skeleton.trace_edges(mask_of(spark, ["#####..", "......#"[:6] + "."]))
    assert nodes.count() == 2
    row = edges.first()
    assert (row["a"], row["b"], row["length"], row["n_pix"]) == (0, 1, 4.0, 5)
    assert skeleton.node_pixels(mask_of(spark, ["#..", "...", "..#"])).count() == 0


def test_trace_matches_walk(spark):
    rng = random.Random(5)
    for _ in range(2):
        text = ["".join("#" if rng.random() < 0.35 else "." for _ in range(14)) for _ in range(14)]
        mask = mask_of(spark, text)
        _, edges = skeleton.trace_edges(mask)
        walked = skeleton.trace_polylines(mask).collect()

        def length(poly):
            return round(sum(((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2) ** 0.5 for p, q in zip(poly, poly[1:], strict=False)), 6)

        assert {(r["a"], r["b"], round(r["length"], 6)) for r in edges.collect()} == {(r["a"], r["b"], length(r["poly"])) for r in walked}


def test_thinning_is_thin_and_connected():
    image = np.zeros((40, 60), dtype=bool)
    image[10:17, 5:55] = image[5:35, 28:35] = True
    thin = skeleton.thin(image)
    assert thin.sum() < image.sum() / 4 and not (thin & ~image).any()
    assert not (thin[:-1, :-1] & thin[1:, :-1] & thin[:-1, 1:] & thin[1:, 1:]).any()


def bridges(spark, points, edges, cfg=HealSettings()):
    out, found, stats = heal.heal(nodes_of(spark, points), edges_of(spark, edges), cfg)
    return {(r["a"], r["b"], r["pass"]) for r in found.collect()}, stats.first(), out


def test_collinear_stubs_are_bridged(spark):
    points = [(0, 0), (30, 0), (50, 0), (80, 0)]
    found, stats, out = bridges(spark, points, [(0, 1, 30), (2, 3, 30)])
    assert found == {(1, 2, "mst")} and stats["bridges_added"] == 1
    assert out.where("healed").first()["length"] == 20.0


def test_perpendicular_stubs_are_not(spark):
    found, stats, _ = bridges(spark, [(0, 0), (30, 0), (40, 10), (40, 40)], [(0, 1, 30), (2, 3, 30)])
    assert found == set() and stats["endpoints"] == 4


def test_three_components_need_two_bridges(spark):
    points = [(0, 0), (30, 0), (50, 0), (80, 0), (100, 0), (130, 0)]
    found, _, _ = bridges(spark, points, [(0, 1, 30), (2, 3, 30), (4, 5, 30)])
    assert found == {(1, 2, "mst"), (3, 4, "mst")}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_forest_and_matching_match_the_sorted_passes(spark, one_task):
    rng = random.Random(11)
    for _ in range(2):
        cand = sorted({(rng.randrange(30), rng.randrange(30, 60)) for _ in range(60)})
        rows = [(a, b, 1.0, float(rng.randrange(8))) for a, b in cand]
        df = spark.createDataFrame(rows, "a long, b long, dist double, cost double")
        label = {n: n // 2 * 2 for n in range(60)}
        labels = spark.createDataFrame(list(label.items()), "node_id long, component long")
        want, comp = set(), dict(label)
        for a, b, _, _ in sorted(rows, key=lambda r: (r[3], r[0], r[1])):
            if comp[a] != comp[b]:
                want.add((a, b))
                old, new = comp[a], comp[b]
                comp = {n: new if c == old else c for n, c in comp.items()}
        got = {(r["a"], r["b"]) for r in heal.spanning_bridges(df, labels, one_task).collect()}
        assert got == want
        used = {0, 31, 32}
        match, taken = set(), set(used)
        for a, b, _, _ in sorted(rows, key=lambda r: (r[3], r[0], r[1])):
            if a not in taken and b not in taken:
                match.add((a, b))
                taken |= {a, b}
        found = heal.stub_matching(df, spark.createDataFrame([(u,) for u in used], "node_id long"), one_task)
        assert {(r["a"], r["b"]) for r in found.collect()} == match


def random_graph(seed, n=24, m=45):
    rng = random.Random(seed)
    rows = {(min(a, b), max(a, b)): rng.randrange(1, 6) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    return [(a, b, w) for (a, b), w in rows.items()]


def test_large_graph_forms_agree(spark):
    rows = random_graph(3)
    edges = spark.createDataFrame(rows, "a long, b long, weight long")
    nodes = spark.range(24).withColumnRenamed("id", "node_id")
    near = paths.betweenness(nodes, edges)
    far = paths.betweenness(nodes, edges, limit=0)
    for small, large, keys in zip(near, far, (("node_id",), ("a", "b")), strict=True):
        one = {tuple(r[k] for k in keys): round(r["bc"], 9) for r in small.collect()}
        two = {tuple(r[k] for k in keys): round(r["bc"], 9) for r in large.collect()}
        assert one == two


@pytest.mark.parametrize("limit", [paths.BROADCAST_EDGES, 0])
def test_searches_stay_in_tasks(spark, monkeypatch, limit):
    def rounds(*_):
        raise AssertionError("a graph that fits a task went through DataFrame rounds")

    monkeypatch.setattr(paths, "relax", rounds)
    rows = [*random_graph(8, 40, 70), (100, 101, 0), (101, 102, 7), (102, 102, 3)]
    edges = spark.createDataFrame(rows, "a long, b long, weight long")
    nodes = sorted({x for r in rows for x in r[:2]})

    def brute(gone):
        best = {(x, x): 0 for x in [*nodes, 999] if x not in gone}
        steps = [r for a, b, w in rows for r in ((a, b, w), (b, a, w)) if not {a, b} & set(gone)]
        for _ in nodes:
            for (s, v), d in list(best.items()):
                for a, b, w in steps:
                    if a == v and d + w < best.get((s, b), 1 << 60):
                        best[s, b] = d + w
        return best

    sources = spark.createDataFrame([(x,) for x in [*nodes, 999, 5]], "src long")
    found = paths.distances(edges, sources, limit=limit).collect()
    whole = brute([])
    assert len(found) == len(whole) and {(r["src"], r["dst"]): r["dist"] for r in found} == whole
    sums = {r["src"]: (r["total"], r["n"]) for r in paths.distance_sums(edges, sources, limit=limit).collect()}
    assert sums == {x: (sum(d for (s, t), d in whole.items() if s == x < t), sum(s == x < t for s, t in whole)) for x in [*nodes, 999]}
    closed = {1: [nodes[3]], 2: [nodes[3], nodes[7], 12345]}
    asked = [(k, s, t) for k in range(3) for s in [*nodes[:12], 999] for t in [*nodes[5:], 999]]
    pairs = spark.createDataFrame(asked, "step int, src long, dst long")
    got = {(r["step"], r["src"], r["dst"]): r["dist"] for r in paths.pair_distances(edges, pairs, closed=closed, limit=limit).collect()}
    want = {k: brute(closed.get(k, [])) for k in range(3)}
    assert got == {(k, s, t): want[k][s, t] for k, s, t in asked if (s, t) in want[k] and s not in closed.get(k, [])}


@pytest.mark.parametrize("real", [False, True])
def test_led_searches_equal_whole_ones(real):
    rng = np.random.default_rng(4)
    at = rng.integers(0, 60, (300, 2))
    rows = [(i, j) for i in range(300) for j in range(i) if np.abs(at[i] - at[j]).max() <= 5 and (i % 7 or j % 5)]
    w = [float(np.hypot(*(at[i] - at[j]))) if real else int(round(10 * np.hypot(*(at[i] - at[j])))) for i, j in rows]
    rows, w = [*rows, (500, 501), (501, 502)], [*w, 3, 4]
    g = paths.Adjacency.of_edges(pd.DataFrame({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "w": w}))
    n = len(g.ids)
    src, dst = rng.integers(0, n, (2, 80))
    src[:3], dst[:3] = g.places([500, 500, 7]), g.places([502, 7, 7])
    closed = [rng.choice(n, k % 40, replace=False) for k in range(80)]
    for count in (0, 4):
        marks = g.marks(0, count)
        for shut in (None, closed):
            found, ways = g.between(src, dst, marks, shut)
            want = g.distances(src, shut)[np.arange(80), dst]
            assert np.array_equal(found, want)
            length = {(int(a), int(g.dst[k])): g.weight[k] for a in range(n) for k in range(g.start[a], g.start[a + 1])}
            for k, way in enumerate(ways):
                if way is None:  # no length, or a sum of floats in another order
                    continue
                if found[k] == g.far:
                    assert not len(way)
                else:
                    assert way[0] == dst[k] and way[-1] == src[k]
                    assert sum(length[int(a), int(b)] for a, b in pairwise(way)) == pytest.approx(found[k])
                    assert shut is None or not np.isin(way, shut[k]).any()
        assert sum(way is None for way in ways) < 20


@pytest.mark.parametrize("limit", [paths.BROADCAST_EDGES, 0])
def test_steps_search_anew_only_where_they_cut_the_path(spark, monkeypatch, limit):
    rows = [(i, i + 1, 1) for i in range(40)] + [(3, 6, 9)]
    edges = spark.createDataFrame(rows, "a long, b long, weight long")
    pairs = spark.createDataFrame([(k, s, s + 10) for k in range(4) for s in range(20)] + [(0, 77, 77)], "step int, src long, dst long")
    closed = {1: [35], 2: [35, 4], 3: [35, 4, 25]}
    got = {(r["step"], r["src"]): r["dist"] for r in paths.pair_distances(edges, pairs, closed=closed, limit=limit).collect()}
    want = {}
    for k in range(4):
        for s in range(20):
            gone = set(closed.get(k, []))
            if s in gone or s + 10 in gone or (25 in gone and s < 25 < s + 10):
                continue
            if 4 in gone and s < 4 < s + 10:
                if s <= 3 and s + 10 >= 6:
                    want[k, s] = 10 + 9 - 3
                continue
            want[k, s] = 10
    assert got == want | {(0, 77): 0}
    calls, between = [], paths.Adjacency.between
    monkeypatch.setattr(paths.Adjacency, "between", lambda self, s, *a: calls.append(len(s)) or between(self, s, *a))
    g = paths.Adjacency.of_edges(pd.DataFrame(rows, columns=["a", "b", "w"]))
    shut = {k: g.places(v) for k, v in closed.items()}
    found = paths._led(g, [(int(g.places([s])[0]), int(g.places([s + 10])[0]), [0, 1, 2, 3]) for s in range(20)], shut, g.marks(0, 2))
    assert {(k, s): d for k, s, _, d in found} == want
    assert sum(calls) < 40  # 80 if every step were searched


def test_dependencies_look_at_some_edges_at_a_time():
    rng = np.random.default_rng(2)
    a, b = np.triu_indices(1500, 1)
    g = paths.Adjacency.of_edges(pd.DataFrame({"a": a, "b": b, "w": rng.integers(1, 60_000, len(a))}))
    dist = g.distances(np.array([3]))[0]
    on = np.flatnonzero(np.repeat(dist, g.degree) + g.weight == dist[g.dst])
    tracemalloc.start()
    _, u, v, _ = g.dependencies(3, dist)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted(zip((np.searchsorted(g.start, on, side="right") - 1).tolist(), g.dst[on].tolist(), strict=True))
    assert peak < 30e6  # three times 18 MB where all edges are looked at at once


@pytest.mark.parametrize("limit", [paths.BROADCAST_EDGES, 0])
def test_sampled_betweenness_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(paths, "STEPS", 7)
    rows = random_graph(5)
    edges, nodes = spark.createDataFrame(rows, "a long, b long, weight long"), spark.range(24).withColumnRenamed("id", "node_id")
    steps = [r for a, b, w in rows for r in ((a, b, w), (b, a, w))]

    def ways(s):
        dist, count = {s: 0}, {s: 1}
        for _ in range(24):
            for a, b, w in steps:
                if a in dist and dist[a] + w < dist.get(b, 1 << 60):
                    dist[b] = dist[a] + w
        for t in sorted(dist, key=dist.get)[1:]:
            count[t] = sum(count[a] for a, b, w in steps if b == t and a in dist and dist[a] + w == dist[t])
        return dist, count

    all_ways = {s: ways(s) for s in range(24)}
    want = dict.fromkeys(range(24), 0.0)
    for s in (r["src"] for r in paths.sample_sources(nodes, 6).collect()):
        dist, count = all_ways[s]
        for v in set(dist) - {s}:
            far, more = all_ways[v]
            want[v] += sum(count[v] * more[t] / count[t] for t in set(dist) - {s, v} if dist[v] + far[t] == dist[t])
    got = {r["node_id"]: r["bc"] for r in paths.betweenness(nodes, edges, k=6, limit=limit)[0].collect()}
    assert got == pytest.approx({v: x * 24 / 6 / (23 * 22) for v, x in want.items()})


def test_every_task_gets_its_share_of_the_sources(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(50)], "a long, b long, weight long")
    sources = spark.range(50).withColumnRenamed("id", "src").coalesce(1)

    def run(g, frames):
        yield pd.DataFrame({"n": [sum(len(f) for f in frames)], "size": [len(g.dst)]})

    got = [(r["n"], r["size"]) for r in paths.on_graph(edges, "weight", sources, run, "n long, size long", 0).collect()]
    tasks = spark.sparkContext.defaultParallelism
    assert len(got) == tasks and sum(n for n, _ in got) == 50 and max(n for n, _ in got) <= -(-50 // tasks) and {size for _, size in got} == {100}


def test_blocks_hold_each_edge_once(spark):
    rng = np.random.default_rng(8)
    pairs = {(int(min(x)), int(max(x))) for x in rng.choice(10_000, (900, 2)) if x[0] != x[1]}
    rows = [(b, a, 3 * a + b) if a % 2 else (a, b, 3 * a + b) for a, b in sorted(pairs)]
    df = spark.createDataFrame(rows, "a long, b long, w long")
    found = paths.neighbour_blocks(df).toPandas()
    blocks = [
        (np.frombuffer(r.heads, np.int64), np.frombuffer(r.many, np.int64), np.frombuffer(r.near, r.near_kind), np.frombuffer(r.w, r.w_kind)) for r in found.itertuples()
    ]
    assert sum(len(b[2]) for b in blocks) == len(rows)
    one, two = paths.Adjacency.of_blocks(blocks, np.dtype("int64")), paths.Adjacency.of_edges(df.toPandas())
    ends = [sorted(zip(g.ids[np.repeat(np.arange(len(g.ids)), g.degree)].tolist(), g.ids[g.dst].tolist(), g.weight.tolist(), strict=True)) for g in (one, two)]
    assert ends[0] == ends[1] and len(ends[0]) == 2 * len(rows)


@pytest.mark.parametrize("held", [4_000_000, 40])
def test_edge_sums_are_handed_on_once_per_task(spark, monkeypatch, held):
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), int(w) + 1) for a, b, w in rng.integers(0, 40, (150, 3)) if a != b]
    edges = graph.build_graph(spark.createDataFrame(rows, "a long, b long, length long")).select("a", "b", "weight")
    whole = edges.toPandas()
    monkeypatch.setattr(paths, "TILE", 40)  # one source a tile
    sources = spark.range(40).withColumnRenamed("id", "src")
    g = paths.Adjacency.of_edges(whole.rename(columns={"weight": "w"}))
    monkeypatch.setattr(paths, "HELD", held)
    monkeypatch.setattr(paths, "on_graph", lambda e, w, src, run, *_: list(run(g, iter([pd.DataFrame({"src": g.ids})]))))
    found = pd.concat(paths._search(edges, sources, "weight", 0))
    sums = found[found["b"].notna()]
    if held > 40:
        assert len(sums) <= len(whole)
    want = {}
    for place, dist in zip(range(len(g.ids)), g.distances(np.arange(len(g.ids))), strict=True):
        _, a, b, d = g.dependencies(place, dist)
        for x, y, v in zip(g.ids[a].tolist(), g.ids[b].tolist(), d.tolist(), strict=True):
            want[min(x, y), max(x, y)] = want.get((min(x, y), max(x, y)), 0) + v
    got = sums.groupby(["a", "b"])["d"].sum()
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_two_node_graph_has_no_betweenness(spark):
    node_bc, edge_bc = paths.betweenness(spark.range(2).withColumnRenamed("id", "node_id"), spark.createDataFrame([(0, 1, 5)], "a long, b long, weight long"))
    assert {r["bc"] for r in node_bc.collect()} == {0.0} and edge_bc.first()["bc"] == 1.0


def test_index_above_one_is_not_clamped(spark):
    # one far pair: cutting it replaces its distance by three times the mean, which is less
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1000)], "a long, b long, weight long")
    nodes = spark.range(5).withColumnRenamed("id", "node_id")
    pairs = spark.createDataFrame([(i, 0, 1) for i in range(9)] + [(9, 0, 4)], "pair_id long, src long, dst long")
    steps = ablation.stress(nodes, edges, spark.createDataFrame([(1, 3), (2, 77)], "step int, node_id long"), pairs).orderBy("step").collect()
    assert steps[0]["resilience_index"] == 1.0 and steps[1]["resilience_index"] > 1.0
    assert [s["removed_count"] for s in steps] == [0, 1, 1] and steps[2]["removed_node"] == 77


def test_severity_bounds(spark):
    rows = spark.createDataFrame([(0.59,), (0.6,), (0.84,), (0.85,)], "r double").select(ablation.severity(__import__("pyspark").sql.functions.col("r")).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["severe", "warning", "warning", "ok"]


def test_nearest_by_grid_and_by_broadcast(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(i, rng.randrange(400), rng.randrange(400)) for i in range(40)], "i long, x int, y int")
    right = spark.createDataFrame([(i, rng.randrange(400), rng.randrange(400)) for i in range(9)], "j long, x int, y int")
    one = {(r["i"], r["j"]) for r in nearest(left, right, "i", "j", 10.0).collect()}
    two = {(r["i"], r["j"]) for r in nearest(left, right, "i", "j", 10.0, right_count_limit=0).collect()}
    assert one == two and len(one) == 40


def test_small_images(spark):
    white = spark.createDataFrame([(1, 0, x, 255, 255, 255) for x in range(40)], "img_id long, y int, x int, r int, g int, b int")
    assert pixels.road_mask(white).count() == 0  # two-tone, all bright: the dark side is sparser
    ramp = spark.createDataFrame([(2, 0, x, 6 * x, 6 * x, 6 * x) for x in range(40)], "img_id long, y int, x int, r int, g int, b int")
    assert {r["img_id"] for r in pixels.road_mask(white.union(ramp)).collect()} == {2}


def test_empty_mask(spark):
    none = spark.createDataFrame([], "img_id long, y int, x int")
    meta = spark.createDataFrame([(0, 9, 9)], "img_id long, h int, w int")
    assert stencil.close(none, meta).count() == 0
    assert raster.drop_small(none).count() == 0
    assert raster.random_shapes(none).count() == 0
    nodes, edges = skeleton.trace_edges(none)
    assert nodes.count() == edges.count() == 0


def test_images_are_read_in_rgb_order(spark, tmp_path):
    import struct
    import zlib

    from wayfabric.sources.images import read_images

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([10 * y + x, 100, 200]) * 1 for y in range(2) for x in [0])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got, meta = read_images(spark, str(tmp_path))
    assert {(r["y"], r["x"], r["r"], r["g"], r["b"]) for r in got.collect()} == {(0, 0, 0, 100, 200), (1, 0, 10, 100, 200)}
    assert (meta.first()["h"], meta.first()["w"]) == (2, 1)


def test_areas_and_modes(spark):
    from wayfabric.sources.images import resolve

    assert len(area_bounds("hazaribagh_town")) == 4
    with pytest.raises(ValueError):
        area_bounds("nowhere")
    with pytest.raises(ValueError):
        resolve(spark, Settings(mode="radar"))
    assert resolve(spark, Settings(mode="osm"), "/nonexistent.json")["notes"]["input"] == "synthetic_fallback"


def test_end_to_end_on_a_small_grid(spark, monkeypatch):
    from wayfabric.plans import resilience
    from wayfabric.sources.synthetic import road_grid

    meta = spark.createDataFrame([(0, 150, 260)], "img_id long, h int, w int")
    seg = spark.createDataFrame([(0, *s) for s in road_grid(150, 260)], "img_id long, x0 int, y0 int, x1 int, y1 int")
    source = {"mask": raster.rasterise_segments(seg, meta, 4.0), "meta": meta, "notes": {"input": "synth"}}
    monkeypatch.setattr(resilience, "resolve", lambda *a, **k: source)
    from wayfabric.config import CriticalitySettings, MaskSettings

    cfg = Settings(mode="synth", mask=MaskSettings(occlusions=4, occlusion_max_radius=6), criticality=CriticalitySettings(top_n=2, pairs=30))
    out = resilience.run(spark, cfg)
    report = json.loads(out["report"].first()["value"])
    seg_scores, conn, healing = report["segmentation"], report["connectivity"], report["healing"]
    assert conn["num_components_before"] - healing["bridges_mst"] == conn["num_components_after"]
    assert healing["bridges_added"] == healing["bridges_mst"] + healing["bridges_stub_repair"]
    assert abs(seg_scores["dice"] - 2 * seg_scores["iou"] / (1 + seg_scores["iou"])) < 2e-4
    assert report["steps"][0]["resilience_index"] == 1.0 and len(report["gatekeepers"]) == 2
    text = out["geojson"].first()["value"]
    assert len(json.loads(text)["features"]) == out["features"].count()
    assert "__DATA__" not in export.map_page(text)


def test_streamed_rates_equal_batch(spark, tmp_path):
    SF = "/root/testdata/sf0.001"

    from wayfabric.streaming.closures import closure_rates

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = closure_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["kind"], r["n"]) for r in spark.table("rates").collect()}
    assert got == {(r["start"], r["kind"], r["n"]) for r in closure_rates(events).collect()}


def test_network_scores_tiles(spark, tmp_path):
    from wayfabric.operators import network, tiles
    from wayfabric.sources.synthetic import training_tile

    weights = network.random_weights(base=4, seed=1)
    np.savez(tmp_path / "w.npz", **weights)
    image, mask = training_tile(40, 3)
    assert 0 < mask.mean() < 1
    p = network.scorer(weights)(image)
    assert p.shape == (40, 40) and ((p > 0) & (p < 1)).all()
    pixels_ = [(0, y, x, *map(int, image[y, x])) for y in range(40) for x in range(40)]
    df = spark.createDataFrame(pixels_, "img_id long, y int, x int, r int, g int, b int")
    meta = spark.createDataFrame([(0, 40, 40)], "img_id long, h int, w int")
    whole = tiles.mosaic(tiles.score_tiles(df, meta, tiles.load_scorer(str(tmp_path / "w.npz")), 40, 0)).toPandas()
    assert np.allclose(whole.sort_values(["y", "x"])["p"].to_numpy().reshape(40, 40), p, atol=1e-5)
    parts = tiles.mosaic(tiles.score_tiles(df, meta, tiles.load_scorer(str(tmp_path / "w.npz")), 16, 4))
    assert parts.count() == 1600
    np.savez(tmp_path / "bad.npz", x=np.zeros(1))
    with pytest.raises(ValueError):
        network.load(str(tmp_path / "bad.npz"))
    with pytest.raises(FileNotFoundError):
        tiles.load_scorer(str(tmp_path / "none.npz"))


def test_convolution_against_direct_sums():
    from wayfabric.operators.network import conv, resize

    rng = np.random.default_rng(0)
    x, k = rng.normal(size=(2, 6, 7)).astype(np.float32), rng.normal(size=(3, 2, 3, 3)).astype(np.float32)
    for d in (1, 2):
        got = conv(x, k, d)
        for o, y, z in ((0, 0, 0), (2, 3, 4), (1, 5, 6)):
            want = sum(
                k[o, c, i, j] * x[c, y + d * (i - 1), z + d * (j - 1)]
                for c in range(2) for i in range(3) for j in range(3)
                if 0 <= y + d * (i - 1) < 6 and 0 <= z + d * (j - 1) < 7
            )
            assert abs(got[o, y, z] - want) < 1e-4
    assert np.allclose(resize(np.ones((1, 3, 3), np.float32), 7, 5), 1)


def test_training_tiles_keep_masks_in_step(spark):
    from wayfabric.operators.tiles import occlude_tiles
    from wayfabric.sources.synthetic import training_tiles

    made = training_tiles(spark, 6, 32)
    again = occlude_tiles(made).collect()
    before = {r["tile_id"]: np.frombuffer(r["mask"], np.uint8).sum() for r in made.collect()}
    assert {r["tile_id"]: np.frombuffer(r["mask"], np.uint8).sum() for r in again} == before


def test_training_pairs_are_cut_from_images(spark):
    from wayfabric.sources.synthetic import training_pairs

    meta = spark.createDataFrame([(0, 20, 20)], "img_id long, h int, w int")
    rows = [(0, y, x, y, x, 7) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(rows, "img_id long, y int, x int, r int, g int, b int")
    mask = spark.createDataFrame([(0, 9, x) for x in range(20)], "img_id long, y int, x int")
    out = training_pairs(df, mask, meta, tile=8, step=6).orderBy("tile_id").collect()
    assert len(out) == 3  # of the tiles from rows 0, 6 and 12 only the second holds row 9
    image = np.frombuffer(out[0]["img"], np.uint8).reshape(8, 8, 3)
    truth = np.frombuffer(out[0]["mask"], np.uint8).reshape(8, 8)
    assert image[0, 0].tolist()[2] == 7 and truth.sum() == 8
