"""Road download, GeoTIFF windows, training, saved runs and nearest neighbours, on small fixtures."""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfabric.config import HealSettings, Settings
from wayfabric.operators import heal, tiles, training
from wayfabric.operators.network import forward, random_weights
from wayfabric.operators.spatial_join import nearest
from wayfabric.plans import explore
from wayfabric.sources import images, roads, synthetic


def way(k, nodes):
    return {"type": "way", "id": k, "nodes": nodes, "geometry": [{"lon": n / 10, "lat": n % 3} for n in nodes]}


ANSWER = json.dumps({"elements": [way(1, [1, 2, 3, 4]), way(2, [5, 3, 6]), way(2, [5, 3, 6]), way(3, [9]), {"type": "node", "id": 8}, way(4, [7, 10, 11, 7])]})


def test_ways_are_cut_where_they_meet(spark):
    got = {(r["u"], r["v"], len(r["geometry"])) for r in roads.roads_of(spark, ANSWER).collect()}
    assert got == {(1, 3, 3), (3, 4, 2), (5, 3, 2), (3, 6, 2), (7, 7, 4)}
    assert roads.roads_of(spark, '{"elements": []}').count() == 0


def test_servers_are_tried_in_order():
    asked = []

    def fetch(server, question, seconds):
        asked.append((server, "area[" in question, seconds))
        if len(asked) == 1:
            raise OSError("no route")
        return ["", "not json", '{"elements": []}', "{}", ANSWER][len(asked) - 1]

    assert roads.download("hazaribagh_full", fetch) == ANSWER
    first, second, third = roads.SERVERS
    assert asked == [(first, True, 90), (first, False, 90), (second, True, 90), (second, False, 90), (third, True, 90)]
    with pytest.raises(RuntimeError):
        roads.download("hazaribagh_town", lambda *a: '{"elements": []}')
    with pytest.raises(ValueError):
        roads.download("nowhere", fetch)


def test_roads_come_from_servers_or_give_way(spark):
    found = images.resolve(spark, Settings(mode="osm"), fetch=lambda *a: ANSWER)
    assert found["notes"] == {"input": "osm", "osm_nodes": 6, "osm_edges": 5}

    def fail(*a):
        raise OSError("offline")

    notes = images.resolve(spark, Settings(mode="osm"), fetch=fail)["notes"]
    assert notes["input"] == "synthetic_fallback" and "offline" in notes["osm_error"]

    def wrong(*a):
        raise AttributeError("a programming error")

    with pytest.raises(AttributeError):
        images.resolve(spark, Settings(mode="osm"), fetch=wrong)


def test_raster_windows_are_batches(monkeypatch):
    bands = np.arange(2 * 5 * 3, dtype=np.uint16).reshape(2, 5, 3)

    class File:
        count, height, width = 2, 5, 3

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def read(self, band, window):
            x, y, w, h = window
            return bands[band - 1, y : y + h, x : x + w]

    fake, windows = types.ModuleType("rasterio"), types.ModuleType("rasterio.windows")
    fake.open, windows.Window = lambda path: File(), lambda *a: a
    monkeypatch.setitem(sys.modules, "rasterio", fake)
    monkeypatch.setitem(sys.modules, "rasterio.windows", windows)
    reader = images._WindowReader({"path": "x.tif", "bands": "1,8", "rows": "2"})
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    want = [(0, b, y, x, float(bands[min(b, 2) - 1, y, x])) for y in range(5) for b in (1, 8) for x in range(3)]
    assert sorted(got) == sorted(want)


def test_pairs_in_the_frame_of_a_raster(spark):
    frame = spark.createDataFrame([(0, 0.0, 0.0, 19.0, 19.0)], "img_id long, minx double, miny double, maxx double, maxy double")
    line = spark.createDataFrame([(0, 1, 2, [(0.0, 10.0), (19.0, 10.0)])], "img_id long, u long, v long, geometry array<struct<lon:double,lat:double>>")
    df = spark.createDataFrame([(0, y, x, y, x, 7) for y in range(20) for x in range(20)], "img_id long, y int, x int, r int, g int, b int")
    out = synthetic.raster_pairs(df, frame, line, 20, 20, tile=10, step=10).collect()
    masks = {r["tile_id"]: np.frombuffer(r["mask"], np.uint8).reshape(10, 10) for r in out}
    assert len(out) == 4 and masks[0][8:].all() and not masks[0][:8].any() and masks[2][0].all() and not masks[2][1:].any()


def test_augmentation_keeps_shapes_and_changes_images():
    image, mask = synthetic.training_tile(32, 5)
    seen = set()
    for k in range(60):
        x, t = tiles.augmented(image, mask.astype(np.uint8), np.random.default_rng(k))
        assert x.shape == (32, 32, 3) and x.dtype == np.uint8 and t.shape == (32, 32) and set(np.unique(t)) <= {0, 1}
        seen.add(x.tobytes())
    assert len(seen) > 30
    assert np.abs(tiles.shift_colours(image, 0, 0, 0).astype(int) - image).max() <= 1
    assert (tiles.shift_colours(np.full((2, 2, 3), [255, 0, 0], np.uint8), 60, 0, 0) == [0, 255, 0]).all()


def test_training_set_resizes_and_scales(spark):
    made = synthetic.training_tiles(spark, 3, 40)
    out = tiles.training_set(made, 16).collect()
    x, t = (np.frombuffer(out[0][c], np.float32) for c in ("x", "t"))
    assert len(out) == 3 and x.size == 3 * 256 and t.size == 256 and 0 <= x.min() and x.max() <= 1 and set(np.unique(t)) <= {0, 1}
    again = tiles.training_set(made, 16).collect()
    assert {r["tile_id"]: r["x"] for r in out} == {r["tile_id"]: r["x"] for r in again}


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in random_weights(base=2, seed=3).items()}
    x, t = rng.random((2, 3, 16, 16)), (rng.random((2, 16, 16)) < 0.3).astype(np.float64)
    _, grads, _ = training.loss_and_gradients(w, x, t)
    assert set(grads) == set(w)
    for name in ("down0.conv0", "down2.norm1", "middle.conv1", "middle.attention.squeeze", "middle.attention.where", "up2.spread", "up1.bias", "up0.conv0", "head.conv", "head.bias"):
        places = list(np.ndindex(w[name].shape if ".norm" not in name else (2, w[name].shape[1])))
        for at in (places[0], places[-1]):
            kept, ends = w[name][at], []
            for step in (1e-5, -1e-5):
                w[name][at] = kept + step
                ends.append(training.loss_and_gradients(w, x, t)[0])
            w[name][at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-4 * max(1, abs(grads[name][at])), (name, at)


def test_training_lowers_the_loss_and_averages(spark, tmp_path):
    made = synthetic.training_tiles(spark, 8, 16)
    said = []
    w = training.train_network(made, 16, 6, 5e-3, base=4, occlude=False, augment=False, out=str(tmp_path / "w.npz"), say=said.append)
    losses = [float(line.split()[-1]) for line in said]
    assert len(losses) == 6 and losses[-1] < losses[0]
    score = tiles.load_scorer(str(tmp_path / "w.npz"))
    image, _ = synthetic.training_tile(16, 1)
    assert np.allclose(score(image), 1 / (1 + np.exp(-forward(image.astype(np.float32).transpose(2, 0, 1) / 255, w))), atol=1e-5)
    two = training.train_network(made, 16, 2, 5e-3, base=4, workers=2)
    assert {k: v.shape for k, v in two.items()} == {k: v.shape for k, v in w.items()} and all(np.isfinite(v).all() for v in two.values())
    with pytest.raises(ValueError):
        training.train_network(made.limit(0), 16, 1)
    with pytest.raises(ValueError):
        training.train_network(made, 20, 1)


def test_saved_runs_answer_questions(spark, tmp_path):
    nodes = spark.createDataFrame([(0, i, 10 * i, 0) for i in range(6)], "img_id long, node_id long, x int, y int")
    edges = spark.createDataFrame([(i, i + 1, 10.0, False) for i in range(5)], "a long, b long, weight double, healed boolean")
    top = spark.createDataFrame([(1, 2, 0.6, 20, 0), (2, 3, 0.6, 30, 0)], "rank int, node_id long, bc double, x int, y int")
    run = {"nodes": nodes, "edges": edges, "bridges": edges, "steps": top, "gatekeepers": top, "edge_bc": edges}
    folder = tmp_path.as_uri()
    explore.save(run, folder)
    row = explore.close_gatekeepers(spark, folder, [2], 30).first()
    assert row["severity"] == "severe" and row["lcc_frac"] == 0.5
    assert explore.close_gatekeepers(spark, folder, []).first()["resilience_index"] == 1.0
    with pytest.raises(ValueError):
        explore.close_gatekeepers(spark, folder, [5])
    text = explore.graph_json(nodes, edges).first()["value"]
    n, e = explore.graph_from_json(spark, text)
    assert {tuple(r) for r in e.collect()} == {(i, i + 1, 10.0) for i in range(5)}
    assert {tuple(r) for r in n.collect()} == {(i, 10.0 * i, 0.0) for i in range(6)}


def test_nearest_of_nothing_and_far_away(spark):
    left = spark.createDataFrame([(1, 0, 0), (2, 100_000, 5), (3, None, 1)], "i long, x int, y int")
    right = spark.createDataFrame([(7, 3, 4), (8, 3, 4)], "j long, x int, y int")
    got = {(r["i"], r["j"], round(r["dist"])) for r in nearest(left, right, "i", "j", 1.0, right_count_limit=0).collect()}
    assert got == {(1, 7, 5), (2, 7, 99997)}
    assert nearest(left, right.limit(0), "i", "j", 1.0, right_count_limit=0).count() == 0


def test_long_matchings_agree(spark):
    rows = [(i, i + 1, 1.0, float(i)) for i in range(60)]
    found = spark.createDataFrame(rows, "a long, b long, dist double, cost double")
    none = spark.createDataFrame([], "node_id long")
    one, many = (heal.stub_matching(found, none, limit).select("a", "b").collect() for limit in (100, 0))
    assert sorted(one) == sorted(many) and len(one) == 30
    assert HealSettings().max_gap == 45.0 and found.select(F.count(F.lit(1))).first()[0] == 60


def test_synthetic_run_identities(spark):
    from wayfabric.queries import QUERIES

    rows = QUERIES["synthetic_run"](spark, "").collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["num_components_before"] - r["bridges_mst"] == r["num_components_after"]
    assert r["bridges_added"] == r["bridges_mst"] + r["bridges_stub_repair"] and r["lcc_after_heal"] >= r["lcc_before_heal"]
    assert abs(r["dice"] - 2 * r["iou"] / (1 + r["iou"])) < 2e-4 and r["iou"] > 0.8 and r["relaxed_iou"] >= r["iou"]
    assert r["step"] == 8 and 0 < r["resilience_index"] <= 1.2 and 0 < r["lcc_frac"] <= 1
