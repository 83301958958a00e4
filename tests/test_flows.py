import json
import os

import numpy as np
import pytest

from quadrille.plans import flows
from quadrille.plans.views import view
from quadrille.sources import las, meshes


def codes(node):
    yield node
    for c in node.get("children", ()):
        yield from codes(c)


def inside(a, b, eps=1e-7):
    return all(a[k] >= b[k] - eps for k in (0, 1, 4)) and all(a[k] <= b[k] + eps for k in (2, 3, 5))


def check_tree(doc, folder):
    for node in codes(doc["root"]):
        for c in node.get("children", ()):
            assert inside(c["boundingVolume"]["region"], node["boundingVolume"]["region"])
        if "content" in node:
            assert os.path.exists(os.path.join(folder, node["content"]["uri"]))
    assert json.load(open(os.path.join(folder, "tileset.json"))) == doc


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_point_cloud(spark, tmp_path, version):
    rng = np.random.default_rng(2)
    xyz = rng.uniform((200000, 500000, 0), (200300, 500300, 50), (3000, 3)).round(3)
    las.write_las(str(tmp_path / "in/a.las"), xyz, rng.integers(0, 65536, (3000, 3)), np.arange(3000), np.arange(3000) % 19)
    o = flows.Options(input=str(tmp_path / "in"), output=str(tmp_path / "out"), input_type="las", crs=5186, max_points=6400, tiles_version=version)
    doc = flows.point_cloud(spark, o)
    check_tree(doc, tmp_path / "out")
    region = np.degrees(doc["root"]["boundingVolume"]["region"][:4])
    assert 126.99 < region[0] < region[2] < 127.02 and 36.8 < region[1] < region[3] < 37.2
    uris = [n["content"]["uri"] for n in codes(doc["root"]) if "content" in n]
    total = 0
    for u in uris:
        data = (tmp_path / "out" / u).read_bytes()
        if version == "1.0":
            total += meshes.unpack_tile(data)["feature"]["POINTS_LENGTH"]
        else:
            g, _ = meshes.glb_parts(data)
            total += g["accessors"][0]["count"]
    assert total == 3000 and len(uris) > 5


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_features(spark, tmp_path, version):
    feats = []
    for k in range(60):
        x, y = 127 + k % 8 * 0.001, 37 + k // 8 * 0.001
        ring = [[x, y], [x + 0.0005, y], [x + 0.0005, y + 0.0004], [x, y + 0.0004], [x, y]]
        if k == 7:
            ring = [ring[0], ring[2], ring[1], ring[3], ring[0]]
        feats.append({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"height": 10 + k, "kind": "a" if k % 2 else "b"}})
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    o = flows.Options(input=str(tmp_path / "f.geojson"), output=str(tmp_path / "out"), max_triangles=200, tiles_version=version, attribute_filter="kind=a;height=10")
    doc = flows.features(spark, o)
    check_tree(doc, tmp_path / "out")
    n = 0
    for node in codes(doc["root"]):
        if "content" in node:
            data = (tmp_path / "out" / node["content"]["uri"]).read_bytes()
            if version == "1.0":
                n += meshes.unpack_tile(data)["feature"]["BATCH_LENGTH"]
            else:
                n += meshes.glb_parts(data)[0]["extensions"]["EXT_structural_metadata"]["propertyTables"][0]["count"]
    assert n == 30


def test_instances_and_merge(spark, sf_dir, tmp_path):
    placed = view(spark, sf_dir, "instances").selectExpr("instance_id", "lon", "lat", "alt", "heading", "1.5D as scale")
    for k, limit in enumerate((50, 100_000)):
        doc = flows.instances(spark, flows.Options(input="x", output=str(tmp_path / f"t{k}"), extra={"max_instances": limit}), placed)
        check_tree(doc, tmp_path / f"t{k}")
        tiles = [meshes.unpack_tile((tmp_path / f"t{k}" / n["content"]["uri"]).read_bytes()) for n in codes(doc["root"]) if "content" in n]
        assert sum(t["feature"]["INSTANCES_LENGTH"] for t in tiles) == placed.count() and max(t["feature"]["INSTANCES_LENGTH"] for t in tiles) <= max(limit, 1000)
    doc = flows.merge(spark, flows.Options(input=str(tmp_path), output=str(tmp_path / "merged")))
    assert len([n for n in codes(doc["root"]) if "content" in n]) == 2


def test_surfaces_pipes_and_terrain(spark, tmp_path):
    from quadrille.plans.file_queries import tiff

    flat = [[127, 37], [127.001, 37], [127.001, 37.001], [127, 37.001], [127, 37]]
    shapes = [("Polygon", [flat], {"height": 10}), ("Polygon", [[[x, y, 20 + 1000 * (x - 127)] for x, y in flat]], {}), ("Polygon", [[[127, 37, 0], [127.001, 37, 0], [127.001, 37, 30], [127, 37, 30], [127, 37, 0]]], {}), ("LineString", [[127, 37, 5], [127.001, 37, 5], [127.001, 37.001, 9]], {"diameter": 2000})]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": str(k), "geometry": {"type": t, "coordinates": c}, "properties": p} for k, (t, c, p) in enumerate(shapes)]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    (tmp_path / "t.tif").write_bytes(tiff(np.full((8, 8), 100.0), 126.0, 38.0, 0.5))
    for terrain in (None, str(tmp_path / "t.tif")):
        out = tmp_path / f"out{bool(terrain)}"
        doc = flows.features(spark, flows.Options(input=str(tmp_path / "f.geojson"), output=str(out), tiles_version="1.0", terrain=terrain))
        check_tree(doc, out)
        tiles = [meshes.unpack_tile((out / n["content"]["uri"]).read_bytes()) for n in codes(doc["root"]) if "content" in n]
        assert sorted(i for t in tiles for i in t["batch"]["FeatureId"]) == ["0", "1", "2", "3"]
        v = np.concatenate([meshes.gltf(t["body"])[0] for t in tiles])
        low, high = v[:, 2].min(), v[:, 2].max()
        lift = 100 if terrain else 0
        assert (low, high) == (pytest.approx(lift, abs=1.1), pytest.approx(30 + lift, abs=0.1))


def test_models_with_levels(spark, tmp_path):
    from quadrille.plans.file_queries import mesh_bytes
    from quadrille.operators import mesh

    (tmp_path / "in").mkdir()
    for k in range(6):
        p, f = mesh.extrude([(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0)], [], 0.0, 30.0)
        (tmp_path / "in" / f"m{k}.ply").write_bytes(mesh_bytes("ply", p + (200000 + 40 * k, 500000, 0), f))
    o = flows.Options(input=str(tmp_path / "in"), output=str(tmp_path / "out"), crs=5186, tiles_version="1.0", max_triangles=20, max_lod=2, z_offset=5.0)
    doc = flows.models(spark, o)
    check_tree(doc, tmp_path / "out")
    by_depth = {}
    work = [(doc["root"], 0)]
    while work:
        node, d = work.pop()
        work += [(c, d + 1) for c in node.get("children", ())]
        if "content" in node:
            t = meshes.unpack_tile((tmp_path / "out" / node["content"]["uri"]).read_bytes())
            by_depth.setdefault(bool(node.get("children")), []).append(t["feature"]["BATCH_LENGTH"])
            assert 4.9 < meshes.gltf(t["body"])[0][:, 2].min() < 5.1 + 4
    assert sum(by_depth[False]) == 6 and sum(by_depth[True]) > 0


def test_unread_options_raise(spark, tmp_path):
    for flow, options in ((flows.features, {"rotate_x": 90.0}), (flows.merge, {"terrain": "x"}), (flows.models, {"proj": "+proj=utm"}), (flows.point_cloud, {"max_lod": 1})):
        with pytest.raises(ValueError, match="does not know"):
            flow(spark, flows.Options(input=str(tmp_path), output=str(tmp_path), **options))


def test_options():
    with pytest.raises(ValueError):
        flows.Options().checked()
    assert flows.Options(input="a", output="b", input_type="las").checked().output_type == "pnts"
    assert "crs" in flows.plan_of(flows.Options(input="a", output="b"))


def test_lods_and_systems(spark):
    assert [tuple(r) for r in flows.lod_table(spark).filter("lod in (0, 1, 7, 8, 23)").orderBy("lod").collect()] == [(0, 0, 0), (1, 2, 8), (7, 128, 360), (8, 256, 420), (23, 8388608, 1320)]
    one = spark.createDataFrame([(500000.0, 4100000.0, 5.0)], "x double, y double, z double")
    r = flows.to_degrees(one, flows.Options(crs=32652)).first()
    assert r.lon == pytest.approx(129) and 37.0 < r.lat < 37.1
    local = flows.to_degrees(one.selectExpr("0D x", "0D y", "1D z"), flows.Options(longitude=127.5, latitude=36.5)).first()
    assert (local.lon, local.lat) == (pytest.approx(127.5), pytest.approx(36.5))
    with pytest.raises(ValueError):
        flows.to_degrees(one, flows.Options(crs=2154))
