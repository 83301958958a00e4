import json
import os
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import encode, mesh, tiling
from quadrille.sources import las, meshes, raster, store, vector
from quadrille.streaming import ingest
from tests.test_mesh import CUBE, FACES


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz, rgb = rng.uniform(0, 100, (1000, 3)).round(3), rng.integers(0, 65536, (1000, 3))
    wkt = 'PROJCS["x",GEOGCS["g",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","5186"]]'
    las.write_las(str(tmp_path / "a.las"), xyz, rgb, np.arange(1000), np.arange(1000) % 19, wkt=wkt)
    data = (tmp_path / "a.las").read_bytes()
    assert las.projection(data) == 5186
    spark.dataSource.register(las.LasDataSource)
    rows = spark.read.format("las").option("records", 300).load(str(tmp_path)).orderBy("point_index").collect()
    assert np.allclose([(r.x, r.y, r.z) for r in rows], xyz, atol=1e-6) and [(r.r16, r.g16, r.b16) for r in rows] == [tuple(x) for x in rgb.tolist()]
    few = spark.read.format("las").option("percent", 30).option("records", 300).load(str(tmp_path)).collect()
    assert sorted(r.point_index for r in few) == list(range(0, 1000, 4))
    bad = bytearray(data)
    bad[104] |= 0x80
    with pytest.raises(ValueError):
        las.header(bytes(bad))


def test_mesh_files(spark, tmp_path):
    text = "".join(f"v {x} {y} {z}\n" for x, y, z in CUBE) + "".join(f"f {a + 1}/1 {b + 1} {c - 8}\n" for a, b, c in FACES)
    (tmp_path / "a.obj").write_text(text)
    tri = CUBE[FACES]
    (tmp_path / "b.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 12) + b"".join(struct.pack("<3f", 0, 0, 0) + t.astype("<f4").tobytes() + b"\0\0" for t in tri))
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 8\nproperty float x\nproperty float y\nproperty float z\nelement face 6\nproperty list uchar int vertex_indices\nend_header\n" + "".join(f"{x} {y} {z}\n" for x, y, z in CUBE) + "4 0 2 3 1\n4 4 5 7 6\n4 0 1 5 4\n4 2 6 7 3\n4 0 4 6 2\n4 1 3 7 5\n")
    (tmp_path / "d.glb").write_bytes(encode.mesh_glb(CUBE, FACES))
    (tmp_path / "e.b3dm").write_bytes(encode.b3dm(encode.mesh_glb(CUBE, FACES), {"name": ["x"]}, 1))
    (tmp_path / "f.fbx").write_bytes(b"?")
    rows = {os.path.basename(r.path): r for r in meshes.read_meshes(spark, str(tmp_path)).collect()}
    for name in ("a.obj", "b.stl", "c.ply", "d.glb", "e.b3dm"):
        v, f = np.array(rows[name].vertices).reshape(-1, 3), np.array(rows[name].faces).reshape(-1, 3)
        assert mesh.area(v, f) == pytest.approx(6) and len(f) == 12, name
    assert "native importer" in rows["f.fbx"].error and rows["a.obj"].y_up and not rows["c.ply"].y_up
    out = mesh.per_mesh(meshes.read_meshes(spark, str(tmp_path), "b.stl"), mesh.weld).first()
    assert len(out.vertices) == 24
    assert meshes.detect(["a.txt", "b.obj", "c.KML"]) == "kml" and meshes.detect(["x.gml"]) == "citygml"
    with pytest.raises(ValueError):
        meshes.detect(["a.txt"])
    assert [meshes.classify(n) for n in ("d/tileset.json", "a.TIF", "b.laz", "c.x")] == ["tileset", "tif", "las", "other"]


def test_geojson_and_kml(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    feats = [("Polygon", square, {"height": 3, "name": None}), ("MultiPolygon", [square, square], {"HEIGHT": "12"}), ("Point", [5, 6, 7], {"heading": 90, "scale": 2}), ("MultiPoint", [[1, 2], [3, 4]], {}), ("LineString", [[0, 0], [1, 1]], {}), (None, None, {})]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None if t is None else {"type": t, "coordinates": c}, "properties": p} for t, c, p in feats]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    rows = vector.geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted(r.type for r in rows) == ["LineString", "Point", "Point", "Point", "Polygon", "Polygon", "Polygon"]
    tops = vector.extrusions(vector.geojson(spark, str(tmp_path / "a.geojson"))).collect()
    assert sorted((r.floor, r.roof, r.solid) for r in tops) == [(0.0, 7.0, True), (0.0, 16.0, True), (0.0, 16.0, True)]
    put = vector.placements(vector.geojson(spark, str(tmp_path / "a.geojson"))).filter("lon = 5").first()
    assert (put.lat, put.heading, put.scale) == (6, 90, 2)
    assert vector.placements(vector.geojson(spark, str(tmp_path / "a.geojson")), compat=True).filter("lon = 5").first().scale == 3
    kml = "<kml><Document><Placemark><name>m</name><Model><altitudeMode>clampToGround</altitudeMode><Location><longitude>127.17</longitude><latitude>37.6</latitude><altitude>0</altitude></Location><Orientation><heading>5</heading><tilt>0</tilt><roll>0</roll></Orientation><Link><href>a.dae</href></Link></Model></Placemark></Document></kml>"
    (tmp_path / "m.kml").write_text(kml)
    r = vector.kml(spark, str(tmp_path)).first()
    assert (r.longitude, r.heading, r.scale_x, r.href) == (127.17, 5.0, 1.0, "a.dae")
    r = vector.fast_kml(spark, str(tmp_path)).first()
    assert (r.name, r.longitude, r.heading, r.scale_x) == ("m", 127.17, 5.0, 0.0)


def test_files_of_many_lines(spark, tmp_path):
    """Indented documents are read as whole files, not line by line."""
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "7", "geometry": {"type": "Polygon", "coordinates": square}, "properties": {"a": 1}}] * 2}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    assert vector.geojson(spark, str(tmp_path / "a.geojson")).count() == 2
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[\n' + ",\n".join(map(json.dumps, doc["features"])) + "\n]}")
    assert [r.feature_id for r in vector.geojson_lines(spark, str(tmp_path / "b.geojson")).collect()] == ["7", "7"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "tileset.json").write_text(json.dumps({"geometricError": 3, "root": {"boundingVolume": {"region": [0, 0, 1, 1, 0, 9]}}}, indent=2))
    assert meshes.read_tilesets(spark, str(tmp_path)).first().region == [0, 0, 1, 1, 0, 9]
    (tmp_path / "i.gml").write_text('<core:CellSpace gml:id="s1">\n<gml:exterior>\n<gml:LinearRing>\n<gml:posList>0 0 0\n1 0 0\n1 1 0\n0 0 0</gml:posList></gml:LinearRing></gml:exterior>\n</core:CellSpace>')
    assert [(r.object_id, len(r.ring)) for r in vector.indoorgml(spark, str(tmp_path / "i.gml")).collect()] == [("s1", 4)]


def test_coverages(spark):
    cells = [("a", x, y, 2.0, 0.0, 10.0, 1.0, 1.0) for x in range(10) for y in range(10)] + [("b", x, y, 3.0 if x else 0.0, 5.0, 10.0, 1.0, 1.0) for x in range(5) for y in range(10)]
    rasters = spark.createDataFrame(cells, "path string, ix long, iy long, v double, west double, north double, step_x double, step_y double")
    points = spark.createDataFrame([(1, 2.0, 8.0), (2, 7.0, 8.0), (3, 5.0, 8.0), (4, 50.0, 8.0), (4, 50.0, 8.0)], "id int, lon double, lat double")
    total = {(r.id, r.ground) for r in tiling.coverage_heights(points, "lon", "lat", rasters).collect()}
    last = [(r.id, r.ground) for r in tiling.coverage_heights(points, "lon", "lat", rasters, last=True).collect()]
    assert total == {(1, 2.0), (2, 5.0), (3, 2.0), (4, 0.0)} and sorted(last) == [(1, 2.0), (2, 3.0), (3, 2.0), (4, 0.0), (4, 0.0)]


def test_city_and_indoor(spark, tmp_path):
    ring = "<gml:{0}><gml:LinearRing>{1}</gml:LinearRing></gml:{0}>"
    poly = "<gml:Polygon>" + ring.format("exterior", "<gml:posList>0 0 0 1 0 0 1 1 0 0 0 0</gml:posList>") + ring.format("interior", "".join(f"<gml:pos>{p}</gml:pos>" for p in ("0 0 0", "1 0 0", "1 1 0"))) + "</gml:Polygon>"
    (tmp_path / "c.gml").write_text(f'<CityModel><cityObjectMember><bldg:Building gml:id="b1"><bldg:boundedBy><bldg:RoofSurface>{poly}</bldg:RoofSurface></bldg:boundedBy>{poly}</bldg:Building></cityObjectMember></CityModel>')
    rows = vector.citygml(spark, str(tmp_path / "c.gml")).collect()
    assert sorted((r.object_id, r.classification, r.interior, len(r.ring)) for r in rows) == [("b1", "Building", False, 4), ("b1", "Building", True, 3), ("b1", "Roof", False, 4), ("b1", "Roof", True, 3)]
    (tmp_path / "i.gml").write_text(f'<core:CellSpace gml:id="s1">{poly}</core:CellSpace>')
    assert vector.indoorgml(spark, str(tmp_path / "i.gml")).count() == 2


def test_geopackage_and_shapefile(spark, tmp_path):
    def geometry(kind, body):
        return b"GP\0\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<I", kind) + body

    poly = struct.pack("<2I", 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.executescript("create table gpkg_geometry_columns(table_name, column_name); insert into gpkg_geometry_columns values('f', 'geom'); create table f(geom blob, name text, h real)")
    con.execute("insert into f values(?, 'x', 2.5)", (geometry(3, poly),))
    con.execute("insert into f values(?, null, 1)", (geometry(4, struct.pack("<I", 2) + 2 * (b"\x01" + struct.pack("<I2d", 1, 7, 8))),))
    con.execute("insert into f values(null, 'no', 1)")
    con.commit()
    con.close()
    rows = vector.geopackage(spark, str(tmp_path)).collect()
    assert sorted((r.type, r.properties["name"]) for r in rows) == [("Point", "Null"), ("Point", "Null"), ("Polygon", "x")]
    pts = [(0, 0), (0, 1), (1, 1), (0, 0)]
    body = struct.pack("<I4d2I", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<I", 0) + struct.pack("<8d", *sum(pts, ()))
    record = struct.pack(">2I", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + record + struct.pack(">2I", 2, 2) + struct.pack("<I", 0))
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4sIHH20s", b"\x03", 2, 65, 7, b"") + field + b"\r" + b" " + "나무".encode("cp949").ljust(6) + b" " + b"".ljust(6))
    (tmp_path / "s.cpg").write_text("EUC-KR")
    rows = vector.shapefile(spark, str(tmp_path)).collect()
    assert [(r.type, r.properties, len(r.rings[0])) for r in rows] == [("Polygon", {"NAME": "나무"}, 4)]
    assert vector.charset(None) == "utf-8" and vector.charset("949") == "cp949"


def test_geotiff(spark, tmp_path):
    grid = np.arange(12, dtype="<f4").reshape(3, 4)
    grid[1, 1] = np.nan
    packed = zlib.compress(grid.tobytes())
    tags = [(256, 4, 4), (257, 4, 3), (258, 3, 32), (259, 3, 8), (273, 4, 8), (278, 4, 3), (279, 4, len(packed)), (339, 3, 3)]
    at = 8 + len(packed)
    ifd = struct.pack("<H", len(tags) + 2)
    extra = at + 2 + 12 * (len(tags) + 2) + 4
    for tag, kind, value in tags:
        ifd += struct.pack("<HHII", tag, kind, 1, value)
    ifd += struct.pack("<HHII", 33550, 12, 3, extra) + struct.pack("<HHII", 33922, 12, 6, extra + 24) + b"\0\0\0\0"
    (tmp_path / "t.tif").write_bytes(struct.pack("<2sHI", b"II", 42, at) + packed + ifd + struct.pack("<9d", 0.5, 0.25, 0, 0, 0, 0, 126, 38, 0))
    cells = raster.read_rasters(spark, str(tmp_path))
    assert cells.count() == 11 and cells.filter("ix = 3 and iy = 2").first().v == 11
    assert cells.select("west", "north", "step_x").first() == (126.0, 38.0, 0.5)
    points = spark.createDataFrame([(1, 126.25, 38.0), (2, 120.0, 0.0)], "id int, lon double, lat double")
    got = {r.id: r.sample for r in tiling.bilinear(points, cells.select("ix", "iy", "v"), (F.col("lon") - 126.0) / 0.5, (F.lit(38.0) - F.col("lat")) / 0.25).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_tiles_and_tileset(spark, sf_dir, tmp_path):
    from quadrille.plans.queries import POINT_ORDER, ROOT
    from quadrille.plans.views import view

    points = view(spark, sf_dir, "points").withColumns({c: (F.col(f"{c}16") / 257).cast("int") for c in "rgb"})
    tree = tiling.point_lod_tree(points, "lon", "lat", "h", POINT_ORDER, ROOT, 100, 1000, depth=3).cache()
    assert tree.count() == points.count() and tree.select(*points.columns).exceptAll(points).count() == 0
    for glb, ext in ((False, "pnts"), (True, "glb")):
        tiles = encode.encode_pnts(tree, "node_code", "lon", "lat", "h", ("r", "g", "b"), "intensity", "classification", glb)
        written = encode.write_tiles(tiles, str(tmp_path)).collect()
        assert len(written) == tree.select("node_code").distinct().count()
        assert all(os.path.getsize(tmp_path / w.uri) == w.bytes and w.bytes % 8 == 0 for w in written)
    n = 0
    for name in os.listdir(tmp_path / "data"):
        if name.endswith(".pnts"):
            tile = meshes.unpack_tile((tmp_path / "data" / name).read_bytes())
            n += tile["feature"]["POINTS_LENGTH"]
            q = np.frombuffer(tile["feature_body"], np.uint16, 3 * tile["feature"]["POINTS_LENGTH"])
            assert q.max() == 65535
    assert n == points.count()
    nodes = [{"code": r.node_code, "region": [0, 0, 1, 1, 0, 10], "error": 16.0 if r.node_code == "R" else 1.0, "uri": f"data/{r.node_code}.pnts"} for r in tree.select("node_code").distinct().collect()]
    doc = encode.tileset(nodes, 100.0)
    encode.write_tileset(doc, str(tmp_path))
    back = meshes.read_tilesets(spark, str(tmp_path)).first()
    assert back.region == [0, 0, 1, 1, 0, 10] and back.geometric_error == 16.0
    with pytest.raises(ValueError):
        encode.tileset([{"code": "R", "region": [0] * 6, "error": 0.0}], 1.0)
    with pytest.raises(ValueError):
        encode.tileset([], 1.0)


def test_point_tree_by_tasks_and_by_levels(spark, sf_dir, monkeypatch):
    """Large nodes that split across tasks and small ones that a task finishes give the same tree, ties and nulls in the order included."""
    from quadrille.plans.flows import checkpointer
    from quadrille.plans.queries import POINT_KEY, ROOT
    from quadrille.plans.views import view

    points = view(spark, sf_dir, "points").withColumn("tag", F.when(F.col("l_suppkey") % 2 == 0, F.lit("x")))
    order = ["tag", "r16", *POINT_KEY]
    trees = []
    for most in (10, 300, 10**6):
        monkeypatch.setattr(tiling, "FINISH", most)
        tree = tiling.point_lod_tree(points, "lon", "lat", "h", order, ROOT, 20, 100, depth=4, cut=checkpointer(spark))
        assert tree.columns == [*points.columns, "node_code"]
        trees.append(sorted(map(tuple, tree.collect()), key=repr))
    assert trees[0] == trees[1] == trees[2] and len(trees[0]) == points.count()


def test_places_in_groups_over_many_ranges(spark):
    from quadrille.plans.flows import checkpointer

    rows = [(None if k % 3 == 0 else "big" if k % 3 == 1 else f"g{k % 7}", (k * 7919) % 100_003, k % 5) for k in range(30_000)]
    df = spark.createDataFrame(rows, "g string, o long, size int").repartition(5)
    want, sums, seen = {}, {}, {}
    for g, o, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        n, total = seen.get(g, (0, 0))
        want[g, o], sums[g, o], seen[g] = n + 1, total, (n + 1, total + size)
    assert {(r.g, r.o): r.place for r in tiling.placed(df, ["g"], ["o"], "place", checkpointer(spark)).collect()} == want
    assert {(r.g, r.o): r.start for r in tiling.placed(df, ["g"], ["o"], "start", checkpointer(spark), F.col("size")).collect()} == sums
    assert tiling.placed(df.limit(0), ["g"], ["o"], "place", checkpointer(spark)).count() == 0


def test_instances_and_features_as_glb():
    data = encode.mesh_glb(CUBE, FACES, mesh.vertex_normals(CUBE, FACES), np.zeros(8), properties={"name": ["é", None], "kind": ["a", "b", "c"]})
    doc, body = meshes.glb_parts(data)
    assert doc["extensions"]["EXT_structural_metadata"]["propertyTables"][0]["count"] == 2 and "EXT_mesh_features" in doc["extensionsUsed"]
    assert encode.string_table(["é", None, ""])[1].tolist() == [0, 2, 3, 4]
    placed = encode.mesh_glb(CUBE, FACES, properties={"n": ["x", "y"]}, placements={"TRANSLATION": np.zeros((2, 3)), "ROTATION": np.tile([0, 0, 0, 1.0], (2, 1)), "SCALE": np.ones((2, 3))})
    doc, body = meshes.glb_parts(placed)
    assert {"EXT_mesh_gpu_instancing", "EXT_instance_features"} <= set(doc["extensionsUsed"]) and len(placed) % 8 == 0
    tile = meshes.unpack_tile(encode.i3dm(np.zeros((2, 3)), np.ones((2, 3)), np.ones((2, 3)), np.ones((2, 3)), "instance-0.glb", {"name": ["a", "b"]}))
    assert tile["feature"]["INSTANCES_LENGTH"] == 2 and tile["body"].rstrip(b" \0") == b"instance-0.glb" and tile["batch"] == {"name": ["a", "b"]}


def test_missing_input(tmp_path):
    with pytest.raises(FileNotFoundError):
        store.listed(str(tmp_path / "none"), ("las",))
    assert store.listed(str(tmp_path), ("las",)) == []


def test_stream_of_point_files(spark, sf_dir, tmp_path):
    from quadrille.plans.views import view

    points = view(spark, sf_dir, "points").select("lon", "lat", "h")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.stream_summaries(spark, str(tmp_path / "in"), "lon double, lat double, h double", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = ingest.merged(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    want = ingest.summarise(points)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
