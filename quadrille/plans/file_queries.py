"""Queries over files: the derived views are written in a format by the executors, read back by its source, and compared with the view by SQL.

Flows go all the way: files in, tiles out, and the tiles decoded for what they hold. Files lie in fresh folders of the session's shared one.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import encode, mesh
from quadrille.plans import flows
from quadrille.plans import queries as base
from quadrille.plans.views import view, with_views
from quadrille.sources import las, meshes, raster, store, vector

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
View = base.View


def query(sql: str):
    """Register a function of the views and a fresh folder."""

    def put(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: view(spark, sf_dir, name), store.fresh_folder(spark, fn.__name__))
        SQL[fn.__name__] = with_views(sql)
        return fn

    return put


def written(rows: DataFrame, key: str, write: Callable[[object, pa.Table], None]) -> int:
    """Call write(key, table) for the rows of each key, on the executors; the number of files."""

    def run(k, table):
        write(k[0].as_py(), table)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    return rows.groupBy(key).applyInArrow(run, "n long").count()


def texts(lines: DataFrame, folder: str) -> str:
    """Write a column of lines as text files."""
    lines.write.mode("overwrite").text(folder)
    return folder


# ---- point clouds


def las_files(v: View, folder: str) -> SparkSession:
    """A LAS file for each supplier; coordinates are whole numbers below 65536."""

    def write(k, t):
        c = {n: t.column(n).to_numpy() for n in t.column_names}
        xyz = np.stack((c["r16"], c["g16"], c["b16"]), axis=1).astype(np.float64)
        las.write_las(f"{folder}/s{k}.las", xyz, np.stack((c["b16"], c["g16"], c["r16"]), axis=1), c["intensity"], c["classification"])

    points = v("points").select("l_suppkey", "r16", "g16", "b16", "intensity", "classification")
    written(points, "l_suppkey", write)
    points.sparkSession.dataSource.register(las.LasDataSource)
    return points.sparkSession


def supplier() -> Column:
    return F.regexp_extract("path", r"s(\d+)\.las$", 1).cast("bigint").alias("l_suppkey")


@query("select l_suppkey, cast(r16 as double) as x, cast(g16 as double) as y, cast(b16 as double) as z, intensity, classification, b16 as r, g16 as g, r16 as b from points")
def las_scan(v: View, folder: str) -> DataFrame:
    """Every point of every file, read in slices of 1000 records."""
    spark = las_files(v, folder)
    found = spark.read.format("las").option("records", 1000).load(folder)
    return found.select(supplier(), *[F.round(c, 3).alias(c) for c in "xyz"], "intensity", "classification", F.col("r16").alias("r"), F.col("g16").alias("g"), F.col("b16").alias("b"))


@query("select l_suppkey, cast(ceil(count(*) / 4e0) as bigint) as n from points group by l_suppkey")
def las_sample(v: View, folder: str) -> DataFrame:
    """30 per cent of a file is every fourth record."""
    spark = las_files(v, folder)
    return spark.read.format("las").option("percent", 30).option("records", 1000).load(folder).groupBy(supplier()).agg(F.count("*").alias("n"))


# ---- vector files


def geojson_rows(v: View) -> DataFrame:
    """Footprints as GeoJSON features, a line each; the number of the file they go to."""
    c = F.col
    ring = F.array(*[F.array(c(x), c(y)) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(c("height"), c("altitude"), c("category"))
    feature = F.struct(F.lit("Feature").alias("type"), c("feature_id").cast("string").alias("id"), geometry.alias("geometry"), properties.alias("properties"))
    return v("features").select((c("feature_id") % 7).alias("file"), F.to_json(feature).alias("line"))


def collections(rows: DataFrame, folder: str) -> str:
    def write(k, t):
        store.write_bytes(f"{folder}/f{k}.geojson", ('{"type":"FeatureCollection","features":[\n' + ",\n".join(t.column("line").to_pylist()) + "\n]}").encode())

    written(rows, "file", write)
    return folder


RING = "feature_id, 5 as vertices, minx, miny, maxx, maxy"


def ringed(found: DataFrame) -> DataFrame:
    flat = F.flatten("rings")
    box = [f(flat[a]).alias(f"{n}{a}") for n, f in (("min", F.array_min), ("max", F.array_max)) for a in "xy"]
    return found.select(F.col("feature_id").cast("bigint").alias("feature_id"), F.size(flat).alias("vertices"), *box)


@query(f"select {RING}, category, height from features")
def geojson_features(v: View, folder: str) -> DataFrame:
    rows = geojson_rows(v)
    found = vector.geojson(rows.sparkSession, collections(rows, folder))
    more = found.select(F.col("feature_id").cast("bigint").alias("feature_id"), F.col("properties")["category"].alias("category"), F.col("properties")["height"].cast("double").alias("height"))
    return ringed(found).join(more, "feature_id")


@query(f"select {RING} from features")
def geojson_line_features(v: View, folder: str) -> DataFrame:
    """The same collections, read line by line."""
    rows = geojson_rows(v)
    return ringed(vector.geojson_lines(rows.sparkSession, collections(rows, folder)))


@query("select feature_id, 'solid' as kind, least(greatest(coalesce(height, 1e0), 1e0), altitude) as floor, greatest(greatest(coalesce(height, 1e0), 1e0), altitude) + 4e0 as roof from features")
def geojson_extrusions(v: View, folder: str) -> DataFrame:
    rows = geojson_rows(v)
    found = vector.shaped(vector.geojson(rows.sparkSession, collections(rows, folder)))
    return found.select(F.col("feature_id").cast("bigint").alias("feature_id"), "kind", "floor", "roof")


@query("select instance_id, lon, lat, alt, heading, 1e0 + cast(instance_id % 3 as double) as scale from instances")
def geojson_placements(v: View, folder: str) -> DataFrame:
    c = F.col
    i = v("instances")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(c("alt").alias("altitude"), "heading", (F.lit(1.0) + c("instance_id") % 3).alias("scale"))
    lines = i.select(F.to_json(F.struct(F.lit("Feature").alias("type"), c("instance_id").cast("string").alias("id"), point.alias("geometry"), properties.alias("properties"))))
    found = vector.placements(vector.geojson_lines(i.sparkSession, texts(lines, f"{folder}/lines")))
    return found.select(c("feature_id").cast("bigint").alias("instance_id"), "lon", "lat", "alt", "heading", "scale")


@query("select instance_id, lon, lat, alt, altitude_mode, heading, 'models/' || model_href || '.obj' as href from instances")
def kml_placements(v: View, folder: str) -> DataFrame:
    found = vector.kml(v("instances").sparkSession, kml_files(v, folder))
    return found.select(F.col("name").cast("bigint").alias("instance_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("altitude").alias("alt"), "altitude_mode", "heading", "href")


def kml_files(v: View, folder: str) -> str:
    def write(k, t):
        marks = "".join(f"<Placemark><name>{r['instance_id']}</name><Model><altitudeMode>{r['altitude_mode']}</altitudeMode><Location><longitude>{r['lon']!r}</longitude><latitude>{r['lat']!r}</latitude><altitude>{r['alt']!r}</altitude></Location><Orientation><heading>{r['heading']!r}</heading></Orientation><Link><href>models/{r['model_href']}.obj</href></Link></Model></Placemark>\n" for r in t.to_pylist())
        store.write_bytes(f"{folder}/k{k}.kml", f"<kml><Document>\n{marks}</Document></kml>".encode())

    written(v("instances").withColumn("file", F.col("group_id") % 5), "file", write)
    return folder


@query(f"select {RING}, category from features")
def shapefile_features(v: View, folder: str) -> DataFrame:
    """A .shp, .dbf and .cpg for each of five parts."""

    def write(k, t):
        shp, dbf = b"", b""
        for n, r in enumerate(t.sort_by("feature_id").to_pylist()):
            pts = [(r["minx"], r["miny"]), (r["minx"], r["maxy"]), (r["maxx"], r["maxy"]), (r["maxx"], r["miny"]), (r["minx"], r["miny"])]
            body = struct.pack("<I4d2II", 5, r["minx"], r["miny"], r["maxx"], r["maxy"], 1, 5, 0) + struct.pack("<10d", *sum(pts, ()))
            shp += struct.pack(">2I", n + 1, len(body) // 2) + body
            dbf += b" " + str(r["feature_id"]).encode().ljust(12) + r["category"].encode().ljust(20)
        fields = b"ID".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([12]) + b"\0" * 15 + b"CATEGORY".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20]) + b"\0" * 15
        store.write_bytes(f"{folder}/p{k}.shp", struct.pack(">I20xI", 9994, 50 + len(shp) // 2) + struct.pack("<2I64x", 1000, 5) + shp)
        store.write_bytes(f"{folder}/p{k}.dbf", struct.pack("<4sIHH20s", b"\x03", t.num_rows, 97, 33, b"") + fields + b"\r" + dbf)
        store.write_bytes(f"{folder}/p{k}.cpg", b"UTF-8")

    f = v("features")
    written(f.withColumn("file", F.col("feature_id") % 5), "file", write)
    found = vector.shapefile(f.sparkSession, folder).withColumn("feature_id", F.col("properties")["ID"])
    return ringed(found).join(found.select(F.col("feature_id").cast("bigint").alias("feature_id"), F.col("properties")["CATEGORY"].alias("category")), "feature_id")


@query(f"select {RING}, category from features")
def geopackage_features(v: View, folder: str) -> DataFrame:
    """A GeoPackage for each of three parts."""

    def write(k, t):
        with tempfile.TemporaryDirectory() as own:  # sqlite needs a file of its own; it is gone when the task ends
            con = sqlite3.connect(os.path.join(own, "x.gpkg"))
            con.executescript("create table gpkg_geometry_columns(table_name, column_name); insert into gpkg_geometry_columns values('f', 'geom'); create table f(geom blob, id integer, category text)")
            for r in t.to_pylist():
                pts = (r["minx"], r["miny"], r["maxx"], r["miny"], r["maxx"], r["maxy"], r["minx"], r["maxy"], r["minx"], r["miny"])
                con.execute("insert into f values(?, ?, ?)", (b"GP\0\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<3I", 3, 1, 5) + struct.pack("<10d", *pts), r["feature_id"], r["category"]))
            con.commit()
            con.close()
            with open(os.path.join(own, "x.gpkg"), "rb") as f:
                store.write_bytes(f"{folder}/g{k}.gpkg", f.read())

    f = v("features")
    written(f.withColumn("file", F.col("feature_id") % 3), "file", write)
    found = vector.geopackage(f.sparkSession, folder).withColumn("feature_id", F.col("properties")["id"])
    return ringed(found).join(found.select(F.col("feature_id").cast("bigint").alias("feature_id"), F.col("properties")["category"].alias("category")), "feature_id")


def gml_ring(x0: str, y0: str, x1: str, y1: str, z: str) -> Column:
    text = [F.concat_ws(" ", F.col(x), F.col(y), F.col(z)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    return F.concat(F.lit("<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), F.concat_ws(" ", *text), F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"))


@query("select feature_id, 'Roof' as classification, 5 as vertices, minx, maxy, altitude as z from features union all select feature_id, 'Ground', 5, minx, maxy, altitude from features")
def citygml_surfaces(v: View, folder: str) -> DataFrame:
    """Buildings with a roof and a ground surface."""
    f = v("features")
    surface = lambda n: F.concat(F.lit(f"<bldg:boundedBy><bldg:{n}Surface><bldg:lod2MultiSurface>"), gml_ring("minx", "miny", "maxx", "maxy", "altitude"), F.lit(f"</bldg:lod2MultiSurface></bldg:{n}Surface></bldg:boundedBy>"))
    body = F.concat(F.lit('<cityObjectMember><bldg:Building gml:id="'), F.col("feature_id").cast("string"), F.lit('">'), surface("Roof"), surface("Ground"), F.lit("</bldg:Building></cityObjectMember>"))
    found = vector.citygml(f.sparkSession, texts(f.select(body), f"{folder}/city"))
    return found.select(F.col("object_id").cast("bigint").alias("feature_id"), "classification", F.size("ring").alias("vertices"), F.array_min(F.col("ring")["x"]).alias("minx"), F.array_max(F.col("ring")["y"]).alias("maxy"), F.array_max(F.col("ring")["z"]).alias("z"))


@query("select feature_id, 5 as vertices, maxx, miny from features")
def indoorgml_cells(v: View, folder: str) -> DataFrame:
    f = v("features")
    body = F.concat(F.lit('<core:CellSpace gml:id="'), F.col("feature_id").cast("string"), F.lit('">'), gml_ring("minx", "miny", "maxx", "maxy", "altitude"), F.lit("</core:CellSpace>"))
    found = vector.indoorgml(f.sparkSession, texts(f.select(body), f"{folder}/indoor"))
    return found.select(F.col("object_id").cast("bigint").alias("feature_id"), F.size("ring").alias("vertices"), F.array_max(F.col("ring")["x"]).alias("maxx"), F.array_min(F.col("ring")["y"]).alias("miny"))


# ---- rasters


def tiff(grid: np.ndarray, west: float, north: float, step: float) -> bytes:
    """An uncompressed single-band GeoTIFF of 64-bit values, one strip."""
    data = grid.astype("<f8").tobytes()
    tags = [(256, 4, grid.shape[1]), (257, 4, grid.shape[0]), (258, 3, 64), (259, 3, 1), (273, 4, 8), (278, 4, grid.shape[0]), (279, 4, len(data)), (339, 3, 3)]
    at = 8 + len(data)
    extra = at + 2 + 12 * (len(tags) + 2) + 4
    ifd = struct.pack("<H", len(tags) + 2) + b"".join(struct.pack("<HHII", *t[:2], 1, t[2]) for t in tags)
    ifd += struct.pack("<HHII", 33550, 12, 3, extra) + struct.pack("<HHII", 33922, 12, 6, extra + 24) + b"\0\0\0\0"
    return struct.pack("<2sHI", b"II", 42, at) + data + ifd + struct.pack("<9d", step, step, 0, 0, 0, 0, west, north, 0)


def coverages(v: View, folder: str) -> DataFrame:
    """The terrain as two GeoTIFFs: columns below 15, and from 10 on; both hold columns 10 to 14."""

    def write(k, t):
        ix, iy, value = (t.column(c).to_numpy() for c in ("ix", "iy", "v"))
        grid = np.full((iy.max() + 1, ix.max() - ix.min() + 1), np.nan)
        grid[iy, ix - ix.min()] = value
        store.write_bytes(f"{folder}/c{k}.tif", tiff(grid, 126.0 + 0.125 * int(ix.min()), 38.0, 0.125))

    cells = v("terrain")
    parts = cells.filter("ix < 15").withColumn("file", F.lit(0)).union(cells.filter("ix >= 10").withColumn("file", F.lit(1)))
    written(parts, "file", write)
    return raster.read_rasters(cells.sparkSession, folder)


COVERS = "(select 0 as file, ix - (select min(ix) from terrain) as ix, iy, v from terrain where ix < 15 union all select 1, ix - 10, iy, v from terrain where ix >= 10)"
WEST = "case when file = 0 then 126e0 + 0.125e0 * (select min(ix) from terrain) else 127.25e0 end as west"


@query(f"select file, ix, iy, v, {WEST} from {COVERS} c")
def geotiff_cells(v: View, folder: str) -> DataFrame:
    return coverages(v, folder).select(F.regexp_extract("path", r"c(\d)\.tif$", 1).cast("int").alias("file"), "ix", "iy", "v", "west")


HEIGHTS = """select instance_id, q.file, round(sum(coalesce(c.v, 0e0) * wx * wy), 9) as h from (select p.*, k.file, dx, dy, cast(floor(gx) as bigint) + dx as cx, cast(floor(gy) as bigint) + dy as cy,
    case when dx = 1 then gx - floor(gx) else 1e0 - (gx - floor(gx)) end as wx, case when dy = 1 then gy - floor(gy) else 1e0 - (gy - floor(gy)) end as wy
    from (select file, west, max(ix) + 1 as nx, max(iy) + 1 as ny from (select file, ix, iy, {west} from {covers} s) t group by 1, 2) k
    join (select instance_id, lon, lat from instances) i on i.lon between k.west and k.west + 0.125e0 * k.nx and i.lat between 38e0 - 0.125e0 * k.ny and 38e0
    , lateral (select instance_id, (lon - k.west) / 0.125e0 as gx, (38e0 - lat) / 0.125e0 as gy) p, (select 0 as dx union all select 1) a, (select 0 as dy union all select 1) b) q
    left join {covers} c on c.file = q.file and c.ix = q.cx and c.iy = q.cy group by 1, 2""".replace("{covers}", COVERS).replace("{west}", WEST)


@query(f"select instance_id, round(sum(coalesce(h, 0e0)), 9) as total, coalesce(max_by(h, file) filter (where h <> 0e0), 0e0) as last from (select i.instance_id, s.file, s.h from instances i left join ({HEIGHTS}) s on s.instance_id = i.instance_id) group by instance_id")
def coverage_heights(v: View, folder: str) -> DataFrame:
    """Height of the terrain at every placement: the sum over all coverages, and the last one that is not 0."""
    from quadrille.operators import tiling

    cells = coverages(v, folder)
    i = v("instances").select("instance_id", "lon", "lat")
    total = tiling.coverage_heights(i, "lon", "lat", cells, False, "total")
    both = tiling.coverage_heights(total, "lon", "lat", cells, True, "last")
    return both.select("instance_id", F.round("total", 9).alias("total"), F.round("last", 9).alias("last"))


# ---- models and tiles


def box_files(v: View, folder: str) -> DataFrame:
    """An extruded footprint for each feature, in a mesh format by its number."""

    def run(batches):
        for b in batches:
            for k, w, h, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, f = mesh.extrude([(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)], [], 0.0, top)
                kind = ("obj", "stl", "ply", "glb", "b3dm")[k % 5]
                store.write_bytes(f"{folder}/m{k}.{kind}", mesh_bytes(kind, p, f))
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["feature_id"])

    from quadrille.plans.mesh_queries import footprints

    made = footprints(v).select("feature_id", "w", "h", "top")
    made.mapInArrow(run, "feature_id long").count()
    return made


def mesh_bytes(kind: str, p: np.ndarray, f: np.ndarray) -> bytes:
    if kind == "obj":
        return ("".join(f"v {x!r} {y!r} {z!r}\n" for x, y, z in p.tolist()) + "".join(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in f.tolist())).encode()
    if kind == "stl":
        return b"\0" * 80 + struct.pack("<I", len(f)) + b"".join(b"\0" * 12 + t.astype("<f4").tobytes() + b"\0\0" for t in p[f])
    if kind == "ply":
        head = f"ply\nformat ascii 1.0\nelement vertex {len(p)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n"
        return (head + "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in p.tolist()) + "".join(f"3 {a} {b} {c}\n" for a, b, c in f.tolist())).encode()
    glb = encode.mesh_glb(p, f)
    return glb if kind == "glb" else encode.b3dm(glb, {"name": ["x"]}, 1)


SIDES = "(select feature_id, round((maxx - minx) * 10000e0) as w, round((maxy - miny) * 10000e0) as h, coalesce(height, 1e0) as top from features)"


@query(f"select feature_id, cast(12 as bigint) as triangles, w, h, top, feature_id % 5 in (0, 3, 4) as y_up from {SIDES} s")
def model_files(v: View, folder: str) -> DataFrame:
    """OBJ, STL, PLY, GLB and b3dm files read back: triangles, extents and whether y is up in the format."""
    made = box_files(v, folder)
    found = meshes.read_meshes(made.sparkSession, folder, strict=True)
    axis = lambda k: F.filter("vertices", lambda x, i: i % 3 == k)
    size = [(F.array_max(axis(k)) - F.array_min(axis(k))).alias(n) for k, n in enumerate(("w", "h", "top"))]
    return found.select(F.regexp_extract("path", r"m(\d+)\.", 1).cast("bigint").alias("feature_id"), F.expr("cast(size(faces) div 3 as bigint)").alias("triangles"), *size, "y_up")


@query("select tileset_id, x0, y1, z1, geometric_error from tilesets")
def tileset_scan(v: View, folder: str) -> DataFrame:
    found = meshes.read_tilesets(v("tilesets").sparkSession, tileset_files(v, folder))
    return found.select(F.regexp_extract("path", r"t(\d+)/", 1).cast("bigint").alias("tileset_id"), F.col("region")[0].alias("x0"), F.col("region")[3].alias("y1"), F.col("region")[5].alias("z1"), "geometric_error")


def tileset_files(v: View, folder: str) -> str:
    def write(k, t):
        r = t.to_pylist()[0]
        nodes = [{"code": "R", "region": [r["x0"], r["y0"], r["x1"], r["y1"], r["z0"], r["z1"]], "error": r["geometric_error"], "uri": "data/R.glb"}]
        encode.write_tileset(encode.tileset(nodes, r["geometric_error"]), f"{folder}/t{k}")

    written(v("tilesets"), "tileset_id", write)
    return folder


def contents(spark: SparkSession, folder: str, schema: str, rows: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """rows(name, bytes) of every tile below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pnts,b3dm,i3dm,glb}").load(folder).select("path", "content")
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrow = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}[k] for k in kinds]

    def run(batches):
        for b in batches:
            out = [r for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(os.path.basename(path), data)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=list(names))

    return files.mapInArrow(run, schema)


@query("select intensity, classification, count(*) as n from points group by 1, 2")
def point_cloud_flow(v: View, folder: str) -> DataFrame:
    """LAS files to a tree of point tiles: no point is lost, added or changed in intensity and class."""
    spark = las_files(v, f"{folder}/in")
    o = flows.Options(input=f"{folder}/in", output=f"{folder}/out", input_type="las", longitude=127.0, latitude=37.0, max_points=6400, tiles_version="1.0")
    flows.point_cloud(spark, o)

    def rows(name, data):
        t = meshes.unpack_tile(data)
        n = t["feature"]["POINTS_LENGTH"]
        column = lambda c: np.frombuffer(t["batch_body"], np.uint16, n, t["batch"][c]["byteOffset"]).tolist()
        return list(zip(column("INTENSITY"), column("CLASSIFICATION"), strict=True))

    found = contents(spark, f"{folder}/out", "intensity int, classification int", rows)
    return found.groupBy("intensity", "classification").agg(F.count("*").alias("n"))


@query("select feature_id, category from features where category = 'Brand#13' or category = 'Brand#21' or feature_id = 5")
def feature_flow(v: View, folder: str) -> DataFrame:
    """GeoJSON through the attribute filter to b3dm tiles; the batch tables give the features back."""
    rows = geojson_rows(v)
    spark = rows.sparkSession
    marked = rows.select("file", F.regexp_replace("line", '"properties":\\{', F.concat(F.lit('"properties":{"no":"'), F.get_json_object("line", "$.id"), F.lit('",'))).alias("line"))
    o = flows.Options(input=collections(marked, f"{folder}/in"), output=f"{folder}/out", max_triangles=300, tiles_version="1.0", attribute_filter="category=Brand#13,Brand#21;no=5")
    flows.features(spark, o)

    def decoded(name, data):
        t = meshes.unpack_tile(data)["batch"]
        return [(int(i), c) for i, c in zip(t["no"], t["category"], strict=True)]

    return contents(spark, f"{folder}/out", "feature_id long, category string", decoded)


@query("select model_href as model, count(*) as n, round(sum(heading), 3) as headings from instances group by 1")
def instance_flow(v: View, folder: str) -> DataFrame:
    """Placements to i3dm tiles; the instances of the tiles by model and their headings."""
    i = v("instances")
    o = flows.Options(input=folder, output=folder, tiles_version="1.0", extra={"max_instances": 500})
    flows.instances(i.sparkSession, o, i.select("instance_id", "lon", "lat", "alt", "heading", F.lit(1.0).alias("scale")))
    ids = contents(i.sparkSession, folder, "instance_id long", lambda name, data: [(k,) for k in meshes.unpack_tile(data)["batch"]["instance_id"]])
    return ids.join(i, "instance_id").groupBy(F.col("model_href").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum("heading"), 3).alias("headings"))


@query("""select 0 as lod, count(*) as models, 12 * count(*) as triangles from instances where model_href in ('view', 'click', 'error')""")
def model_flow(v: View, folder: str) -> DataFrame:
    """Three OBJ models at all their KML placements to b3dm tiles: models and triangles of the decoded tiles."""
    i = v("instances")
    spark = i.sparkSession
    for k, name in enumerate(("view", "click", "error")):
        p, f = mesh.extrude([(0.0, 0.0), (4.0 + k, 0.0), (4.0 + k, 3.0), (0.0, 3.0)], [], 0.0, 6.0)
        store.write_bytes(f"{folder}/in/{name}.obj", mesh_bytes("obj", p, f))
    spots = vector.kml(spark, kml_files(v, f"{folder}/kml"))
    o = flows.Options(input=f"{folder}/in", output=f"{folder}/out", max_triangles=2000, max_lod=0, tiles_version="1.0")
    flows.models(spark, o, spots)

    def rows(name, data):
        t = meshes.unpack_tile(data)
        p, f = meshes.gltf(t["body"])
        return [(0, t["feature"]["BATCH_LENGTH"], len(f))]

    found = contents(spark, f"{folder}/out", "lod int, models long, triangles long", rows)
    return found.groupBy("lod").agg(F.sum("models").alias("models"), F.sum("triangles").alias("triangles"))


@query("select tileset_id, 't' || tileset_id || '/tileset.json' as uri, geometric_error as error, x0, y1 from tilesets")
def merge_flow(v: View, folder: str) -> DataFrame:
    """tileset.json files merged under one; the leaves of its document."""
    spark = v("tilesets").sparkSession
    doc = flows.merge(spark, flows.Options(input=tileset_files(v, folder), output=f"{folder}/merged"))
    rows, work = [], [doc["root"]]
    while work:
        node = work.pop()
        work += node.get("children", [])
        if "content" in node:
            uri = node["content"]["uri"]
            rows.append((int(uri.split("/")[-2][1:]), "/".join(uri.split("/")[-2:]), node["geometricError"], node["boundingVolume"]["region"][0], node["boundingVolume"]["region"][3]))
    return spark.createDataFrame(rows, "tileset_id long, uri string, error double, x0 double, y1 double")
