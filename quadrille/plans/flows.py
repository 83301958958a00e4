"""The whole flows: files in, a tile set out. Each is a chain of DataFrames; only node tables (a row per tile) reach the driver.

Point clouds, features (extrusions), instances and the merge of tile sets. Options are one dataclass.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators import encode, filters, mesh, tiling
from quadrille.sources import las, meshes, raster, store, vector

# Default limits.
MAX_POINTS, MAX_TRIANGLES, MAX_INSTANCES = 200_000, 524_288, 65_536
MIN_TILE_INSTANCES, MAX_TILE_INSTANCES = 128, 1_024
POINT_DEPTH, NODE_DEPTH, MERGE_DEPTH = 20, 32, 16
PIPE_SIDES = 16
# Geometric error and block error by level of detail 0..7; further levels double and add 60.
LOD_ERROR, LOD_BLOCK = (0, 2, 4, 8, 16, 32, 64, 128), (0, 8, 50, 120, 180, 240, 300, 360)


@dataclass
class Options:
    """What a run can be told; the names are those of the command line."""

    input: str = ""
    output: str = ""
    input_type: str | None = None
    output_type: str | None = None
    crs: int = 3857
    proj: str | None = None
    longitude: float | None = None
    latitude: float | None = None
    refine_add: bool = False
    glb: bool = False
    tiles_version: str = "1.1"
    recursive: bool = False
    min_lod: int = 0
    max_lod: int = 3
    min_geometric_error: float = 16.0
    max_geometric_error: float = 1e9
    max_points: int = MAX_POINTS
    max_triangles: int = MAX_TRIANGLES
    point_ratio: float = 100.0
    force_4byte_rgb: bool = False
    x_offset: float = 0.0
    y_offset: float = 0.0
    z_offset: float = 0.0
    scale: float = 1.0
    rotate_x: float = 0.0
    heading_column: str = "heading"
    height_column: str = "height"
    altitude_column: str = "altitude"
    diameter_column: str = "diameter"
    scale_column: str = "scale"
    minimum_height: float = 1.0
    absolute_altitude: float = 0.0
    skirt_height: float = 4.0
    flip_coordinate: bool = False
    attribute_filter: str = ""
    terrain: str | None = None
    geoid: str | None = None
    split_by_node: bool = False
    ignore_textures: bool = False
    curvature_correction: bool = False
    compat: bool = False
    # accepted and without effect, as in the command line: max_count, name_column, source_precision
    max_count: int | None = None
    name_column: str | None = None
    source_precision: int | None = None
    extra: dict = field(default_factory=dict)

    def checked(self, flow: str | None = None) -> "Options":
        """These options, completed. Raises where a flow is named that does not read one that was set."""
        if not self.input or not self.output:
            raise ValueError("a run needs an input and an output")
        if flow is not None:
            read = READ_BY_ALL | READ_BY[flow]
            idle = [f.name for f in fields(self) if f.name not in read and f.name != "extra" and getattr(self, f.name) != f.default]
            if idle:
                raise ValueError(f"{flow} does not know the options {', '.join(idle)}")
        if self.output_type is None:
            self.output_type = "pnts" if self.input_type in ("las", "laz") else "b3dm"
        return self


#: Options that every flow reads (or that have no effect in any, as in the command line), and those that one flow reads.
READ_BY_ALL = {"input", "output", "input_type", "output_type", "tiles_version", "glb", "max_count", "name_column", "source_precision"}
_PLACED = {"crs", "longitude", "latitude", "x_offset", "y_offset", "z_offset"}
_ERRORS = {"refine_add", "min_geometric_error", "max_geometric_error"}
READ_BY = {
    "point_cloud": _PLACED | _ERRORS | {"recursive", "max_points", "point_ratio", "force_4byte_rgb", "geoid"},
    "features": _ERRORS | {"max_triangles", "height_column", "altitude_column", "minimum_height", "skirt_height", "flip_coordinate", "attribute_filter", "terrain", "geoid", "absolute_altitude", "diameter_column"},
    "instances": _ERRORS | {"terrain", "geoid", "heading_column", "altitude_column", "scale_column", "compat", "scale"},
    "models": _PLACED | _ERRORS | {"recursive", "max_triangles", "min_lod", "max_lod", "scale", "rotate_x", "terrain", "geoid", "split_by_node"},
    "merge": {"recursive", "max_geometric_error"},
}


def lod_table(spark: SparkSession) -> DataFrame:
    rows = [(k, LOD_ERROR[k] if k < 8 else 1 << k, LOD_BLOCK[k] if k < 8 else 60 * (k - 1)) for k in range(24)]
    return spark.createDataFrame(rows, "lod int, geometric_error int, block_error int")


def to_degrees(df: DataFrame, o: Options, x="x", y="y", z="z") -> DataFrame:
    """df with lon, lat, h in place of projected coordinates, offset first."""
    px, py, pz = F.col(x) + o.x_offset, F.col(y) + o.y_offset, F.col(z) + o.z_offset
    if o.longitude is not None and o.latitude is not None:
        lon, lat = geo.tmerc_to_degrees(px, py, o.longitude, o.latitude)
        h: Column = pz
    else:
        lon, lat, h = geo.to_degrees(px, py, pz, o.crs)
    return df.withColumns({"lon": lon, "lat": lat, "h": h}).drop(*({x, y, z} - {"lon", "lat", "h"}))


def decoded_points(spark: SparkSession, o: Options) -> DataFrame:
    """LAS points with degrees, byte colours (129 where there is none) and the shuffle key that orders them for levels of detail."""
    spark.dataSource.register(las.LasDataSource)
    raw = spark.read.format("las").option("percent", o.point_ratio).option("recursive", str(o.recursive).lower()).load(o.input)
    byte = lambda c: F.coalesce(F.col(c) % 256 if o.force_4byte_rgb else (F.col(c).cast("double") / 65535.0 * 255.0).cast("int"), F.lit(129))
    out = grounded(to_degrees(raw, o), o, "lon", "lat", "h").withColumns({c: byte(f"{c}16") for c in "rgb"}).drop("r16", "g16", "b16")
    return out.withColumn("rnd_key", F.xxhash64("path", "point_index"))


def checkpointer(spark: SparkSession):
    """Writes a table to the shared folder of the session and reads it back: ends its lineage, and survives lost executors."""

    def cut(df: DataFrame) -> DataFrame:
        folder = store.fresh_folder(spark, "table")
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    return cut


def grounded(df: DataFrame, o: Options, lon: str, lat: str, *heights: str, clamp: Column | None = None) -> DataFrame:
    """df with the terrain (where clamp, if given, holds) and the geoid under (lon, lat) added to the columns of heights."""
    for path, last, where in ((o.terrain, True, clamp), (o.geoid, False, None)):
        if path:
            met = tiling.coverage_heights(df, lon, lat, raster.read_rasters(df.sparkSession, path), last, "_ground")
            add = F.col("_ground") if where is None else F.when(where, F.col("_ground")).otherwise(0.0)
            df = met.withColumns({h: F.col(h) + add for h in heights}).drop("_ground")
    return df


def bounds_of(df: DataFrame, x: str, y: str, z: str) -> tuple[float, ...]:
    r = df.agg(F.min(x), F.min(y), F.min(z), F.max(x), F.max(y), F.max(z)).first()
    if r[0] is None:
        raise ValueError("there is nothing to tile")
    return tuple(float(v) for v in r)


def cube(box: tuple[float, ...]) -> tuple[float, ...]:
    """A box in degrees and metres, grown from its lower corner to equal sides in metres."""
    lat = np.radians((box[1] + box[4]) / 2)
    n = geo.SEMI_MAJOR / np.sqrt(1 - geo.E2 * np.sin(lat) ** 2)
    mx, my = n * np.cos(lat) * np.pi / 180, n * np.pi / 180
    side = max((box[3] - box[0]) * mx, (box[4] - box[1]) * my, box[5] - box[2], 1e-3)
    return (*box[:3], box[0] + side / mx, box[1] + side / my, box[2] + side)


BOX = ("minx", "miny", "minz", "maxx", "maxy", "maxz")


def node_table(items: DataFrame, node: str, box: list[Column]) -> DataFrame:
    """A row for each node on a path to content: its region over all content below, its count and whether it has content itself.

    Items are combined by node before they are expanded to prefixes, so what is expanded is one row per tile.
    """
    return nodes_above(items.groupBy(F.col(node).alias("code")).agg(F.count("*").alias("own"), *[(F.min if k < 3 else F.max)(c).alias(n) for k, (c, n) in enumerate(zip(box, BOX, strict=True))]))


def nodes_above(own: DataFrame) -> DataFrame:
    """The table of `node_table` from a row for each node with content: code, own (its count) and its box."""
    names = BOX
    up = own.select(F.explode(tiling.prefixes("code")).alias("node"), "code", "own", *names)
    table = up.groupBy("node").agg(F.sum("own").alias("n"), F.sum(F.when(F.col("node") == F.col("code"), F.col("own")).otherwise(0)).alias("own"), *[(F.min if k < 3 else F.max)(n).alias(n) for k, n in enumerate(names)])
    return table.select(F.col("node").alias("code"), "n", "own", F.array(*geo.region(*names)).alias("region"), geo.degree_diagonal(*names).alias("diagonal"))


def tileset_of(nodes: DataFrame, extension: str, o: Options, error) -> dict:
    rows = []
    for r in nodes.toLocalIterator():
        rows.append({"code": r.code, "region": list(r.region), "error": error(r), "uri": f"data/{r.code}.{extension}" if r.own else None, "refine": "ADD" if o.refine_add or extension == "pnts" else "REPLACE"})
    top = max((r["error"] for r in rows), default=0)
    return encode.tileset(rows, min(max(o.min_geometric_error, top), o.max_geometric_error), o.tiles_version)


def point_cloud(spark: SparkSession, o: Options, points: DataFrame | None = None) -> dict:
    """LAS to pnts (1.0) or glb (1.1) tiles and tileset.json; the document is returned as well."""
    o = o.checked("point_cloud")
    points = decoded_points(spark, o) if points is None else points
    box = cube(bounds_of(points, "lon", "lat", "h"))
    order = ["rnd_key", *sorted(c for c in points.columns if c != "rnd_key")]
    tree = tiling.point_lod_tree(points, "lon", "lat", "h", order, box, max(1, o.max_points // 32), o.max_points, POINT_DEPTH - 1, cut=checkpointer(spark))
    ext = "glb" if o.tiles_version != "1.0" else "pnts"
    # a row for each tile is written with the tiles: the tree is made once, by the pass that encodes it
    tiles = encode.encode_pnts(tree, "node_code", "lon", "lat", "h", ("r", "g", "b"), "intensity", "classification", ext == "glb")
    made = checkpointer(spark)(encode.write_tiles(tiles, o.output, ("node_code", "n", "box")))
    nodes = nodes_above(made.select(F.col("node_code").alias("code"), F.col("n").alias("own"), *[F.col("box")[k].alias(c) for k, c in enumerate(BOX)]))
    limit = float(o.max_points)

    def error(r):
        half = r.diagonal / 2
        e = half * max(0.01, min(1.0, 1000 / limit))
        return 0.01 if e < 0.01 else 0.1 if e < 0.1 else 1.0 if e > 0.5 and half < 1 else e

    doc = tileset_of(nodes, ext, o, error)
    encode.write_tileset(doc, o.output)
    return doc


READERS = {"geojson": vector.geojson, "geojsonl": vector.geojson_lines, "shp": vector.shapefile, "gpkg": vector.geopackage}


def feature_shapes(spark: SparkSession, o: Options) -> DataFrame:
    """Features as shapes: solid (2D footprint with floor and roof), surface (rings with heights) or pipe (a line with a diameter).

    They are filtered by attribute, with a box and a triangle count; polygons with rings that cross are left out."""
    read = READERS[o.input_type or "geojson"]
    found = read(spark, o.input)
    if keys := {k for k, _ in filters.parse_attribute_filter(o.attribute_filter)}:
        # beside the whole row, so that an attribute may have the name of a column
        named = found.select(F.struct("*").alias("_row"), *[F.col("properties")[k].alias(k) for k in sorted(keys)])
        found = filters.attribute_filter(named, o.attribute_filter).select("_row.*")
    found = vector.shaped(found, o.height_column, o.altitude_column, o.diameter_column, o.minimum_height, o.skirt_height)

    def run(batches):
        for b in batches:
            rings, kinds = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("rings", "kind"))
            good = [k != "solid" or mesh.valid_polygon([[(p["x"], p["y"]) for p in ring] for ring in r]) for r, k in zip(rings, kinds, strict=True)]
            yield b.filter(pa.array(good, pa.bool_()))

    if o.absolute_altitude:
        found = found.withColumns({c: F.col(c) + o.absolute_altitude for c in ("floor", "roof")})
    valid = found.mapInArrow(run, found.schema)
    if o.flip_coordinate:
        valid = valid.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y"), p["z"].alias("z")))))
    flat = F.flatten("rings")
    box = {f"{n}{a}": f(flat[a]) for n, f in (("min", F.array_min), ("max", F.array_max)) for a in "xy"}
    boxed = valid.withColumns(box).withColumns({"px": (F.col("minx") + F.col("maxx")) / 2.0, "py": (F.col("miny") + F.col("maxy")) / 2.0})
    count = F.when(F.col("kind") == "pipe", F.size(flat) * 2 * PIPE_SIDES).otherwise(F.size(flat) * 4)
    return grounded(boxed, o, "px", "py", "floor", "roof").withColumns({"minz": F.col("floor"), "maxz": F.col("roof"), "triangles": count})


def shape_mesh(kind: str, rings: list[np.ndarray], floor: float, roof: float, base: float, diameter: float) -> mesh.Mesh:
    """Vertices and faces of a shape whose rings are in metres; base: the least height in them, which the floor stands for."""
    if kind == "pipe":
        return mesh.pipe(rings[0] + (0.0, 0.0, floor - base + diameter / 2), diameter, PIPE_SIDES)
    rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
    if kind == "solid":
        return mesh.extrude(rings[0][:, :2], [r[:, :2] for r in rings[1:]], floor, roof)
    # a surface is cut into triangles in the plane of two axes that its normal is farthest from
    first = rings[0] - rings[0].mean(axis=0)
    normal = np.cross(first, np.roll(first, -1, axis=0)).sum(axis=0)
    axes = [k for k in range(3) if k != int(np.abs(normal).argmax())]
    ring, faces = mesh.tessellate(np.column_stack((rings[0][:, axes], rings[0])), [np.column_stack((r[:, axes], r)) for r in rings[1:]])
    return ring[:, 2:] + (0.0, 0.0, floor - base), faces


def features(spark: SparkSession, o: Options) -> dict:
    """Footprints, surfaces and lines in degrees to b3dm (1.0) or glb (1.1) tiles, and tileset.json."""
    o = o.checked("features")
    found = feature_shapes(spark, o)
    box = bounds_of(found, "px", "py", "floor")
    side = max(box[3] - box[0], box[4] - box[1], 1e-9)
    tree = tiling.counted_tree(found, "quad", "px", "py", None, (box[0], box[1], 0.0, box[0] + side, box[1] + side, 0.0), o.max_triangles, NODE_DEPTH, "triangles")
    ext = "glb" if o.tiles_version != "1.0" else "b3dm"

    def encoder(t: pa.Table) -> bytes:
        parts, faces, ids, base = [], [], [], 0
        rows = t.sort_by("feature_id").to_pylist()
        cx, cy = np.mean([r["px"] for r in rows]), np.mean([r["py"] for r in rows])
        lat = np.radians(cy)
        n = geo.SEMI_MAJOR / np.sqrt(1 - geo.E2 * np.sin(lat) ** 2)
        m = np.array([n * np.cos(lat), n]) * np.pi / 180
        for k, r in enumerate(rows):
            rings = [np.array([(p["x"], p["y"], p["z"]) for p in ring]) for ring in r["rings"]]
            local = [np.column_stack(((x[:, :2] - (cx, cy)) * m, x[:, 2])) for x in rings]
            v, f = shape_mesh(r["kind"], local, r["floor"], r["roof"], r["base"], r["diameter"])
            parts.append(v)
            faces.append(f + base)
            ids.append(np.full(len(v), k))
            base += len(v)
        v, f = np.concatenate(parts), np.concatenate(faces)
        names = sorted({key for r in rows for key, _ in r["properties"] or ()})
        table = {"FeatureId": [r["feature_id"] for r in rows]} | {key: [dict(r["properties"] or ()).get(key) or "Null" for r in rows] for key in names}
        body = encode.mesh_glb(v, f, mesh.vertex_normals(v, f), np.concatenate(ids), properties=None if ext == "b3dm" else table, batch_id=ext == "b3dm")
        return encode.b3dm(body, table, len(rows)) if ext == "b3dm" else body

    tiles = encode.encode_nodes(tree, "node_code", ["feature_id", "kind", "rings", "floor", "roof", "base", "diameter", "px", "py", "properties"], encoder, ext)
    encode.write_tiles(tiles, o.output).agg(F.sum("bytes")).first()
    nodes = node_table(tree, "node_code", [F.col(c) for c in ("minx", "miny", "minz", "maxx", "maxy", "maxz")])
    doc = tileset_of(nodes, ext, o, lambda r: min(max(o.min_geometric_error, r.diagonal), o.max_geometric_error) / (1 << (len(r.code) - 1)))
    encode.write_tileset(doc, o.output)
    return doc


def instances(spark: SparkSession, o: Options, placed: DataFrame | None = None, model_uri: str = "instance-0.glb") -> dict:
    """Placements (instance_id, lon, lat, alt, heading, scale), or the points of the input, to i3dm tiles: nodes of too many split by quadrant."""
    o = o.checked("instances")
    if placed is None:
        points = READERS[o.input_type or "geojson"](spark, o.input)
        placed = vector.placements(points, o.heading_column, o.altitude_column, o.scale_column, o.compat).withColumnRenamed("feature_id", "instance_id")
    placed = grounded(placed, o, "lon", "lat", "alt", clamp=F.col("altitude_mode") != "absolute" if "altitude_mode" in placed.columns else None)
    if o.scale != 1.0:
        placed = placed.withColumn("scale", F.col("scale") * o.scale)
    box = bounds_of(placed, "lon", "lat", "alt")
    side = max(box[3] - box[0], box[4] - box[1], 1e-9)
    tree = tiling.counted_tree(placed, "quad", "lon", "lat", None, (box[0], box[1], 0.0, box[0] + side, box[1] + side, 0.0), o.extra.get("max_instances", MAX_INSTANCES), NODE_DEPTH)

    def encoder(t: pa.Table) -> bytes:
        t = t.sort_by("instance_id")
        lon, lat, alt, head, size = (t.column(c).to_numpy().astype(np.float64) for c in ("lon", "lat", "alt", "heading", "scale"))
        la, lo = np.radians(lat), np.radians(lon)
        n = geo.SEMI_MAJOR / np.sqrt(1 - geo.E2 * np.sin(la) ** 2)
        p = np.stack(((n + alt) * np.cos(la) * np.cos(lo), (n + alt) * np.cos(la) * np.sin(lo), (n * (1 - geo.E2) + alt) * np.sin(la)), axis=1)
        up = np.stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)), axis=1)
        east = np.stack((-np.sin(lo), np.cos(lo), np.zeros_like(lo)), axis=1)
        north, turn = np.cross(up, east), np.radians(head)[:, None]
        center = (p.min(axis=0) + p.max(axis=0)) / 2
        right = np.cos(turn) * east - np.sin(turn) * north
        return encode.i3dm(p - center, up, right, np.repeat(size[:, None], 3, axis=1), model_uri, {"instance_id": t.column("instance_id").to_pylist()}, center)

    tiles = encode.encode_nodes(tree, "node_code", ["instance_id", "lon", "lat", "alt", "heading", "scale"], encoder, "i3dm")
    encode.write_tiles(tiles, o.output).agg(F.sum("bytes")).first()
    nodes = node_table(tree, "node_code", [F.col(c) for c in ("lon", "lat", "alt", "lon", "lat", "alt")])
    doc = tileset_of(nodes, "i3dm", o, lambda r: min(max(o.min_geometric_error, r.diagonal), o.max_geometric_error))
    encode.write_tileset(doc, o.output)
    return doc


def placed_models(spark: SparkSession, o: Options, placements: DataFrame | None = None) -> DataFrame:
    """model_id, name, lon, lat, alt, vertices (metres east, north and up of that place), faces, triangles and half sizes of each model.

    Models are turned z up, rotated about x and scaled, then put at the placements whose href names their file (kml columns), at the
    longitude and latitude of the options, or where their own coordinates are in the options' system."""
    found = meshes.read_meshes(spark, o.input, "*.{obj,stl,ply,gltf,glb,b3dm}", strict=True, recursive=o.recursive)
    turn = np.radians(o.rotate_x)
    about_x = np.array([[1, 0, 0], [0, np.cos(turn), -np.sin(turn)], [0, np.sin(turn), np.cos(turn)]])
    shift = np.array([o.x_offset, o.y_offset, o.z_offset])

    def upright(batches):
        for b in batches:
            rows = []
            for path, y_up, flat, faces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.array(flat, np.float64).reshape(-1, 3)
                v = np.column_stack((v[:, 0], -v[:, 2], v[:, 1])) if y_up else v
                v = v @ about_x.T * o.scale + shift
                center = (v.min(axis=0) + v.max(axis=0)) / 2 if len(v) else np.zeros(3)
                rows.append((path, os.path.basename(path), *center, v.ravel().tolist(), faces))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "file", "cx", "cy", "cz", "vertices", "faces"])

    up = found.select("path", "y_up", "vertices", "faces").filter("size(faces) > 0").mapInArrow(upright, "path string, file string, cx double, cy double, cz double, vertices array<double>, faces array<int>")
    still = {"heading": F.lit(0.0), "size": F.lit(1.0)}
    if placements is not None:
        spots = placements.select(F.coalesce("name", F.lit("")).alias("name"), F.regexp_extract("href", "([^/]*)$", 1).alias("file"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("altitude").alias("alt"), "heading", F.col("scale_x").alias("size"), (F.col("altitude_mode") != "absolute").alias("clamp"))
        put = up.join(spots, "file").withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0), "oz": F.lit(0.0)})
    elif o.longitude is not None and o.latitude is not None:
        put = up.withColumns(still | {"name": F.col("file"), "lon": F.lit(o.longitude), "lat": F.lit(o.latitude), "alt": F.lit(0.0), "clamp": F.lit(True), "ox": F.lit(0.0), "oy": F.lit(0.0), "oz": F.lit(0.0)})
    else:
        lon, lat, h = geo.to_degrees(F.col("cx"), F.col("cy"), F.lit(0.0), o.crs)
        put = up.withColumns(still | {"name": F.col("file"), "lon": lon, "lat": lat, "alt": h, "clamp": F.lit(True), "ox": F.col("cx"), "oy": F.col("cy"), "oz": F.lit(0.0)})
    put = grounded(put, o, "lon", "lat", "alt", clamp=F.col("clamp"))

    def local(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                v = (np.array(r["vertices"]).reshape(-1, 3) - (r["ox"], r["oy"], r["oz"])) * r["size"]
                t = np.radians(r["heading"])  # clockwise from north
                v = np.column_stack((v[:, 0] * np.cos(t) + v[:, 1] * np.sin(t), v[:, 1] * np.cos(t) - v[:, 0] * np.sin(t), v[:, 2]))
                rows.append((r["path"], r["name"], r["lon"], r["lat"], r["alt"], v.ravel().tolist(), r["faces"], len(r["faces"]) // 3, *v.min(axis=0), *v.max(axis=0)))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64(), *[pa.float64()] * 6)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "name", "lon", "lat", "alt", "vertices", "faces", "triangles", "x0", "y0", "z0", "x1", "y1", "z1"])

    out = put.mapInArrow(local, "path string, name string, lon double, lat double, alt double, vertices array<double>, faces array<int>, triangles long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    corner = [geo.metres_to_degrees(F.col(c), "lat") for c in ("x0", "x1", "y0", "y1")]
    box = {"minx": F.col("lon") + corner[0][0], "maxx": F.col("lon") + corner[1][0], "miny": F.col("lat") + corner[2][1], "maxy": F.col("lat") + corner[3][1], "minz": F.col("alt") + F.col("z0"), "maxz": F.col("alt") + F.col("z1")}
    size = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2 + (F.col("z1") - F.col("z0")) ** 2)
    return out.withColumns(box | {"diagonal": size, "model_id": F.concat_ws("#", "path", "name", F.col("lon").cast("string"), F.col("lat").cast("string"))})


def levels_of(tree: DataFrame, o: Options) -> DataFrame:
    """Items of a tree with node_code, once for each level of detail: leaves have min_lod, nodes above them the coarser levels up to max_lod.

    A coarser level holds the items at least as large as its block error only; the root's level is the coarsest that is reached."""
    each = tree.withColumn("lod", F.explode(F.sequence(F.lit(o.min_lod), F.lit(max(o.min_lod, o.max_lod)))))
    up = F.col("lod") - o.min_lod
    block = F.array(*[F.lit(float(LOD_BLOCK[k] if k < 8 else 60 * (k - 1))) for k in range(max(o.min_lod, o.max_lod) + 1)])
    fits = (up == 0) | ((F.length("node_code") > up) & (F.col("diagonal") >= F.get(block, F.col("lod"))))
    return each.filter(fits).withColumn("node_code", F.substr("node_code", F.lit(1), F.length("node_code") - up))


def models(spark: SparkSession, o: Options, placements: DataFrame | None = None) -> dict:
    """Model files to b3dm (1.0) or glb (1.1) tiles with levels of detail, and tileset.json. placements: as read by vector.kml."""
    o = o.checked("models")
    placed = placed_models(spark, o, placements)
    items = checkpointer(spark)(placed)
    box = bounds_of(items, "lon", "lat", "alt")
    side = max(box[3] - box[0], box[4] - box[1], 1e-9)
    # split_by_node: every node of more than one model splits
    most, weight = (1, None) if o.split_by_node else (o.max_triangles, "triangles")
    tree = tiling.counted_tree(items, "quad", "lon", "lat", None, (box[0], box[1], 0.0, box[0] + side, box[1] + side, 0.0), most, NODE_DEPTH, weight)
    detailed = levels_of(tree, o)
    ext = "glb" if o.tiles_version != "1.0" else "b3dm"

    def encoder(t: pa.Table) -> bytes:
        rows = t.sort_by([("model_id", "ascending"), ("lod", "ascending")]).to_pylist()
        lat = np.radians(rows[0]["lat"])
        n = geo.SEMI_MAJOR / np.sqrt(1 - geo.E2 * np.sin(lat) ** 2)
        m = np.array([n * np.cos(lat) * np.pi / 180, n * np.pi / 180, 1.0])
        parts, triples, ids, base = [], [], [], 0
        for k, r in enumerate(rows):
            v, f = np.array(r["vertices"]).reshape(-1, 3), np.array(r["faces"], np.int32).reshape(-1, 3)
            if cell := (LOD_ERROR[r["lod"]] if r["lod"] < 8 else 1 << r["lod"]):
                v, f = mesh.cluster(v, f, float(cell))
            parts.append(v + (np.array([r["lon"], r["lat"], r["alt"]]) - (rows[0]["lon"], rows[0]["lat"], 0)) * m)
            triples.append(f + base)
            ids.append(np.full(len(v), k))
            base += len(v)
        v, f = np.concatenate(parts), np.concatenate(triples)
        table = {"Name": [r["name"] for r in rows], "Path": [r["path"] for r in rows]}
        body = encode.mesh_glb(v, f, mesh.vertex_normals(v, f), np.concatenate(ids), properties=None if ext == "b3dm" else table, batch_id=ext == "b3dm")
        return encode.b3dm(body, table, len(rows)) if ext == "b3dm" else body

    tiles = encode.encode_nodes(detailed, "node_code", ["model_id", "lod", "name", "path", "lon", "lat", "alt", "vertices", "faces"], encoder, ext)
    encode.write_tiles(tiles, o.output).agg(F.sum("bytes")).first()
    nodes = node_table(detailed, "node_code", [F.col(c) for c in ("minx", "miny", "minz", "maxx", "maxy", "maxz")])
    doc = tileset_of(nodes, ext, o, lambda r: min(max(o.min_geometric_error, r.diagonal), o.max_geometric_error) / (1 << (len(r.code) - 1)))
    encode.write_tileset(doc, o.output)
    return doc


def merged_nodes(found: DataFrame) -> DataFrame:
    """path, region, geometric_error and code of tile sets: quadrants of the common region, center ties to the first of SW, SE, NW, NE.

    The common region always splits, a quadrant while it holds more than one tile set, down to MERGE_DEPTH levels below the first."""
    sets = found.select("path", "geometric_error", *[F.col("region")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1", "z0", "z1"))])
    sets = sets.withColumns({"px": (F.col("x0") + F.col("x1")) / 2.0, "py": (F.col("y0") + F.col("y1")) / 2.0})
    r = sets.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if r[0] is None:
        raise ValueError("there is nothing to merge")
    box = (r[0], r[1], 0.0, max(r[2], r[0] + 1e-15), max(r[3], r[1] + 1e-15), 0.0)
    tree = tiling.counted_tree(sets, "quad", "px", "py", None, box, 1, MERGE_DEPTH + 1)
    first = tiling.path_code(1, "quad", "px", "py", None, box)
    return tree.withColumn("code", F.when(F.length("node_code") > 1, F.col("node_code")).otherwise(first)).drop("node_code", "px", "py")


def merge(spark: SparkSession, o: Options) -> dict:
    """One tileset.json above those of a folder: a quadtree of their region centers, a row per node from the executors."""
    o = o.checked("merge")
    sets = checkpointer(spark)(merged_nodes(meshes.read_tilesets(spark, o.input, o.recursive)))
    bounds = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.min, "z0"), (F.max, "z1"))]
    top = sets.agg(F.max("geometric_error").alias("e")).first()["e"]
    nodes = sets.select(F.explode(tiling.prefixes("code")).alias("node"), "x0", "y0", "x1", "y1", "z0", "z1").groupBy("node").agg(*bounds)
    volume = lambda r: {"region": [r.x0, r.y0, r.x1, r.y1, r.z0, r.z1]}
    # quadrants in the order SW, SE, NW, NE
    order = lambda code: (len(code), code.translate(str.maketrans("23", "32")))
    by = {}
    for r in sorted(nodes.collect(), key=lambda r: order(r.node)):  # one row per node
        by[r.node] = {"boundingVolume": volume(r), "geometricError": top, "refine": "ADD", "children": []}
        if len(r.node) > 1:
            by[r.node[:-1]]["children"].append(by[r.node])
    start = o.input.rstrip("/")
    for r in sorted(sets.collect(), key=lambda r: (r.code, r.path)):  # one row per tile set
        path = r.path.removeprefix("file:").replace("//", "/")
        uri = path[len(start) + 1 :] if path.startswith(start + "/") else r.path
        by[r.code]["children"].append({"boundingVolume": volume(r), "geometricError": r.geometric_error, "refine": "REPLACE", "content": {"uri": uri}})
    doc = {"asset": {"version": o.tiles_version}, "geometricError": min(top, o.max_geometric_error), "root": by["R"]}
    encode.write_tileset(doc, o.output)
    return doc


def plan_of(o: Options) -> str:
    """The options of a run as JSON, for its log."""
    return json.dumps({k: v for k, v in vars(o).items() if v is not None})
