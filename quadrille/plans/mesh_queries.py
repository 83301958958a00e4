"""Queries over geometry kernels: footprints become meshes in Arrow batches, and what comes out is measured.

Where the measure has a closed form it carries SQL; the others are checked by rows and by the tests of the kernels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import geo
from quadrille.operators import encode, mesh, tiling
from quadrille.plans import queries as base
from quadrille.plans.views import view, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
View = base.View


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: view(spark, sf_dir, name))
        if sql:
            SQL[fn.__name__] = with_views(sql)
        return fn

    return put


def footprints(v: View) -> DataFrame:
    """Sides in whole ten-thousandths of a degree, so that measures are exact."""
    side = lambda a: F.round((F.col(f"max{a}") - F.col(f"min{a}")) * 10000.0).cast("double")
    return v("features").select("feature_id", "category", side("x").alias("w"), side("y").alias("h"), F.coalesce("height", F.lit(1.0)).alias("top"))


SIDES = "(select feature_id, category, round((maxx - minx) * 10000e0) as w, round((maxy - miny) * 10000e0) as h, coalesce(height, 1e0) as top from features)"


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn of each row's values after the first column, which stays; its results are the columns of the schema after the first."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = [ARROW[k] for k in kinds]

    def run(batches):
        for b in batches:
            rows = [(k, *fn(*rest)) for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=list(names))

    # kernels are long and rows are short: a small table in few files is dealt to all cores first
    cores = df.sparkSession.sparkContext.defaultParallelism
    return (df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)).mapInArrow(run, schema)


def once(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """As `mapped`, with fn called once for each distinct set of values: for kernels that cost far more than the join back."""
    (first, *rest), (key, *fields) = df.columns, schema.split(", ")
    names, kinds = zip(*(x.split() for x in fields), strict=True)
    of = [f"_of{k}" for k in range(len(rest))]
    values = df.select(*[F.col(c).alias(o) for c, o in zip(rest, of, strict=True)]).distinct()
    shape = T.StructType([*values.schema.fields, *T.StructType.fromDDL(schema).fields[1:]])

    def run(batches):
        for b in batches:
            rows = [fn(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[*of, *names])

    # few rows and long kernels: dealt to all cores, in parts that are not put together again
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    made = values.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(conf))).mapInArrow(run, shape)
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(made[o]) for c, o in zip(rest, of, strict=True)])
    return df.join(made, same).select(df[first].alias(key.split()[0]), *[made[n] for n in names])


def box(w: float, h: float) -> list[tuple[float, float]]:
    return [(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)]


@query(f"select feature_id, cast(12 as bigint) as triangles, round(w * h * top, 3) as volume, round(2 * (w * h + w * top + h * top), 3) as area from {SIDES} s")
def extrude_polygons(v: View) -> DataFrame:
    def fn(w, h, top):
        p, f = mesh.extrude(box(w, h), [], 0.0, top)
        return len(f), round(abs(float(np.einsum("ij,ij->i", p[f[:, 0]], np.cross(p[f[:, 1]], p[f[:, 2]])).sum() / 6)), 3), round(mesh.area(p, f), 3)

    return mapped(footprints(v).select("feature_id", "w", "h", "top"), fn, "feature_id long, triangles long, volume double, area double")


@query(f"select feature_id, cast(8 as bigint) as triangles, round(w * h - w * h / 4e0, 3) as area from {SIDES} s")
def tessellate_with_hole(v: View) -> DataFrame:
    """A hole over the middle quarter is bridged, then ears are clipped."""

    def fn(w, h):
        hole = [(w / 4 + x / 2, h / 4 + y / 2) for x, y in box(w, h)]
        ring, tris = mesh.tessellate(box(w, h), [hole])
        return len(tris), round(sum(abs(mesh.cross2(*(ring[i] for i in t))) / 2 for t in tris), 3)

    return mapped(footprints(v).select("feature_id", "w", "h"), fn, "feature_id long, triangles long, area double")


@query(f"select feature_id, feature_id % 7 <> 0 as valid from {SIDES} s")
def polygon_validity(v: View) -> DataFrame:
    """Every seventh ring is a bow tie."""

    def fn(twist, w, h):
        a, b, c, d = box(w, h)
        return (mesh.valid_ring([a, c, b, d] if twist else [a, b, c, d]),)

    return mapped(footprints(v).select("feature_id", F.expr("feature_id % 7 = 0"), "w", "h"), fn, "feature_id long, valid boolean")


@query(f"select feature_id, greatest(1, cast(floor(w * h * 0.025e0) as bigint)) as placed, case when w * h * 0.025e0 >= 1 then greatest(1, cast(floor(w * h * 0.025e0) as bigint)) else 1 end as inside, cast(0 as bigint) as in_hole from {SIDES} s")
def random_points_in_polygon(v: View) -> DataFrame:
    """Points placed by area, and how many of them lie inside the ring and inside the box of another feature's size beyond it, counted by plain comparisons."""

    def fn(w, h):
        p = mesh.points_in_polygon([box(w, h)])
        x, y = p[:, 0], p[:, 1]
        return len(p), int(((x >= 0) & (x <= w) & (y >= 0) & (y <= h)).sum()), int(((x > w) | (y > h)).sum())

    return mapped(footprints(v).select("feature_id", "w", "h"), fn, "feature_id long, placed long, inside long, in_hole long")


@query(f"select feature_id, 8 * (1 + feature_id % 3) as vertices, 12 * (1 + feature_id % 3) - feature_id % 2 as faces, 3 * (feature_id % 2) as open_edges, 1 + feature_id % 3 as parts from {SIDES} s")
def weld_and_topology(v: View) -> DataFrame:
    """One to three extrusions with separate walls, every second set without one face, welded: corners, faces, open edges, parts."""

    def fn(k, w, h, top):
        points, faces = [], []
        for n in range(1 + k % 3):
            p, f = mesh.unweld(*mesh.extrude(box(w, h), [], 0.0, top))
            faces.append(f + sum(map(len, points)))
            points.append(p + (n * (w + 1.0), 0.0, 0.0))
        p, f = np.concatenate(points), np.concatenate(faces)
        p, f = mesh.weld(p, f[1:] if k % 2 else f)
        return len(p), len(f), len(mesh.boundary_edges(f)), len(mesh.separate(p, f))

    return mapped(footprints(v).select("feature_id", F.col("feature_id").alias("k"), "w", "h", "top"), fn, "feature_id long, vertices long, faces long, open_edges long, parts long")


@query(f"select feature_id, round(2 * (w * h + w * top + h * top), 3) as area, true as split from {SIDES} s")
def cut_by_plane(v: View) -> DataFrame:
    def fn(w, h, top):
        p, f = mesh.extrude(box(w, h), [], 0.0, top)
        low, high = mesh.cut(p, f, 0, w / 2)
        return round(mesh.area(*low) + mesh.area(*high), 3), bool(len(low[1]) and len(high[1]))

    return mapped(footprints(v).select("feature_id", "w", "h", "top"), fn, "feature_id long, area double, split boolean")


@query(f"""select feature_id, least(x0, x1, x2) <= w and greatest(x0, x1, x2) >= 0e0 and y <= h and y >= 0e0 and least(z0, z1, z2) <= top and greatest(z0, z1, z2) >= 0e0
    and not (w < x0 and w < x1 and w < x2) as meets from (select *, cast(feature_id * 7 % 31 as double) - 5e0 as x0, cast(feature_id * 7 % 31 as double) + 1e0 as x1, cast(feature_id * 7 % 31 as double) - 2e0 as x2,
    cast(feature_id * 11 % 41 as double) - 8e0 as y, cast(feature_id * 3 % 17 as double) - 4e0 as z0, cast(feature_id * 3 % 17 as double) - 4e0 as z1, cast(feature_id * 3 % 17 as double) - 4e0 as z2 from {SIDES} s)""")
def box_meets_triangle(v: View) -> DataFrame:
    """A triangle flat along y and z (a segment of x) somewhere about the box: it meets the box where the intervals of all axes meet."""

    def fn(k, w, h, top):
        x, y, z = float(k * 7 % 31), float(k * 11 % 41) - 8, float(k * 3 % 17) - 4
        tri = np.array([[[x - 5, y, z], [x + 1, y, z], [x - 2, y, z]]])
        return (bool(mesh.box_meets_triangles((0, 0, 0), (w, h, top), tri)[0]),)

    return mapped(footprints(v).select("feature_id", F.col("feature_id").alias("k"), "w", "h", "top"), fn, "feature_id long, meets boolean")


@query(f"select feature_id, cast(2 * (w + 1) * (h + 1) as bigint) as faces, true as fewer, (w + 1) * (h + 1) as area, cast(2 * (w + h + 2) as bigint) as old_border from {SIDES} s")
def decimate_meshes(v: View) -> DataFrame:
    """A flat grid over the footprint loses faces and keeps its area."""

    def fn(w, h):
        p, f = mesh.height_net(np.zeros((int(h) + 2, int(w) + 2)), 1.0)
        q, g = mesh.decimate(p, f, 10.0)
        return len(f), len(g) < len(f), round(mesh.area(q, g), 6), len(mesh.boundary_edges(f))

    return once(footprints(v).select("feature_id", "w", "h"), fn, "feature_id long, faces long, fewer boolean, area double, old_border long")


@query(f"select feature_id, cast(2 * w * h as bigint) as voxels, cast(0 as bigint) as open_edges, w as x, h as y from {SIDES} s")
def voxel_isosurface(v: View) -> DataFrame:
    """An extrusion two high as voxels, and the surface half way to the empty voxels around: always closed, as wide as the voxels."""

    def fn(w, h):
        grid, _ = mesh.voxelize(*mesh.extrude(box(w, h), [], 0.0, 2.0), 1.0)
        p, f = mesh.isosurface(np.pad(1.0 - grid, 1, constant_values=1.0), 0.5)
        size = p.max(axis=0) - p.min(axis=0)
        return int(grid.sum()), len(mesh.boundary_edges(f)), round(float(size[0]), 6), round(float(size[1]), 6)

    return once(footprints(v).select("feature_id", "w", "h"), fn, "feature_id long, voxels long, open_edges long, x double, y double")


@query("select feature_id, cast(4 * 16 + 2 as bigint) as vertices, cast(3 * 2 * 16 + 2 * 16 as bigint) as faces, cast(0 as bigint) as open_edges from features")
def pipe_meshes(v: View) -> DataFrame:
    def fn(w, h, top):
        p, f = mesh.pipe([(0, 0, 0), (w, 0, 0), (w, h, 0), (w, h, top)], 0.5)
        return len(p), len(f), len(mesh.boundary_edges(f))

    return mapped(footprints(v).select("feature_id", "w", "h", "top"), fn, "feature_id long, vertices long, faces long, open_edges long")


@query(f"select feature_id, cast(2 * (w + h + 2) as bigint) as border, cast(4 * (w + h + 2) as bigint) as added, round(2 * (w + h + 2) * 2e0, 6) as area from {SIDES} s")
def skirts(v: View) -> DataFrame:
    """A grid over the footprint with a skirt of two: its border, the faces that the skirt adds and their area."""

    def fn(w, h):
        p, f = mesh.height_net(np.zeros((int(h) + 2, int(w) + 2)), 1.0)
        q, g = mesh.skirt(p, f, 2.0)
        return len(mesh.boundary_edges(f)), len(g) - len(f), round(mesh.area(q, g) - mesh.area(p, f), 6)

    return mapped(footprints(v).select("feature_id", "w", "h"), fn, "feature_id long, border long, added long, area double")


@query("""with recursive o as (select category, feature_id, triangle_count, row_number() over (partition by category order by feature_id) as k from features),
    s(category, k, total, batch) as (select category, k, triangle_count, 0 from o where k = 1 union all
    select o.category, o.k, case when s.total + o.triangle_count >= 600 then o.triangle_count else s.total + o.triangle_count end, case when s.total + o.triangle_count >= 600 then s.batch + 1 else s.batch end
    from s join o on o.category = s.category and o.k = s.k + 1) select o.category, o.feature_id, s.batch from s join o on o.category = s.category and o.k = s.k""")
def batch_packing(v: View) -> DataFrame:
    """Batches of a category's primitives: a new one where the running count would reach the limit, a sum with resets."""
    rows = F.array_sort(F.collect_list(F.struct("feature_id", "triangle_count")))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(s, r):
        full = (s["total"] > 0) & (s["total"] + r["triangle_count"] >= 600)
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct((F.when(full, F.lit(0)).otherwise(s["total"]) + r["triangle_count"]).cast("bigint").alias("total"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    packed = v("features").groupBy("category").agg(rows.alias("rows")).select("category", "rows", F.aggregate("rows", start, step)["out"].alias("batches"))
    return packed.select("category", F.explode(F.arrays_zip("rows", "batches")).alias("z")).select("category", "z.rows.feature_id", F.col("z.batches").alias("batch"))


@query(f"select node_code, count(*) as n from ({base.sql_point_tree(2, 200, 800)}) t group by node_code")
def encode_point_tiles(v: View) -> DataFrame:
    """Tiles of a point tree, decoded again for their counts."""
    from quadrille.sources.meshes import unpack_tile

    points = v("points").withColumns({c: (F.col(f"{c}16") / 257).cast("int") for c in "rgb"})
    tree = tiling.point_lod_tree(points, "lon", "lat", "h", base.POINT_ORDER, base.ROOT, 200, 800, depth=2, cut=base.checkpointer(points.sparkSession))
    tiles = encode.encode_pnts(tree, "node_code", "lon", "lat", "h", ("r", "g", "b"), "intensity", "classification")

    def run(batches):
        for b in batches:
            n = [unpack_tile(c)["feature"]["POINTS_LENGTH"] for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["node_code", "n"])

    return tiles.select("node_code", "content").mapInArrow(run, "node_code string, n long")


@query("select face_id, round(sqrt(nx * nx + ny * ny + nz * nz), 6) as size, round(sqrt(nx * nx + ny * ny + nz * nz) / 2e0, 6) as area from (select face_id, sum(ay * bz - az * by_) as nx, sum(az * bx - ax * bz) as ny, sum(ax * by_ - ay * bx) as nz from (select face_id, cast(v0 % 11 as double) as ax, cast(v0 % 7 as double) as ay, cast(v0 % 5 as double) as az, cast(v1 % 11 as double) as bx, cast(v1 % 7 as double) as by_, cast(v1 % 5 as double) as bz from edges) group by face_id)")
def polygon_normals(v: View) -> DataFrame:
    """Normal of each face as the sum of the cross products along its ring, and its area."""
    k = lambda c, m: (F.col(c) % m).cast("double")
    ax, ay, az, bx, by, bz = k("v0", 11), k("v0", 7), k("v0", 5), k("v1", 11), k("v1", 7), k("v1", 5)
    n = v("edges").groupBy("face_id").agg(F.sum(ay * bz - az * by).alias("nx"), F.sum(az * bx - ax * bz).alias("ny"), F.sum(ax * by - ay * bx).alias("nz"))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return n.select("face_id", F.round(size, 6).alias("size"), F.round(size / 2.0, 6).alias("area"))


@query("select feature_id, cast(floor(d * 256e0) as bigint) % 256 as b0, cast(floor(d * 65536e0) as bigint) % 256 as b1, cast(floor(d * 16777216e0) as bigint) % 256 as b2, round(cast(floor(d * 16777216e0) as double) / 16777216e0, 7) as unpacked from (select feature_id, cast(feature_id % 1000 as double) / 1000e0 as d from features)")
def pack_depth(v: View) -> DataFrame:
    """A depth in [0, 1) as three bytes and back."""
    d = F.col("d")
    byte = lambda s: F.floor(d * s) % 256
    return v("features").select("feature_id", ((F.col("feature_id") % 1000).cast("double") / 1000.0).alias("d")).select("feature_id", byte(256.0).alias("b0"), byte(65536.0).alias("b1"), byte(16777216.0).alias("b2"), F.round(F.floor(d * 16777216.0).cast("double") / 16777216.0, 7).alias("unpacked"))


WELDS = "(select feature_id as u, feature_id + 7 as v from features where feature_id % 35 < 28 union all select feature_id, feature_id - feature_id % 35 from features where feature_id % 5 = 0 and feature_id >= 35)"


@query(f"""with recursive e as (select u, v from {WELDS} w union select v, u from {WELDS} w),
    r(vertex, label) as (select distinct u, u from e union select e.v, r.label from r join e on e.u = r.vertex)
    select vertex, min(label) as component from r group by vertex""")
def welded_groups(v: View) -> DataFrame:
    """Connected parts of vertices that touch: chains of five and hubs, many parts; each vertex with the smallest one of its part."""
    from quadrille.operators import graph
    from quadrille.plans.flows import checkpointer

    f = v("features").select(F.col("feature_id").alias("u"))
    edges = f.filter("u % 35 < 28").select("u", (F.col("u") + 7).alias("v")).union(f.filter("u % 5 = 0 and u >= 35").select("u", (F.col("u") - F.col("u") % 35).alias("v")))
    cut = checkpointer(f.sparkSession)
    labels = graph.components(edges, lambda df, _: cut(df))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    alone = edges.filter("u = v").select(F.col("u").alias("vertex"), F.col("u").alias("component")).join(labels.select(F.col("node").alias("vertex")), "vertex", "left_anti")
    return graph.join_on_hot(labels, least, "root", "node").select(F.col("node").alias("vertex"), "component").union(alone)


@query("select category, feature_id, dist from (select a.category, b.feature_id, round(sqrt((a.mx - b.minx) * (a.mx - b.minx) + (a.my - b.miny) * (a.my - b.miny)), 9) as dist, row_number() over (partition by a.category order by round(sqrt((a.mx - b.minx) * (a.mx - b.minx) + (a.my - b.miny) * (a.my - b.miny)), 9), b.feature_id) as k from (select category, min(minx) as mx, min(miny) as my from features group by category) a join features b on a.category = b.category) where k = 1")
def nearest_vertex(v: View) -> DataFrame:
    """The vertex of each group nearest its lower corner: a minimum by distance, no sort."""
    f = v("features").select("category", "feature_id", "minx", "miny")
    low = f.groupBy("category").agg(F.min("minx").alias("mx"), F.min("miny").alias("my"))
    dx, dy = F.col("mx") - F.col("minx"), F.col("my") - F.col("miny")
    best = f.join(low, "category").groupBy("category").agg(F.min(F.struct(F.round(F.sqrt(dx * dx + dy * dy), 9).alias("dist"), "feature_id")).alias("b"))
    return best.select("category", "b.feature_id", "b.dist")


@query("select feature_id, round(minx * 111000e0 * c - miny * 111000e0 * s, 3) as x, round(minx * 111000e0 * s + miny * 111000e0 * c, 3) as y, 2e0 * top as z from (select *, cos(radians(cast(feature_id % 360 as double))) as c, sin(radians(cast(feature_id % 360 as double))) as s, coalesce(height, 1e0) as top from features)")
def bake_transform(v: View) -> DataFrame:
    """Rotation about z and a scale, as a matrix applied to each vertex."""
    a = F.radians((F.col("feature_id") % 360).cast("double"))
    x, y = F.col("minx") * 111000.0, F.col("miny") * 111000.0
    return v("features").select("feature_id", F.round(x * F.cos(a) - y * F.sin(a), 3).alias("x"), F.round(x * F.sin(a) + y * F.cos(a), 3).alias("y"), (F.coalesce("height", F.lit(1.0)) * 2.0).alias("z"))


@query(f"select l_suppkey, count(*) as n, max(place) as last from (select l_suppkey, row_number() over (partition by l_suppkey order by {base.ORDER_SQL}) as place from points) group by l_suppkey")
def file_order(v: View) -> DataFrame:
    points = v("points")
    placed = tiling.placed(points, ["l_suppkey"], base.POINT_ORDER, "place", base.checkpointer(points.sparkSession))
    return placed.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("place").alias("last"))


@query("select feature_id, round(sqrt(dx * dx + dy * dy + 1e0), 4) as diagonal from (select feature_id, " + base.R_MID + " * cos((radians(miny) + radians(maxy)) / 2e0) * (radians(maxx) - radians(minx)) as dx, (" + base.R_A + " + " + base.R_B + ") / 2e0 * (radians(maxy) - radians(miny)) as dy from features)")
def degree_diagonal(v: View) -> DataFrame:
    return v("features").select("feature_id", F.round(geo.degree_diagonal("minx", "miny", F.lit(0.0), "maxx", "maxy", F.lit(1.0)), 4).alias("diagonal"))
