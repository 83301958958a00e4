"""The queries: each is an operator applied to the derived views, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions import geo
from quadrille.operators import filters, tiling
from quadrille.plans.flows import checkpointer
from quadrille.plans.views import view, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
View = Callable[[str], DataFrame]


def query(sql: str):
    """Register a function of the views under its own name; the SQL may name views."""

    def put(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: view(spark, sf_dir, name))
        SQL[fn.__name__] = with_views(sql)
        return fn

    return put


POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: A total order of points up to equal rows.
POINT_ORDER = ["rnd_key", *POINT_KEY, "lon", "lat", "h", "r16", "g16", "b16", "intensity", "classification"]
ORDER_SQL = ", ".join(POINT_ORDER)
TX = "greatest(0, least(8191, cast(floor((lon + 180e0) / 360e0 * 8192e0) as int)))"
TY = "greatest(0, least(8191, cast(floor((90e0 - lat) / 180e0 * 8192e0) as int)))"


def bounds(*axes: str) -> list:
    return [f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))]


BOUNDS = "min(lon) as min_lon, max(lon) as max_lon, min(lat) as min_lat, max(lat) as max_lat, min(h) as min_h, max(h) as max_h"

# ---- points: keys, buckets, decoding


@query(f"select {TX} as tx, {TY} as ty, count(*) as n, {BOUNDS}, floor(radians(min(lon)) * 1e8) / 1e8 as west, floor(radians(max(lat)) * 1e8) / 1e8 as north from points group by 1, 2")
def point_bucket_summary(v: View) -> DataFrame:
    keyed = v("points").select(geo.tile_x("lon", 13).alias("tx"), geo.tile_y("lat", 13).alias("ty"), "lon", "lat", "h")
    out = keyed.groupBy("tx", "ty").agg(F.count("*").alias("n"), *bounds("lon", "lat", "h"))
    return out.withColumns({"west": geo.cut_fast(F.radians("min_lon")), "north": geo.cut_fast(F.radians("max_lat"))})


@query(f"select distinct {TX} as tx, {TY} as ty, {TX} * (360e0 / 8192e0) - 180e0 as west, 90e0 - ({TY} + 1) * (180e0 / 8192e0) as south, ({TX} + 1) * (360e0 / 8192e0) - 180e0 as east, 90e0 - {TY} * (180e0 / 8192e0) as north from points")
def tile_bounds(v: View) -> DataFrame:
    keys = v("points").select(geo.tile_x("lon", 13).alias("tx"), geo.tile_y("lat", 13).alias("ty")).distinct()
    return keys.select("tx", "ty", *[c.alias(n) for c, n in zip(geo.tile_bounds("tx", "ty", 13), ("west", "south", "east", "north"), strict=True)])


@query(f"select distinct {TX} as tx, {TY} as ty, ({TX} & 65535) | (({TY} & 65535) << 16) as bucket from points")
def bucket_id(v: View) -> DataFrame:
    return v("points").select(geo.tile_x("lon", 13).alias("tx"), geo.tile_y("lat", 13).alias("ty")).distinct().withColumn("bucket", geo.bucket_id("tx", "ty"))


@query(f"select {', '.join(POINT_KEY)}, lon, lat, h from (select *, row_number() over (partition by l_suppkey order by {ORDER_SQL}) - 1 as i from points) where i % 4 = 0")
def stride_sample(v: View) -> DataFrame:
    p = v("points")
    return filters.stride_sample(p, ["l_suppkey"], POINT_ORDER, 30, checkpointer(p.sparkSession)).select(*POINT_KEY, "lon", "lat", "h")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(trunc(cast(r16 as double) / 65535e0 * 255e0) as int) as r, cast(trunc(cast(g16 as double) / 65535e0 * 255e0) as int) as g, cast(trunc(cast(b16 as double) / 65535e0 * 255e0) as int) as b, r16 % 256 as r_low, 129 as none from points")
def rgb_scale(v: View) -> DataFrame:
    scaled = [(F.col(f"{c}16").cast("double") / 65535.0 * 255.0).cast("int").alias(c) for c in "rgb"]
    return v("points").select(*POINT_KEY, *scaled, (F.col("r16") % 256).alias("r_low"), F.lit(129).alias("none"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(r16 as double) * 0.001e0 + 200000e0 as x, cast(g16 as double) * 0.001e0 + 500000e0 as y, cast(b16 as double) * 0.01e0 as z from points")
def las_decode(v: View) -> DataFrame:
    return v("points").select(*POINT_KEY, (F.col("r16").cast("double") * 0.001 + 200000.0).alias("x"), (F.col("g16").cast("double") * 0.001 + 500000.0).alias("y"), (F.col("b16").cast("double") * 0.01).alias("z"))


@query("""select b.k as byte, greatest(0, least(255, cast(floor((case when b.k / 255e0 <= 0.04045e0 then b.k / 255e0 / 12.92e0 else pow((b.k / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end) * 255e0 + 0.5e0) as int))) as linear_byte, count(*) as n
    from (select cast(trunc(cast(r16 as double) / 65535e0 * 255e0) as int) as k from points) b group by 1, 2""")
def srgb_linear(v: View) -> DataFrame:
    bytes_ = v("points").select((F.col("r16").cast("double") / 65535.0 * 255.0).cast("int").alias("byte"))
    return bytes_.groupBy("byte").count().select("byte", geo.linear_from_srgb("byte").alias("linear_byte"), F.col("count").alias("n"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, tx, ty,
    cast(least(65535, greatest(0, trunc((lon - mx) / case when wx = 0 then 1 else wx end * 65535e0))) as int) as qx,
    cast(least(65535, greatest(0, trunc((lat - my) / case when wy = 0 then 1 else wy end * 65535e0))) as int) as qy,
    cast(least(65535, greatest(0, trunc((h - mz) / case when wz = 0 then 1 else wz end * 65535e0))) as int) as qz
    from (select *, min(lon) over w as mx, max(lon) over w - min(lon) over w as wx, min(lat) over w as my, max(lat) over w - min(lat) over w as wy, min(h) over w as mz, max(h) over w - min(h) over w as wz
    from (select *, cast(floor(lon * 10e0) as int) as tx, cast(floor(lat * 10e0) as int) as ty from points) window w as (partition by tx, ty))""")
def quantize_u16(v: View) -> DataFrame:
    # extents by a pre-aggregated group-by and a join, so that no tile has to fit in one task's window
    p = v("points").withColumns({"tx": F.floor(F.col("lon") * 10.0).cast("int"), "ty": F.floor(F.col("lat") * 10.0).cast("int")})
    ext = p.groupBy("tx", "ty").agg(*bounds("lon", "lat", "h"))
    both = p.join(ext, ["tx", "ty"])

    def q(a: str, name: str):
        width = F.col(f"max_{a}") - F.col(f"min_{a}")
        width = F.when(width == 0, 1.0).otherwise(width)
        return F.greatest(F.lit(0), F.least(F.lit(65535), ((F.col(a) - F.col(f"min_{a}")) / width * 65535.0).cast("int"))).alias(name)

    return both.select(*POINT_KEY, "tx", "ty", q("lon", "qx"), q("lat", "qy"), q("h", "qz"))


# ---- filters


@query("select feature_id, category, kind from features where category = 'Brand#4' or category = 'Brand#7' or kind = 'PROMO' or 'null' = coalesce(cast(height as varchar), 'null')")
def attribute_or_filter(v: View) -> DataFrame:
    return filters.attribute_filter(v("features"), "category=Brand#4,Brand#7;kind=PROMO;broken;height=null").select("feature_id", "category", "kind")


@query("select feature_id, minx, miny from features where case when feature_id % 11 = 0 then null else minx end is not null")
def null_geometry_drop(v: View) -> DataFrame:
    f = v("features").withColumn("geometry", F.when(F.col("feature_id") % 11 != 0, F.struct("minx", "miny")))
    return f.filter("geometry is not null").select("feature_id", "geometry.minx", "geometry.miny")


@query("""select feature_id, t.part from features, (select 0 as part union all select 1 union all select 2) t
    where (feature_id % 4 in (0, 2) and t.part = 0) or (feature_id % 4 in (1, 3) and t.part < 1 + feature_id % 3)""")
def geometry_type_filter(v: View) -> DataFrame:
    """Multi-part geometries are exploded; only polygons and lines, single or multi, stay."""
    kinds = F.array(*[F.lit(k) for k in ("Polygon", "MultiPolygon", "LineString", "MultiLineString")])
    f = v("features").withColumn("type", F.element_at(kinds, (F.col("feature_id") % 4 + 1).cast("int")))
    f = f.withColumn("parts", F.when(F.col("type").startswith("Multi"), F.sequence(F.lit(0), (F.col("feature_id") % 3).cast("int"))).otherwise(F.array(F.lit(0))))
    return f.filter(F.col("type").isin("Polygon", "MultiPolygon", "LineString", "MultiLineString")).select("feature_id", F.explode("parts").alias("part"))


@query("select feature_id, feature_id % 6 as n, case when feature_id % 2 = 0 then feature_id % 6 >= 3 else feature_id % 6 >= 2 end as kept from features")
def min_vertex_filter(v: View) -> DataFrame:
    ring = F.when(F.col("feature_id") % 6 > 0, F.sequence(F.lit(1).cast("bigint"), F.col("feature_id") % 6)).otherwise(F.array().cast("array<bigint>"))
    f = v("features").withColumn("ring", ring)
    return f.select("feature_id", F.size("ring").cast("bigint").alias("n"), F.when(F.col("feature_id") % 2 == 0, F.size("ring") >= 3).otherwise(F.size("ring") >= 2).alias("kept"))


@query("select feature_id, 5 - (case when feature_id % 3 = 0 then 1 else 0 end) as n from features")
def collinear_vertex_removal(v: View) -> DataFrame:
    """A closed square; every third one has a point in the middle of an edge and a repeated one, which go."""
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    square = F.array(p(0.0, 0.0), p(1.0, 0.0), p(1.0, 1.0), p(0.0, 1.0), p(0.0, 0.0))
    bent = F.array(p(0.0, 0.0), p(0.5, 0.0), p(1.0, 0.0), p(0.0, 1.0), p(0.0, 0.0))
    ring = F.when(F.col("feature_id") % 3 == 0, bent).otherwise(square)
    return v("features").select("feature_id", F.size(filters.polygon_rings(ring)).alias("n"))


DIAG = "sqrt((maxx - minx) * (maxx - minx) + (maxy - miny) * (maxy - miny))"


@query(f"select feature_id, l.lod, {DIAG} * 100000e0 >= l.err as kept from features, (select 1 as lod, 8e0 as err union all select 2, 50e0 union all select 3, 120e0) l")
def lod_size_filter(v: View) -> DataFrame:
    f = v("features").withColumn("d", F.sqrt((F.col("maxx") - F.col("minx")) * (F.col("maxx") - F.col("minx")) + (F.col("maxy") - F.col("miny")) * (F.col("maxy") - F.col("miny"))) * 100000.0)
    lods = F.explode(F.array(*[F.struct(F.lit(k).alias("lod"), F.lit(e).alias("err")) for k, e in ((1, 8.0), (2, 50.0), (3, 120.0))]))
    return f.select("feature_id", "d", lods.alias("l")).select("feature_id", "l.lod", (F.col("d") >= F.col("l.err")).alias("kept"))


@query("select instance_id, lon, lat from instances where lon between 126.7e0 and 127.1e0 and lat between 36.6e0 and 37.2e0 and alt between 10e0 and 60e0")
def box_contains_point(v: View) -> DataFrame:
    box = [F.lit(x).alias(n) for x, n in zip((126.7, 36.6, 10.0, 127.1, 37.2, 60.0), filters.BOX, strict=True)]
    return v("instances").select("*", *box).filter(filters.contains_point("lon", "lat", "alt")).select("instance_id", "lon", "lat")


FBOX = ["minx", "miny", "maxx", "maxy"]


@query("""select a.feature_id as a, b.feature_id as b, greatest(a.minx, b.minx) as x0, greatest(a.miny, b.miny) as y0 from features a join features b
    on a.feature_id < b.feature_id and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy""")
def box_overlap_join(v: View) -> DataFrame:
    f = v("features")
    a = f.select(F.col("feature_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in FBOX])
    b = f.select(F.col("feature_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in FBOX])
    pairs = tiling.box_join(a, b, [f"a_{c}" for c in FBOX], [f"b_{c}" for c in FBOX], 0.01).filter("a < b")
    return pairs.select("a", "b", F.greatest("a_minx", "b_minx").alias("x0"), F.greatest("a_miny", "b_miny").alias("y0"))


@query("""select feature_id, case when ok then greatest(minx, 127.2e0) end as x0, case when ok then greatest(miny, 37.2e0) end as y0, case when ok then least(maxx, 127.6e0) end as x1, case when ok then least(maxy, 37.6e0) end as y1, inside
    from (select *, greatest(minx, 127.2e0) < least(maxx, 127.6e0) and greatest(miny, 37.2e0) < least(maxy, 37.6e0) as ok, 127.2e0 <= minx and 37.2e0 <= miny and maxx <= 127.6e0 and maxy <= 37.6e0 as inside from features)""")
def box_intersection(v: View) -> DataFrame:
    own, tile = [F.col(c) for c in FBOX], [F.lit(x) for x in (127.2, 37.2, 127.6, 37.6)]
    return v("features").select("feature_id", *[c.alias(n) for c, n in zip(filters.intersection(own, tile), ("x0", "y0", "x1", "y1"), strict=True)], filters.contains_box(tile, own).alias("inside"))


@query("""select feature_id, (0.5e0 * minx + 0.25e0 * miny + 1e0 * 0 - 73e0) <= 0 and (0.5e0 * maxx + 0.25e0 * maxy + 1e0 * coalesce(height, 0e0) - 73e0) >= 0 as crosses from features""")
def box_plane(v: View) -> DataFrame:
    box = [F.col("minx"), F.col("miny"), F.lit(0.0), F.col("maxx"), F.col("maxy"), F.coalesce("height", F.lit(0.0))]
    return v("features").select("feature_id", filters.crosses_plane(box, (0.5, 0.25, 1.0), -73.0).alias("crosses"))


@query("select feature_id from features where (minx + maxx) / 2e0 between 127.1e0 and 127.5e0 and (miny + maxy) / 2e0 between 37.1e0 and 37.5e0")
def center_in_volume(v: View) -> DataFrame:
    cx, cy = (F.col("minx") + F.col("maxx")) / 2.0, (F.col("miny") + F.col("maxy")) / 2.0
    return v("features").filter(cx.between(127.1, 127.5) & cy.between(37.1, 37.5)).select("feature_id")


@query("select feature_id, triangle_count from features where height is not null and triangle_count > 0")
def null_set_filter(v: View) -> DataFrame:
    return v("features").filter("height is not null and triangle_count > 0").select("feature_id", "triangle_count")


# ---- projections


@query("select feature_id, greatest(coalesce(height, 5e0), 5e0) as height, coalesce(altitude, 0e0) as altitude, 10e0 as diameter_default, coalesce(height, 10e0) as diameter, 10e0 + coalesce(height, 0e0) as diameter_compat from features")
def height_coalesce(v: View) -> DataFrame:
    return v("features").select("feature_id", F.greatest(F.coalesce("height", F.lit(5.0)), F.lit(5.0)).alias("height"), F.coalesce("altitude", F.lit(0.0)).alias("altitude"), F.lit(10.0).alias("diameter_default"), F.coalesce("height", F.lit(10.0)).alias("diameter"), (F.lit(10.0) + F.coalesce("height", F.lit(0.0))).alias("diameter_compat"))


@query("select feature_id, least(coalesce(height, 1e0), altitude) as floor, greatest(coalesce(height, 1e0), altitude) + 4e0 as roof from features")
def floor_roof_swap(v: View) -> DataFrame:
    h = F.coalesce("height", F.lit(1.0))
    return v("features").select("feature_id", F.least(h, "altitude").alias("floor"), (F.greatest(h, "altitude") + 4.0).alias("roof"))


@query("select feature_id, 'category=' || coalesce(category, 'Null') || ';feature_id=' || cast(feature_id as varchar) || ';height=' || coalesce(cast(cast(height as bigint) as varchar), 'Null') || ';kind=' || coalesce(kind, 'Null') as attributes from features")
def stringify_map(v: View) -> DataFrame:
    names = ["category", "feature_id", "height", "kind"]
    text = {"height": F.col("height").cast("bigint").cast("string")}
    m = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(text.get(n, F.col(n).cast("string")), F.lit("Null")) for n in names]))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return v("features").select("feature_id", m.alias("m")).select("feature_id", F.array_join(entries, ";").alias("attributes"))


@query("select feature_id, miny as x, minx as y, exists_z from (select *, feature_id % 5 <> 0 as exists_z from features)")
def flip_and_ring_3d(v: View) -> DataFrame:
    p = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    z = (F.col("feature_id") % 5).cast("double")
    f = v("features").withColumn("ring", F.array(p(F.col("minx"), F.col("miny"), z), p(F.col("maxx"), F.col("maxy"), F.lit(float("nan")))))
    flipped = F.transform("ring", lambda q: p(q["y"], q["x"], q["z"]))
    solid = F.exists("ring", lambda q: ~F.isnan(q["z"]) & (q["z"] != 0.0))
    return f.select("feature_id", flipped[0]["x"].alias("x"), flipped[0]["y"].alias("y"), solid.alias("exists_z"))


@query("""select category, count(*) as n, string_agg(cast(feature_id as varchar), ',' order by feature_id) as ids, string_agg(kind, ',' order by feature_id) as kinds from features group by category""")
def batch_table(v: View) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("feature_id", "kind")))
    out = v("features").groupBy("category").agg(F.count("*").alias("n"), rows.alias("rows"))
    return out.select("category", "n", F.array_join(F.col("rows.feature_id").cast("array<string>"), ",").alias("ids"), F.array_join("rows.kind", ",").alias("kinds"))


@query("select feature_id, category, row_number() over (partition by category order by feature_id) - 1 as batch_id from features")
def batch_ordinal(v: View) -> DataFrame:
    f = v("features").select("feature_id", "category")
    return tiling.placed(f, ["category"], ["feature_id"], "place", checkpointer(f.sparkSession)).select("feature_id", "category", (F.col("place") - 1).alias("batch_id"))


@query("select feature_id, category, row_number() over (partition by category order by feature_id) as serial from features")
def serial_number(v: View) -> DataFrame:
    f = v("features").select("feature_id", "category")
    return tiling.placed(f, ["category"], ["feature_id"], "serial", checkpointer(f.sparkSession))


# ---- joins


@query("select instance_id, model_href, m.triangles from instances join (select 'view' as href, 12 as triangles union all select 'click', 40 union all select 'error', 96) m on model_href = m.href")
def placement_model_join(v: View) -> DataFrame:
    i = v("instances")
    models = i.sparkSession.createDataFrame([("view", 12), ("click", 40), ("error", 96)], "href string, triangles int")
    return i.join(models, i.model_href == models.href).select("instance_id", "model_href", "triangles")


@query("select instance_id, s.scene, s.radius from instances cross join (select 'tree' as scene, 2.5e0 as radius) s")
def instance_cross(v: View) -> DataFrame:
    """Every placement with the one scene: a literal, as one row needs no join."""
    return v("instances").select("instance_id", F.lit("tree").alias("scene"), F.lit(2.5).alias("radius"))


GRID = "((lon - 126.5e0) * 25e0)", "((lat - 36.5e0) * 4e0)"
SAMPLE_SQL = """(select instance_id, altitude_mode, alt, round(sum(case when t.v is null then 0e0 else t.v end * c.wx * c.wy), 6) as sample from
    (select *, floor(gx) + dx as cx, floor(gy) + dy as cy, case when dx = 1 then gx - floor(gx) else 1e0 - (gx - floor(gx)) end as wx, case when dy = 1 then gy - floor(gy) else 1e0 - (gy - floor(gy)) end as wy
    from (select instance_id, altitude_mode, alt, ((lon - 126.5e0) * 25e0) as gx, ((lat - 36.5e0) * 4e0) as gy from instances) p, (select 0 as dx union all select 1) a, (select 0 as dy union all select 1) b) c
    left join terrain t on t.ix = c.cx and t.iy = c.cy group by 1, 2, 3)"""


def sampled(v: View) -> DataFrame:
    points = v("instances").select("instance_id", "altitude_mode", "alt", "lon", "lat")
    out = tiling.bilinear(points, v("terrain"), (F.col("lon") - 126.5) * 25.0, (F.col("lat") - 36.5) * 4.0)
    return out.select("instance_id", "altitude_mode", "alt", F.round("sample", 6).alias("sample"))


@query(f"select instance_id, sample from {SAMPLE_SQL} s")
def raster_bilinear(v: View) -> DataFrame:
    return sampled(v).select("instance_id", "sample")


@query(f"select instance_id, case when altitude_mode = 'absolute' then alt else alt + sample end as z, alt + case when altitude_mode = 'absolute' then alt else sample end as z_compat from {SAMPLE_SQL} s")
def placement_terrain(v: View) -> DataFrame:
    fixed = F.col("altitude_mode") == "absolute"
    return sampled(v).select("instance_id", F.when(fixed, F.col("alt")).otherwise(F.col("alt") + F.col("sample")).alias("z"), (F.col("alt") + F.when(fixed, F.col("alt")).otherwise(F.col("sample"))).alias("z_compat"))


@query(f"select instance_id, alt + sample + 23.5e0 as z from {SAMPLE_SQL} s")
def terrain_sum(v: View) -> DataFrame:
    """Height plus the sum over all coverages plus a constant geoid."""
    return sampled(v).select("instance_id", (F.col("alt") + F.col("sample") + 23.5).alias("z"))


@query("select f.feature_id, f.kind, f.category, m.master from features f join (select kind, category, min(feature_id) as master from features group by 1, 2) m on f.kind = m.kind and f.category = m.category")
def material_group_key(v: View) -> DataFrame:
    f = v("features")
    masters = f.groupBy("kind", "category").agg(F.min("feature_id").alias("master"))
    return f.join(masters, ["kind", "category"]).select("feature_id", "kind", "category", "master")


PAIRED = "(select *, row_number() over (partition by v0, v1 order by face_id, corner) as k from edges)"


def numbered(v: View) -> DataFrame:
    return v("edges").withColumn("k", F.row_number().over(Window.partitionBy("v0", "v1").orderBy("face_id", "corner")))


@query(f"select a.face_id, a.corner, b.face_id as twin_face, b.corner as twin_corner from {PAIRED} a join {PAIRED} b on a.v0 = b.v1 and a.v1 = b.v0 and a.k = b.k")
def halfedge_twins(v: View) -> DataFrame:
    e = numbered(v)
    t = e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"), "k", F.col("face_id").alias("twin_face"), F.col("corner").alias("twin_corner"))
    return e.join(t, ["v0", "v1", "k"]).select("face_id", "corner", "twin_face", "twin_corner")


@query(f"select a.face_id, a.corner, a.v0, a.v1 from {PAIRED} a where not exists (select 1 from {PAIRED} b where a.v0 = b.v1 and a.v1 = b.v0 and a.k = b.k)")
def boundary_edges(v: View) -> DataFrame:
    e = numbered(v)
    return e.join(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"), "k"), ["v0", "v1", "k"], "left_anti").select("face_id", "corner", "v0", "v1")


@query("select v0 as vertex, count(*) as faces, min(face_id) as first_face from edges group by v0")
def vertex_faces(v: View) -> DataFrame:
    return v("edges").groupBy(F.col("v0").alias("vertex")).agg(F.count("*").alias("faces"), F.min("face_id").alias("first_face"))


@query("select feature_id, x.cx, y.cy from features, unnest(range(cast(floor(minx / 0.002e0) as bigint), cast(floor(maxx / 0.002e0) as bigint) + 1)) x(cx), unnest(range(cast(floor(miny / 0.002e0) as bigint), cast(floor(maxy / 0.002e0) as bigint) + 1)) y(cy)")
def box_cells(v: View) -> DataFrame:
    return tiling.grid_overlap_join(v("features"), FBOX, 0.002).select("feature_id", "cx", "cy")


@query("select a.feature_id, b.feature_id as next_id, b.minx - a.minx as dx from (select *, lead(feature_id) over (partition by category order by feature_id) as n from features) a join features b on a.n = b.feature_id")
def pipe_topology(v: View) -> DataFrame:
    w = Window.partitionBy("category").orderBy("feature_id")
    return v("features").select("feature_id", F.lead("feature_id").over(w).alias("next_id"), (F.lead("minx").over(w) - F.col("minx")).alias("dx")).filter("next_id is not null")


# ---- aggregates


@query("select category, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy, max(height) as maxz, count(*) as n from features group by category")
def bbox_union(v: View) -> DataFrame:
    return v("features").groupBy("category").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.max("height").alias("maxz"), F.count("*").alias("n"))


@query(f"select category, round(least(greatest(16e0, max({DIAG} * 100000e0)), 200e0), 6) as geometric_error from features group by category")
def geometric_error(v: View) -> DataFrame:
    d = F.sqrt((F.col("maxx") - F.col("minx")) * (F.col("maxx") - F.col("minx")) + (F.col("maxy") - F.col("miny")) * (F.col("maxy") - F.col("miny"))) * 100000.0
    return v("features").groupBy("category").agg(F.round(F.least(F.greatest(F.lit(16.0), F.max(d)), F.lit(200.0)), 6).alias("geometric_error"))


@query("select category, cast(sum(triangle_count) as bigint) as triangles, sum(triangle_count) > 1000 as over_budget from features group by category")
def triangle_budget(v: View) -> DataFrame:
    return v("features").groupBy("category").agg(F.sum("triangle_count").alias("triangles"), (F.sum("triangle_count") > 1000).alias("over_budget"))


def sql_descend(levels: int, kind: str) -> str:
    """The midpoint split as nested selects over points."""
    q = "(select *, 'R' as code, 126e0 as x0, 128e0 as x1, 36e0 as y0, 38e0 as y1, 0e0 as z0, 64e0 as z1 from points)"
    above = {"quad": ("(x0 + x1) / 2e0 < lon", "(y0 + y1) / 2e0 < lat", "true"), "octant": ("lon > (x0 + x1) / 2e0", "lat > (y0 + y1) / 2e0", "h > (z0 + z1) / 2e0"), "ring": ("not lon < (x0 + x1) / 2e0", "not lat < (y0 + y1) / 2e0", "not h < (z0 + z1) / 2e0")}[kind]
    letter = {
        "quad": "case when b then case when a then '2' else '3' end else case when a then '1' else '0' end end",
        "octant": "substr('ACBDEGFH', 1 + case when c then 4 else 0 end + case when a then 2 else 0 end + case when b then 1 else 0 end, 1)",
        "ring": "cast(case when b then case when a then 2 else 3 end else case when a then 1 else 0 end end + case when c then 4 else 0 end as varchar)",
    }[kind]
    halves = ", ".join(f"case when {t} then ({n}0 + {n}1) / 2e0 else {n}0 end as {n}0, case when {t} then {n}1 else ({n}0 + {n}1) / 2e0 end as {n}1" for t, n in (("a", "x"), ("b", "y"), *((("c", "z"),) if kind != "quad" else ())))
    drop = "x0, x1, y0, y1, a, b, c, code" + (", z0, z1" if kind != "quad" else "")
    for _ in range(levels):
        q = f"(select * exclude ({drop}), code || {letter} as code, {halves} from (select *, {above[0]} as a, {above[1]} as b, {above[2]} as c from {q} s) s)"
    return q


ROOT = (126.0, 36.0, 0.0, 128.0, 38.0, 64.0)


def descended(v: View, levels: int, kind: str) -> DataFrame:
    start = v("points").select("*", F.lit("R").alias("code"), *[F.lit(x).alias(n) for n, x in (("nx0", 126.0), ("nx1", 128.0), ("ny0", 36.0), ("ny1", 38.0), ("nz0", 0.0), ("nz1", 64.0))])
    return tiling.descend(start, levels, kind, "lon", "lat", "h" if kind != "quad" else None)


@query(f"select code, count(*) as n from {sql_descend(6, 'quad')} s group by code")
def quad_split(v: View) -> DataFrame:
    return descended(v, 6, "quad").groupBy("code").agg(F.count("*").alias("n"))


@query(f"select code, count(*) as n, min(h) as low from {sql_descend(4, 'octant')} s group by code")
def octant_split(v: View) -> DataFrame:
    return descended(v, 4, "octant").groupBy("code").agg(F.count("*").alias("n"), F.min("h").alias("low"))


@query(f"select code, count(*) as n, max(h) as high from {sql_descend(4, 'ring')} s group by code")
def generic_octree_split(v: View) -> DataFrame:
    return descended(v, 4, "ring").groupBy("code").agg(F.count("*").alias("n"), F.max("h").alias("high"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, code as node from {sql_descend(3, 'ring')} s")
def point_in_node(v: View) -> DataFrame:
    return descended(v, 3, "ring").select(*POINT_KEY, F.col("code").alias("node"))


@query(f"select substr(code, 1, cast(k.n as bigint)) as node, count(*) as n, count(distinct code) as leaves, max(length(code)) - cast(k.n as bigint) as depth_below from {sql_descend(4, 'quad')} s, unnest(range(1, 6)) k(n) where k.n <= length(code) group by 1, k.n")
def subtree_rollup(v: View) -> DataFrame:
    """Points are combined by leaf first; only leaves are expanded to their prefixes."""
    leaves = descended(v, 4, "quad").groupBy("code").agg(F.count("*").alias("n"))
    up = leaves.select(F.explode(tiling.prefixes("code")).alias("node"), "n", "code")
    return up.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("leaves"), (F.max(F.length("code")) - F.first(F.length("node"))).cast("bigint").alias("depth_below"))


@query(f"select substr(code, 1, cast(k.n as bigint)) as node, floor(radians(min(lon)) * 1e8) / 1e8 as west, floor(radians(min(lat)) * 1e8) / 1e8 as south, floor(radians(max(lon)) * 1e8) / 1e8 as east, floor(radians(max(lat)) * 1e8) / 1e8 as north, floor(min(h) * 1e8) / 1e8 as low, floor(max(h) * 1e8) / 1e8 as high from {sql_descend(4, 'quad')} s, unnest(range(1, 6)) k(n) group by 1")
def region_recalc(v: View) -> DataFrame:
    leaves = descended(v, 4, "quad").groupBy("code").agg(*bounds("lon", "lat", "h"))
    up = leaves.select(F.explode(tiling.prefixes("code")).alias("node"), *[c for c in leaves.columns if c != "code"])
    box = up.groupBy("node").agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in ("lon", "lat", "h") for f, n in ((F.min, "min"), (F.max, "max"))])
    return box.select("node", *[c.alias(n) for c, n in zip(geo.region("min_lon", "min_lat", "min_h", "max_lon", "max_lat", "max_h"), ("west", "south", "east", "north", "low", "high"), strict=True)])


@query("select min(x0) as x0, min(y0) as y0, min(z0) as z0, max(x1) as x1, max(y1) as y1, max(z1) as z1, max(geometric_error) as geometric_error, count(*) as n from tilesets")
def merge_bounds(v: View) -> DataFrame:
    return v("tilesets").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "z0")], *[F.max(c).alias(c) for c in ("x1", "y1", "z1", "geometric_error")], F.count("*").alias("n"))


@query("select cx, cy, n, cast(sx as double) / cast(n * 10000 as double) as x, cast(sy as double) / cast(n * 10000 as double) as y from (select cast(floor(lon * 50e0) as bigint) as cx, cast(floor(lat * 50e0) as bigint) as cy, count(*) as n, sum(cast(round(lon * 10000e0) as bigint)) as sx, sum(cast(round(lat * 10000e0) as bigint)) as sy from points group by 1, 2) where n >= 2")
def vertex_cluster_mean(v: View) -> DataFrame:
    """Mean of the vertices of a cell, from sums of whole ten-thousandths that do not depend on their order."""
    whole = lambda c: F.sum(F.round(F.col(c) * 10000.0).cast("bigint")).cast("double")
    cells = v("points").groupBy(F.floor(F.col("lon") * 50.0).alias("cx"), F.floor(F.col("lat") * 50.0).alias("cy")).agg(F.count("*").alias("n"), whole("lon").alias("sx"), whole("lat").alias("sy"))
    size = (F.col("n") * 10000).cast("double")
    return cells.filter("n >= 2").select("cx", "cy", "n", (F.col("sx") / size).alias("x"), (F.col("sy") / size).alias("y"))


@query("select cast(min(floor(lon * 50e0)) as bigint) as x0, cast(max(floor(lon * 50e0)) as bigint) as x1, cast(min(floor(lat * 50e0)) as bigint) as y0, cast(max(floor(lat * 50e0)) as bigint) as y1 from points")
def cell_extent(v: View) -> DataFrame:
    return v("points").agg(*[f(F.floor(F.col(c) * 50.0)).alias(n) for c, f, n in (("lon", F.min, "x0"), ("lon", F.max, "x1"), ("lat", F.min, "y0"), ("lat", F.max, "y1"))])


@query("select classification, cast(sum(r16) as bigint) as r_sum, round(avg(r16), 6) as r, round(avg(g16), 6) as g, round(avg(b16), 6) as b from points group by classification")
def average_colour(v: View) -> DataFrame:
    return v("points").groupBy("classification").agg(F.sum("r16").alias("r_sum"), *[F.round(F.avg(f"{c}16"), 6).alias(c) for c in "rgb"])


@query("select category, min(n) as row_count from (select category, kind, count(*) as n from features group by 1, 2) group by category")
def min_property_count(v: View) -> DataFrame:
    lists = v("features").groupBy("category", "kind").agg(F.count("*").alias("n"))
    return lists.groupBy("category").agg(F.min("n").alias("row_count"))


@query("select kind, count(distinct category) as materials, count(*) as n from features group by kind")
def distinct_materials(v: View) -> DataFrame:
    return v("features").groupBy("kind").agg(F.countDistinct("category").alias("materials"), F.count("*").alias("n"))


@query("select category, count(*) as tiles, cast(sum(triangle_count * 36) as bigint) as bytes from features group by category")
def run_summary(v: View) -> DataFrame:
    return v("features").groupBy("category").agg(F.count("*").alias("tiles"), F.sum(F.col("triangle_count") * 36).alias("bytes"))


@query("select face_id, round(sum(abs((v0 * 3 % 11) * (v1 * 7 % 13) - (v0 * 7 % 13) * (v1 * 3 % 11))) / 2e0, 6) as area from edges group by face_id")
def surface_area(v: View) -> DataFrame:
    a, b, c, d = (F.col(x) * k % m for x, k, m in (("v0", 3, 11), ("v1", 7, 13), ("v0", 7, 13), ("v1", 3, 11)))
    return v("edges").groupBy("face_id").agg(F.round(F.sum(F.abs(a * b - c * d)) / 2.0, 6).alias("area"))


# ---- order and sets


CELL = "cast(floor(lon * 5e0) as bigint) as cx, cast(floor(lat * 5e0) as bigint) as cy"


def celled(v: View) -> DataFrame:
    return v("points").withColumns({"cx": F.floor(F.col("lon") * 5.0), "cy": F.floor(F.col("lat") * 5.0)})


@query(f"select {', '.join(POINT_KEY)}, cx, cy, rank <= 20 as own from (select *, row_number() over (partition by cx, cy order by {ORDER_SQL}) as rank from (select *, {CELL} from points))")
def lod_take_n(v: View) -> DataFrame:
    out = tiling.first_of_each(celled(v), ["cx", "cy"], POINT_ORDER, F.lit(20), 20, POINT_KEY)
    return out.select(*POINT_KEY, "cx", "cy", F.col("_own").alias("own"))


@query("select instance_id, cx, rank <= greatest(128, least(1024, n // 4)) as own from (select *, row_number() over (partition by cx order by k, instance_id) as rank, count(*) over (partition by cx) as n from (select instance_id, cast(floor(lon * 2e0) as bigint) as cx, (instance_id * 7919) % 65537 as k from instances))")
def instance_divide(v: View) -> DataFrame:
    i = v("instances").select("instance_id", F.floor(F.col("lon") * 2.0).alias("cx"), (F.col("instance_id") * 7919 % 65537).alias("k"))
    sized = i.join(i.groupBy("cx").agg(F.greatest(F.lit(128), F.least(F.lit(1024), F.expr("count(*) div 4"))).alias("limit")), "cx")
    return tiling.first_of_each(sized, ["cx"], ["k", "instance_id"], F.col("limit"), 1024, ["instance_id"]).select("instance_id", "cx", F.col("_own").alias("own"))


@query(f"select {', '.join(POINT_KEY)}, cx, cy, row_number() over (partition by cx, cy order by {ORDER_SQL}) as place from (select *, {CELL} from points)")
def hash_shuffle_order(v: View) -> DataFrame:
    points = celled(v)
    return tiling.placed(points, ["cx", "cy"], POINT_ORDER, "place", checkpointer(points.sparkSession)).select(*POINT_KEY, "cx", "cy", "place")


@query(f"select code, length(code) as size, rank() over (order by length(code), code) as place from (select code from {sql_descend(3, 'quad')} s group by code)")
def content_order(v: View) -> DataFrame:
    """Node codes, at most 85 of them here, by length and code."""
    codes = descended(v, 3, "quad").groupBy("code").count()
    return codes.select("code", F.length("code").cast("bigint").alias("size"), F.rank().over(Window.orderBy(F.length("code"), "code")).alias("place"))


@query(f"select feature_id, 'result' as part from features where {DIAG} * 100000e0 >= 250e0 union all select feature_id, 'remain' from features where not {DIAG} * 100000e0 >= 250e0")
def result_remain_split(v: View) -> DataFrame:
    f = v("features")
    d = F.sqrt((F.col("maxx") - F.col("minx")) * (F.col("maxx") - F.col("minx")) + (F.col("maxy") - F.col("miny")) * (F.col("maxy") - F.col("miny"))) * 100000.0
    return f.filter(d >= 250.0).select("feature_id", F.lit("result").alias("part")).unionByName(f.filter(~(d >= 250.0)).select("feature_id", F.lit("remain").alias("part")))


@query("select count(*) as points, 0 as lost, 0 as added from points")
def multiset_invariant(v: View) -> DataFrame:
    """A split into two parts loses and adds nothing: counted by exceptAll of the parts against the whole."""
    p = v("points").select(*POINT_KEY, "lon", "lat")
    parts = p.filter("l_orderkey % 3 = 0").unionByName(p.filter("l_orderkey % 3 <> 0"))
    tally = p.groupBy(*p.columns).agg(F.count("*").alias("a")).join(parts.groupBy(*p.columns).agg(F.count("*").alias("b")), p.columns, "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return tally.agg(F.sum(a).alias("points"), F.sum(F.greatest(a - b, F.lit(0))).cast("int").alias("lost"), F.sum(F.greatest(b - a, F.lit(0))).cast("int").alias("added"))


@query("select 'feature' as source, feature_id as id, minx as x, miny as y from features union all select 'instance', instance_id, lon, lat from instances")
def union_items(v: View) -> DataFrame:
    f = v("features").select(F.lit("feature").alias("source"), F.col("feature_id").alias("id"), F.col("minx").alias("x"), F.col("miny").alias("y"))
    return f.unionByName(v("instances").select(F.lit("instance").alias("source"), F.col("instance_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y")))


@query("select v0, v1, ((v1 - v0) * (v1 - v0)) as squared, row_number() over (partition by face_id order by (v1 - v0) * (v1 - v0), corner) as place, face_id from edges")
def edge_length_order(v: View) -> DataFrame:
    sq = (F.col("v1") - F.col("v0")) * (F.col("v1") - F.col("v0"))
    return v("edges").select("v0", "v1", sq.alias("squared"), F.row_number().over(Window.partitionBy("face_id").orderBy(sq, "corner")).alias("place"), "face_id")


@query("select face_id, corner, coalesce(lag(v0) over w, last_value(v0) over f) as prev, v0, v1 as next from edges window w as (partition by face_id order by corner), f as (partition by face_id order by corner rows between unbounded preceding and unbounded following)")
def ring_neighbours(v: View) -> DataFrame:
    ring = v("edges").groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("corner", "v0"))).alias("r"))
    each = F.transform("r", lambda q, i: F.struct(q["corner"].alias("corner"), F.get("r", F.pmod(i - 1, F.size("r")))["v0"].alias("prev"), q["v0"].alias("v0"), F.get("r", F.pmod(i + 1, F.size("r")))["v0"].alias("next")))
    return ring.select("face_id", F.explode(each).alias("e")).select("face_id", "e.*")


# ---- scalars


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) as x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) as y, round((n * (1e0 - 6.69437999014e-3) + h) * sin(radians(lat)), 3) as z
    from (select *, 6378137e0 / sqrt(1e0 - 6.69437999014e-3 * sin(radians(lat)) * sin(radians(lat))) as n from points)""")
def ecef(v: View) -> DataFrame:
    return v("points").select(*POINT_KEY, *[F.round(c, 3).alias(n) for c, n in zip(geo.ecef("lon", "lat", "h"), "xyz", strict=True)])


@query("select instance_id, round(lon, 7) as lon, round(lat, 7) as lat, round(alt, 3) as alt from instances")
def ecef_round_trip(v: View) -> DataFrame:
    xyz = v("instances").select("instance_id", *[c.alias(n) for c, n in zip(geo.ecef("lon", "lat", "alt"), "xyz", strict=True)])
    return xyz.select("instance_id", *[F.round(c, d).alias(n) for c, d, n in zip(geo.geographic("x", "y", "z"), (7, 7, 3), ("lon", "lat", "alt"), strict=True)])


@query("""select instance_id, round(-sin(radians(lon)), 6) as ex, round(cos(radians(lon)), 6) as ey, round(p * cos(radians(lon)) / sqrt(p * p + q * q), 6) as ux, round(q / sqrt(p * p + q * q), 6) as uz from
    (select instance_id, lon, (n + alt) * cos(radians(lat)) / (6378137e0 * 6378137e0) as p, (n * (1e0 - 6.69437999014e-3) + alt) * sin(radians(lat)) / (6356752.3142e0 * 6356752.3142e0) as q from
    (select *, 6378137e0 / sqrt(1e0 - 6.69437999014e-3 * sin(radians(lat)) * sin(radians(lat))) as n from instances))""")
def enu_matrix(v: View) -> DataFrame:
    """All instances: above the surface the up vector is that of the scaled ellipsoid through the point."""
    m = geo.enu(*geo.ecef("lon", "lat", "alt"))
    return v("instances").select("instance_id", F.round(m[0], 6).alias("ex"), F.round(m[1], 6).alias("ey"), F.round(m[6], 6).alias("ux"), F.round(m[8], 6).alias("uz"))


@query("select instance_id, round(lon, 9) as lon, round(lat, 9) as lat from instances")
def web_mercator(v: View) -> DataFrame:
    m = v("instances").select("instance_id", *[c.alias(n) for c, n in zip(geo.degrees_to_mercator("lon", "lat"), "xy", strict=True)])
    return m.select("instance_id", *[F.round(c, 9).alias(n) for c, n in zip(geo.mercator_to_degrees("x", "y"), ("lon", "lat"), strict=True)])


RADIUS = "(6378137e0 / sqrt(1e0 - 6.69437999014e-3 * sin({0}) * sin({0})))"
R_MID, R_A, R_B = (RADIUS.format(x) for x in ("((radians(miny) + radians(maxy)) / 2e0)", "radians(miny)", "radians(maxy)"))


@query(f"select feature_id, round({R_MID} * cos((radians(miny) + radians(maxy)) / 2e0) * (radians(maxx) - radians(minx)), 4) as dx, round(({R_A} + {R_B}) / 2e0 * (radians(maxy) - radians(miny)), 4) as dy, round(degrees(100e0 / ({R_A} * cos(radians(miny)))), 8) as lon_of_100m, round(degrees(100e0 / {R_A}), 8) as lat_of_100m from features")
def metres_between_degrees(v: View) -> DataFrame:
    dx, dy = geo.metres_between("minx", "miny", "maxx", "maxy")
    lon, lat = geo.metres_to_degrees(100.0, "miny")
    return v("features").select("feature_id", F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"), F.round(lon, 8).alias("lon_of_100m"), F.round(lat, 8).alias("lat_of_100m"))


@query("select feature_id, floor(minx * 1e8) / 1e8 as minx, floor(miny * 1e8) / 1e8 as miny from features")
def cut_fast(v: View) -> DataFrame:
    return v("features").select("feature_id", geo.cut_fast("minx").alias("minx"), geo.cut_fast("miny").alias("miny"))


@query("select feature_id, case when b // 1073741824 > 0 then (b // 1073741824)::varchar || 'GB' when b // 1048576 > 0 then (b // 1048576)::varchar || 'MB' when b // 1024 > 0 then (b // 1024)::varchar || 'KB' else b::varchar || 'bytes' end as shown from (select feature_id, feature_id * feature_id * feature_id * 7 as b from features)")
def byte_display(v: View) -> DataFrame:
    # whole decimals of 38 digits: the product outgrows 64 bits from id 1,096,303 on, and a double would round its quotient
    k = F.col("feature_id").cast("decimal(20,0)")
    b = F.col("b")
    unit = lambda n, name: F.concat(((b - b % n) / n).cast("decimal(38,0)").cast("string"), F.lit(name))
    return v("features").select("feature_id", (k * k * k * 7).alias("b")).select("feature_id", F.when(b >= 1 << 30, unit(1 << 30, "GB")).when(b >= 1 << 20, unit(1 << 20, "MB")).when(b >= 1 << 10, unit(1 << 10, "KB")).otherwise(F.concat(b.cast("string"), F.lit("bytes"))).alias("shown"))


@query("select feature_id, case when t // 3600000 > 0 then (t // 3600000)::varchar || 'h ' else '' end || case when t % 3600000 // 60000 > 0 then (t % 3600000 // 60000)::varchar || 'm ' else '' end || case when t % 60000 // 1000 > 0 then (t % 60000 // 1000)::varchar || 's ' else '' end || (t % 1000)::varchar || 'ms' as shown from (select feature_id, feature_id * 123457 as t from features)")
def duration_display(v: View) -> DataFrame:
    t = F.col("t")
    part = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise("")
    return v("features").select("feature_id", (F.col("feature_id") * 123457).alias("t")).select("feature_id", F.concat(part(F.floor(t / 3600000), "h "), part(F.floor(t % 3600000 / 60000), "m "), part(F.floor(t % 60000 / 1000), "s "), (t % 1000).cast("string"), F.lit("ms")).alias("shown"))


@query("select tileset_id, case when x1 - x0 > y1 - y0 then x1 else x1 + abs((x1 - x0) - (y1 - y0)) end as x1, case when x1 - x0 > y1 - y0 then y1 + abs((x1 - x0) - (y1 - y0)) else y1 end as y1 from (select tileset_id, x0, y0, x1 + z1 / 100e0 as x1, y1 from tilesets)")
def square_region(v: View) -> DataFrame:
    t = v("tilesets").withColumn("x1", F.col("x1") + F.col("z1") / 100.0)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return t.select("tileset_id", F.when(w > h, F.col("x1")).otherwise(F.col("x1") + F.abs(w - h)).alias("x1"), F.when(w > h, F.col("y1") + F.abs(w - h)).otherwise(F.col("y1")).alias("y1"))


@query(f"""select feature_id, floor(radians(minx) * 1e8) / 1e8 as west, floor(radians(maxy) * 1e8) / 1e8 as north, (minx + maxx) / 2e0 as center_x, greatest((maxx - minx) / 2e0, (maxy - miny) / 2e0) as half, coalesce(height, 0e0) / 2e0 as half_z,
    floor(sqrt((maxx - minx) * (maxx - minx) + (maxy - miny) * (maxy - miny) + coalesce(height, 0e0) * coalesce(height, 0e0)) * 1e8) / 1e8 as radius from features""")
def bounding_volume_arrays(v: View) -> DataFrame:
    top = F.coalesce("height", F.lit(0.0))
    r = geo.region("minx", "miny", F.lit(0.0), "maxx", "maxy", top)
    return v("features").select("feature_id", r[0].alias("west"), r[3].alias("north"), ((F.col("minx") + F.col("maxx")) / 2.0).alias("center_x"), F.greatest((F.col("maxx") - F.col("minx")) / 2.0, (F.col("maxy") - F.col("miny")) / 2.0).alias("half"), (top / 2.0).alias("half_z"), geo.cut_fast(geo.diagonal("minx", "miny", F.lit(0.0), "maxx", "maxy", top)).alias("radius"))


@query("select feature_id, u, case when u < 0 or u > 1 then u - floor(u) + case when u > 1 and u = floor(u) then 1e0 else 0e0 end else u end as s from (select feature_id, cast(feature_id % 41 - 20 as double) / 8e0 as u from features)")
def texcoord_quadrant(v: View) -> DataFrame:
    """Whole steps of one into [0, 1]; an exact 1 stays 1."""
    u = F.col("u")
    inside = u - F.floor(u) + F.when((u > 1) & (u == F.floor(u)), 1.0).otherwise(0.0)
    return v("features").select("feature_id", ((F.col("feature_id") % 41 - 20).cast("double") / 8.0).alias("u")).select("feature_id", "u", F.when((u < 0) | (u > 1), inside).otherwise(u).alias("s"))


@query("""select feature_id, n, cast(case when n - pow(2, floor(log2(n))) <= pow(2, ceil(log2(n))) - n then pow(2, floor(log2(n))) else pow(2, ceil(log2(n))) end as int) as nearest, cast(pow(2, ceil(log2(n))) as int) as higher, cast(pow(2, ceil(log2(n)) - 1) as int) as lower from (select feature_id, cast(2 + feature_id % 1000 as double) as n from features)""")
def power_of_two(v: View) -> DataFrame:
    n = v("features").select("feature_id", (F.lit(2) + F.col("feature_id") % 1000).cast("double").alias("n"))
    return n.select("feature_id", "n", *[geo.power_of_two("n", how).alias(how) for how in ("nearest", "higher", "lower")])


@query("select feature_id, round(case when e < 0.01e0 then 0.01e0 when e < 0.1e0 then 0.1e0 when e > 0.5e0 and d / 2e0 < 1e0 then 1e0 else e end, 9) as error from (select feature_id, d, d / 2e0 * greatest(0.01e0, least(1e0, 1000e0 / cast(lim as double))) as e from (select feature_id, cast(triangle_count as double) / 32e0 as d, 500 + feature_id % 9 * 7000 as lim from features))")
def child_error(v: View) -> DataFrame:
    d = F.col("triangle_count").cast("double") / 32.0
    limit = (F.lit(500) + F.col("feature_id") % 9 * 7000).cast("double")
    return v("features").select("feature_id", F.round(geo.child_error(d, limit, d / 2.0), 9).alias("error"))


@query("select feature_id, code, case when 3 - length(split_part(code, 'C', 2)) < 1 then -1 else 3 - length(split_part(code, 'C', 2)) end as lod from (select feature_id, 'R01C' || repeat('0', cast(feature_id % 5 as int)) as code from features)")
def lod_from_code(v: View) -> DataFrame:
    lod = F.lit(3) - F.length(F.element_at(F.split("code", "C"), 2))
    return v("features").select("feature_id", F.concat(F.lit("R01C"), F.repeat(F.lit("0"), (F.col("feature_id") % 5).cast("int"))).alias("code")).select("feature_id", "code", F.when(lod < 1, -1).otherwise(lod).cast("bigint").alias("lod"))


@query("""select feature_id, cast(ceil(log2(m / 25e0)) as int) as depth, case lod when 0 then 0.01e0 when 1 then 1e0 when 2 then 2e0 else round(6378137e0 * radians(maxy - miny) * 0.05e0, 6) end as error from (select *, cast(100 + feature_id * 37 as double) as m, feature_id % 5 as lod from features)""")
def photogrammetry_depth(v: View) -> DataFrame:
    lod = F.col("feature_id") % 5
    m = (F.lit(100) + F.col("feature_id") * 37).cast("double")
    size = F.round(F.radians(F.col("maxy") - F.col("miny")) * geo.SEMI_MAJOR * 0.05, 6)
    return v("features").select("feature_id", F.ceil(F.log2(m / 25.0)).cast("int").alias("depth"), F.when(lod == 0, 0.01).when(lod == 1, 1.0).when(lod == 2, 2.0).otherwise(size).alias("error"))


@query("select feature_id, x.ix, y.iy, 0.5e0 * x.ix + 0.25e0 as px, 0.5e0 * y.iy + 0.25e0 as py from features, unnest(range(0, 1 + feature_id % 3)) x(ix), unnest(range(0, 1 + feature_id % 2)) y(iy)")
def voxel_expand(v: View) -> DataFrame:
    f = v("features").select("feature_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("feature_id") % 3)).alias("ix")).select("feature_id", "ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("feature_id") % 2)).alias("iy"))
    return f.select("feature_id", "ix", "iy", (F.col("ix") * 0.5 + 0.25).alias("px"), (F.col("iy") * 0.5 + 0.25).alias("py"))


@query("select feature_id, category, cast(coalesce(sum(strlen(s)) over (partition by category order by feature_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start, strlen(s) as size from (select feature_id, category, case when kind is null or kind = '' or feature_id % 13 = 0 then ' ' else kind end as s from features)")
def string_table_offsets(v: View) -> DataFrame:
    s = F.when(F.col("kind").isNull() | (F.col("kind") == "") | (F.col("feature_id") % 13 == 0), " ").otherwise(F.col("kind"))
    f = v("features").select("feature_id", "category", F.octet_length(s).cast("bigint").alias("size"))
    return tiling.placed(f, ["category"], ["feature_id"], "start", checkpointer(f.sparkSession), F.col("size"))


@query("""select feature_id, coalesce(try_cast(case when t like '%이상%미만' then replace(split_part(t, '이상', 2), '미만', '') when t like '%미만' then replace(t, '미만', '') when t like '%이상' then replace(t, '이상', '') else t end as double), 5e0) as height from
    (select feature_id, case when s like '%임분고%' then replace(replace(replace(s, '임분고', ''), ' ', ''), 'm', '') else s end as t from
    (select feature_id, case feature_id % 6 when 0 then null when 1 then '임분고 8m이상 10m 미만' when 2 then '임분고 6m 미만' when 3 then '임분고 22m이상' when 4 then '7.5' else 'none' end as s from features))""")
def forest_height_parse(v: View) -> DataFrame:
    choice = [None, "임분고 8m이상 10m 미만", "임분고 6m 미만", "임분고 22m이상", "7.5", "none"]
    s = F.element_at(F.array(*[F.lit(c).cast("string") for c in choice]), (F.col("feature_id") % 6 + 1).cast("int"))
    bare = F.when(F.col("s").contains("임분고"), F.translate(F.regexp_replace("s", "임분고", ""), " m", "")).otherwise(F.col("s"))
    number = F.regexp_replace(F.regexp_replace("t", "^.*이상(?=.)", ""), "미만|이상", "")
    return v("features").select("feature_id", s.alias("s")).select("feature_id", bare.alias("t")).select("feature_id", F.coalesce(number.try_cast("double"), F.lit(5.0)).alias("height"))


@query("select feature_id, s, s || repeat(' ', cast((8 - length(s) % 8) % 8 as int)) || '|' as pad8, s || repeat(' ', cast(case when length(s) % 4 = 0 then 0 else 8 - length(s) % 4 end as int)) || '|' as pad4 from (select feature_id, '{\"id\":' || cast(feature_id as varchar) || '}' as s from features)")
def pad_json(v: View) -> DataFrame:
    n = F.length("s")
    s = v("features").select("feature_id", F.concat(F.lit('{"id":'), F.col("feature_id").cast("string"), F.lit("}")).alias("s"))
    pad = lambda k: F.concat("s", F.repeat(F.lit(" "), k.cast("int")), F.lit("|"))
    return s.select("feature_id", "s", pad((F.lit(8) - n % 8) % 8).alias("pad8"), pad(F.when(n % 4 == 0, 0).otherwise(F.lit(8) - n % 4)).alias("pad4"))


@query("select instance_id, regexp_extract(p, '([^/]*)$', 1) as file, regexp_extract(p, '\\.([^./]*)$', 1) as extension, regexp_extract(p, '([^/]*)\\.[^./]*$', 1) as raw_name, split_part(p, '/', 2) as folder from (select instance_id, 'data/' || model_href || '/t' || cast(instance_id % 7 as varchar) || '.b.glb' as p from instances)")
def path_parts(v: View) -> DataFrame:
    p = v("instances").select("instance_id", F.concat(F.lit("data/"), "model_href", F.lit("/t"), (F.col("instance_id") % 7).cast("string"), F.lit(".b.glb")).alias("p"))
    return p.select("instance_id", F.regexp_extract("p", "([^/]*)$", 1).alias("file"), F.regexp_extract("p", r"\.([^./]*)$", 1).alias("extension"), F.regexp_extract("p", r"([^/]*)\.[^./]*$", 1).alias("raw_name"), F.element_at(F.split("p", "/"), 2).alias("folder"))


@query("select feature_id, depth, x // 2 as parent_x, y // 2 as parent_y, greatest(0, x - 1) as left_x, case when x + 1 < (1 << cast(depth as int)) then x + 1 end as right_x from (select feature_id, cast(1 + feature_id % 6 as int) as depth, feature_id % (1 << cast(1 + feature_id % 6 as int)) as x, feature_id * 7 % (1 << cast(1 + feature_id % 6 as int)) as y from features)")
def octree_navigation(v: View) -> DataFrame:
    depth = (F.lit(1) + F.col("feature_id") % 6).cast("int")
    f = v("features").withColumn("depth", depth).withColumn("side", F.pow(F.lit(2.0), "depth").cast("bigint"))
    f = f.select("feature_id", "depth", "side", (F.col("feature_id") % F.col("side")).alias("x"), (F.col("feature_id") * 7 % F.col("side")).alias("y"))
    return f.select("feature_id", "depth", F.expr("x div 2").alias("parent_x"), F.expr("y div 2").alias("parent_y"), F.greatest(F.lit(0).cast("bigint"), F.col("x") - 1).alias("left_x"), F.when(F.col("x") + 1 < F.col("side"), F.col("x") + 1).alias("right_x"))


LEGEND = [(0.0, 0.0), (10.0, 0.5), (45.0, 1.0)]
LEGEND_SQL = ", ".join(f"({v}e0, {c}e0)" for v, c in LEGEND)


@query(f"""select feature_id, h, round(case when lo.v is null then hi.c when hi.v is null then lo.c else lo.c + (hi.c - lo.c) * ((h - lo.v) / (hi.v - lo.v)) end, 9) as red
    from (select feature_id, cast(feature_id % 13 * 5 - 5 as double) as h, (select max(v) from (values {LEGEND_SQL}) s(v, c) where v < cast(feature_id % 13 * 5 - 5 as double)) as below,
    (select min(v) from (values {LEGEND_SQL}) s(v, c) where v > cast(feature_id % 13 * 5 - 5 as double)) as above from features) f
    left join (values {LEGEND_SQL}) lo(v, c) on lo.v = below left join (values {LEGEND_SQL}) hi(v, c) on hi.v = above""")
def legend_colour(v: View) -> DataFrame:
    """Heights below, at, between and above the stops: a value is mixed from the strictly lower and the strictly higher stop."""
    f = v("features").select("feature_id", (F.col("feature_id") % 13 * 5 - 5).cast("double").alias("h"))
    return f.select("feature_id", "h", F.round(geo.legend(F.col("h"), LEGEND), 9).alias("red"))


# Surface classes and their colours.
CLASSES = [("Wall", 0.5, 0.5, 0.5, 1.0), ("Roof", 1.0, 0.0, 0.0, 1.0), ("Door", 0.0, 0.0, 1.0, 1.0), ("Window", 0.0, 1.0, 1.0, 0.5), ("Ceiling", 0.6, 0.6, 0.6, 1.0), ("Floor", 0.2, 0.2, 0.2, 1.0), ("Stairs", 0.4, 0.4, 0.4, 1.0), ("Ground", 0.0, 1.0, 0.0, 1.0), ("Water", 0.0, 0.0, 1.0, 0.5), ("Furniture", 1.0, 0.05, 0.05, 1.0), ("Installation", 1.0, 0.5, 0.25, 1.0), ("Infrastructure", 1.0, 0.25, 0.0, 1.0), ("Unknown", 0.5, 0.5, 0.5, 1.0)]
CLASS_SQL = " union all ".join(f"select {i} as k, '{n}' as surface, {r}e0 as r, {g}e0 as g, {b}e0 as b, {a}e0 as a" for i, (n, r, g, b, a) in enumerate(CLASSES))


@query(f"select classification, c.surface, c.r, c.g, c.b, c.a, count(*) as n from points join ({CLASS_SQL}) c on c.k = least(classification, 12) group by all")
def classification_colour(v: View) -> DataFrame:
    p = v("points").groupBy("classification").agg(F.count("*").alias("n"))
    table = p.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CLASSES)], "k int, surface string, r double, g double, b double, a double")
    return p.join(table, F.least("classification", F.lit(12)) == table.k).select("classification", "surface", "r", "g", "b", "a", "n")


@query("select feature_id, minx + 0.5e0 as tx, (minx + maxx) / 2e0 as cx, (miny + maxy) / 2e0 as cy, 0e0 as floor_z, minx - 0.1e0 as ex0, maxx + 0.1e0 as ex1, minx + greatest(maxx - minx, maxy - miny) as cube_x1 from features")
def box_scalars(v: View) -> DataFrame:
    """Translated box, center, floor center, expanded box, cube grown from the lower corner."""
    c = F.col
    return v("features").select("feature_id", (c("minx") + 0.5).alias("tx"), ((c("minx") + c("maxx")) / 2.0).alias("cx"), ((c("miny") + c("maxy")) / 2.0).alias("cy"), F.lit(0.0).alias("floor_z"), (c("minx") - 0.1).alias("ex0"), (c("maxx") + 0.1).alias("ex1"), (c("minx") + F.greatest(c("maxx") - c("minx"), c("maxy") - c("miny"))).alias("cube_x1"))


@query("select feature_id, round((maxx - minx) * (maxy - miny), 12) as area, cast(floor((maxx - minx) * (maxy - miny) * 1e10 * 0.025e0) as bigint) as trees from features")
def polygon_point_count(v: View) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    f = v("features").withColumn("ring", F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy")))
    # shoelace relative to the first corner, which keeps the products small
    rel = F.transform("ring", lambda q: F.struct((q["x"] - F.col("ring")[0]["x"]).alias("x"), (q["y"] - F.col("ring")[0]["y"]).alias("y")))
    f = f.withColumn("q", rel)
    area = F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), F.lit(0.0), lambda s, i: s + F.get("q", i)["x"] * F.get("q", F.pmod(i + 1, F.size("q")))["y"] - F.get("q", F.pmod(i + 1, F.size("q")))["x"] * F.get("q", i)["y"]) / 2.0
    return f.select("feature_id", area.alias("area")).select("feature_id", F.round("area", 12).alias("area"), F.floor(F.col("area") * 1e10 * 0.025).alias("trees"))


@query("select feature_id, round((ax * by_ - ay * bx), 9) as cross_, round(atan2(ax * by_ - ay * bx, ax * bx + ay * by_), 9) as angle from (select feature_id, cast(1 + feature_id % 5 as double) as ax, cast(feature_id % 3 as double) as ay, cast(feature_id % 7 as double) as bx, cast(1 + feature_id % 2 as double) as by_ from features)")
def vector_cross_angle(v: View) -> DataFrame:
    k = lambda n, m: (F.lit(n) + F.col("feature_id") % m).cast("double")
    ax, ay, bx, by = k(1, 5), k(0, 3), k(0, 7), k(1, 2)
    return v("features").select("feature_id", F.round(ax * by - ay * bx, 9).alias("cross_"), F.round(F.atan2(ax * by - ay * bx, ax * bx + ay * by), 9).alias("angle"))


# ---- trees


def sql_point_tree(levels: int, root: int, most: int) -> str:
    """Level by level: the first rows of a node stay, the rest descends."""
    above = "lon > (x0 + x1) / 2e0", "lat > (y0 + y1) / 2e0", "h > (z0 + z1) / 2e0"
    steps = ["l0 as (select *, 'R' as code, 126e0 as x0, 128e0 as x1, 36e0 as y0, 38e0 as y1, 0e0 as z0, 64e0 as z1 from points)"]
    limit, out = root, []
    for k in range(levels + 1):
        if k == levels:
            out.append(f"select {', '.join(POINT_KEY)}, code as node_code from l{k}")
            break
        steps.append(f"r{k} as (select *, row_number() over (partition by code order by {ORDER_SQL}) as rank from l{k})")
        out.append(f"select {', '.join(POINT_KEY)}, code as node_code from r{k} where rank <= {limit}")
        halves = ", ".join(f"case when {t} then ({n}0 + {n}1) / 2e0 else {n}0 end as {n}0, case when {t} then {n}1 else ({n}0 + {n}1) / 2e0 end as {n}1" for t, n in (("a", "x"), ("b", "y"), ("c", "z")))
        steps.append(f"l{k + 1} as (select * exclude (rank, a, b, c, code, x0, x1, y0, y1, z0, z1), code || substr('ACBDEGFH', 1 + case when c then 4 else 0 end + case when a then 2 else 0 end + case when b then 1 else 0 end, 1) as code, {halves} from (select *, {above[0]} as a, {above[1]} as b, {above[2]} as c from r{k} where rank > {limit}))")
        limit = min(most, limit * 2)
    return "with " + ",\n".join(steps) + "\n" + " union all ".join(out)


@query(sql_point_tree(4, 50, 400))
def point_lod_tree(v: View) -> DataFrame:
    points = v("points")
    out = tiling.point_lod_tree(points, "lon", "lat", "h", POINT_ORDER, ROOT, 50, 400, depth=4, cut=checkpointer(points.sparkSession))
    return out.select(*POINT_KEY, "node_code")


COUNTED = """with c as (select *, {n} as w from {src} s), p as (select substr(code, 1, cast(k.n as bigint)) as prefix, sum(w) as w from c, unnest(range(1, {deep})) k(n) where k.n <= length(code) group by 1),
    d as (select {id} as id, max(length(p.prefix)) as deep from c join p on substr(c.code, 1, length(p.prefix)) = p.prefix and p.w > {most} group by 1)
    select c.{id}, substr(c.code, 1, least(length(c.code), coalesce(d.deep, 0) + 1)) as node_code from c left join d on d.id = c.{id}"""


def sql_item_descend(levels: int, source: str, x: str, y: str) -> str:
    return sql_descend(levels, "quad").replace("from points", f"from {source}").replace("lon", x).replace("lat", y)


@query(COUNTED.format(n="triangle_count", src=sql_item_descend(6, "(select *, (minx + maxx) / 2e0 as px, (miny + maxy) / 2e0 as py from features)", "px", "py"), id="feature_id", most=2000, deep=8))
def batched_tile_tree(v: View) -> DataFrame:
    """Nodes of more than 2000 triangles split into quadrants by item center."""
    f = v("features").select("feature_id", "triangle_count", ((F.col("minx") + F.col("maxx")) / 2.0).alias("px"), ((F.col("miny") + F.col("maxy")) / 2.0).alias("py"))
    return tiling.counted_tree(f, "quad", "px", "py", None, ROOT, 2000, 6, "triangle_count").select("feature_id", "node_code")


@query(COUNTED.format(n="1", src=sql_item_descend(6, "instances", "lon", "lat"), id="instance_id", most=64, deep=8))
def instanced_tile_tree(v: View) -> DataFrame:
    return tiling.counted_tree(v("instances"), "quad", "lon", "lat", None, ROOT, 64, 6).select("instance_id", "node_code")


@query("select node_code, count(*) as n from (" + COUNTED.format(n="1", src=sql_item_descend(5, "tilesets_c", "px", "py").replace("126e0", "0e0").replace("128e0", "2e0").replace("36e0", "0e0").replace("38e0", "2e0").replace("tilesets_c", "(select *, (x0 + x1) / 2e0 as px, (y0 + y1) / 2e0 as py from (select tileset_id, x0, y0, x1, y1 from tilesets))").replace("select *, 'R' as code", "select tileset_id, px, py, 'R' as code"), id="tileset_id", most=1, deep=7) + ") group by node_code")
def merge_quadtree(v: View) -> DataFrame:
    """Tilesets by region center, split while a node holds more than one."""
    t = v("tilesets").select("tileset_id", ((F.col("x0") + F.col("x1")) / 2.0).alias("px"), ((F.col("y0") + F.col("y1")) / 2.0).alias("py"))
    tree = tiling.counted_tree(t, "quad", "px", "py", None, (0.0, 0.0, 0.0, 2.0, 2.0, 0.0), 1, 5)
    return tree.groupBy("node_code").agg(F.count("*").alias("n"))


@query(f"select distinct substr(code, 1, cast(k.n as bigint)) as node from {sql_descend(3, 'octant')} s, unnest(range(1, 5)) k(n) where h > 45")
def content_prune(v: View) -> DataFrame:
    """Nodes on a path to some content: a semi-join of all prefixes with the prefixes of content codes."""
    leaves = descended(v, 3, "octant").groupBy("code").agg(F.max("h").alias("high"))
    nodes = leaves.select(F.explode(tiling.prefixes("code")).alias("node")).distinct()
    content = leaves.filter("high > 45").select(F.explode(tiling.prefixes("code")).alias("node")).distinct()
    return nodes.join(content, "node", "left_semi")
