"""Spatial views over the driver's tables. The same text serves Spark and DuckDB, but for one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "points": (
        "lineitem",
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        cast(1260000 + ((l_orderkey*7919 + l_linenumber*104729) % 20000) as double)/cast(10000 as double) as lon,
        cast(360000 + ((l_partkey*6151 + l_linenumber*3571) % 20000) as double)/cast(10000 as double) as lat,
        l_quantity as h,
        cast((l_orderkey*31 + l_partkey) % 65536 as int) as r16, cast((l_orderkey*17 + l_suppkey) % 65536 as int) as g16, cast((l_partkey*13 + l_suppkey) % 65536 as int) as b16,
        cast((l_orderkey*7 + l_partkey) % 65536 as int) as intensity, cast((l_partkey + l_suppkey) % 19 as int) as classification,
        (l_orderkey*1103515245 + l_linenumber*12345 + l_partkey*7 + l_suppkey) % 2147483648 as rnd_key
        from {src}""",
    ),
    "features": (
        "part",
        """select p_partkey as feature_id, p_brand as category, p_type as kind,
        case when p_partkey % 10 = 0 then null else cast(p_size as double) end as height,
        cast(p_partkey % 7 as double) as altitude,
        cast(1270000 + (p_partkey*613) % 9000 as double)/cast(10000 as double) as minx, cast(370000 + (p_partkey*419) % 9000 as double)/cast(10000 as double) as miny,
        cast(1270000 + (p_partkey*613) % 9000 + 1 + p_size as double)/cast(10000 as double) as maxx, cast(370000 + (p_partkey*419) % 9000 + 1 + p_size % 13 as double)/cast(10000 as double) as maxy,
        12 + 4*(p_partkey % 50) as triangle_count
        from {src}""",
    ),
    "instances": (
        "events",
        """select event_id as instance_id, event_type as model_href, user_id as group_id,
        cast(1265000 + (event_id*7919) % 10000 as double)/cast(10000 as double) as lon, cast(365000 + (event_id*104729) % 10000 as double)/cast(10000 as double) as lat,
        cast(event_id % 360 as double) as heading, case when event_id % 3 = 0 then 'absolute' else 'clampToGround' end as altitude_mode,
        cast(event_id % 100 as double) as alt from {src}""",
    ),
    "terrain": (
        "customer",
        "select c_custkey as cell_id, (c_custkey-1) % 30 as ix, (c_custkey-1) // 30 as iy, cast((c_custkey*37) % 500 as double)/cast(2 as double) as v from {src}",
    ),
    "tilesets": (
        "supplier",
        """select s_suppkey as tileset_id, cast(s_suppkey*3 % 100 as double)/cast(100 as double) as x0, cast(s_suppkey*7 % 100 as double)/cast(100 as double) as y0,
        cast(s_suppkey*3 % 100 + 1 as double)/cast(100 as double) as x1, cast(s_suppkey*7 % 100 + 1 as double)/cast(100 as double) as y1, cast(0 as double) as z0, cast(s_suppkey % 50 as double) as z1, cast(16 + s_suppkey % 64 as double) as geometric_error from {src}""",
    ),
    "edges": (
        "part",
        """select p_partkey as face_id, k as corner, (p_partkey + k) % 97 as v0, (p_partkey + (k+1) % 3) % 97 as v1
        from {src} cross join (select 0 as k union all select 1 union all select 2) t""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    src = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "edges":  # three corners a face: an explode instead of a join
        rows = src.selectExpr("p_partkey as face_id", "explode(array(0, 1, 2)) as corner")
        return rows.selectExpr("face_id", "corner", "(face_id + corner) % 97 as v0", "(face_id + (corner + 1) % 3) % 97 as v1")
    return spark.sql(sql.replace("//", "div"), src=src)


def with_views(body: str) -> str:
    """DuckDB SQL with the views that the body names in front of it."""
    import re

    used = [f"{n} as ({sql.replace('{src}', table)})" for n, (table, sql) in VIEWS.items() if re.search(rf"\b{n}\b", body)]
    body = body.strip()
    if not used:
        return body
    start = "with recursive" if body.lower().startswith("with recursive") else "with"
    return f"{start} " + ",\n".join(used) + ("," + body[len(start) :] if body.lower().startswith("with") else "\n" + body)
