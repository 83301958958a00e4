"""Spatial partitioning: level-of-detail trees as DataFrames of (item, node code).

Trees that split at midpoints are loops over levels with a fixed bound; each level is one narrow projection, plus one
window where a node keeps a share of its items. Windows partition by node: the root of a tree holds all items, so
the first levels use a rank made of bounded parts (see `first_of_each`).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quadrille.functions import geo

#: Parts in which the items of a node are ranked before its first ones are chosen.
SALT = 64


def first_of_each(df: DataFrame, node: list[str], order: list[str], limit: Column, most: int, salt: list[str]) -> DataFrame:
    """df with `_own`: whether a row is among the first `limit` (at most `most`) of its node in the order.

    Rows are ranked within SALT parts of a node first; only the first `most` of a part compete for the node, so
    that no task sorts all items of a large node.
    """
    part = F.pmod(F.xxhash64(*salt), F.lit(SALT))
    local = F.row_number().over(Window.partitionBy(*node, "_part").orderBy(*order))
    ranked = df.withColumn("_part", part).withColumn("_local", local)
    late = ranked.filter(F.col("_local") > most).withColumn("_own", F.lit(False))
    early = ranked.filter(F.col("_local") <= most).withColumn("_own", F.row_number().over(Window.partitionBy(*node).orderBy(*order)) <= limit)
    return early.unionByName(late).drop("_part", "_local")


def placed(df: DataFrame, group: list[str], order: list[str], out: str, cut, size: Column | None = None) -> DataFrame:
    """df with the place (from 1) of each row in its group's order, or with the sum of size over the rows before it.

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over many tasks, each of which sorts its own range;
    what comes before a range is the sum of the ranges before it, a row for each group and range. `cut` writes the sorted rows once,
    as the ranges must not move between the two passes."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    amount = F.lit(1).cast("long") if size is None else size.cast("long")
    ranges = df.withColumn("_size", amount).repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    # within a task: what the sorted rows of the same group and range before this one come to
    schema = StructType([*ranges.schema.fields, StructField("_range", LongType()), StructField("_before", LongType())])

    def run(batches):
        mine, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = [b.column(b.schema.get_field_index(c)).dictionary_encode() for c in group]
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                ids = k.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= ids[1:] != ids[:-1]
            ends = tuple(b.column(b.schema.get_field_index(c))[0].as_py() for c in group), tuple(b.column(b.schema.get_field_index(c))[b.num_rows - 1].as_py() for c in group)
            carried = total if ends[0] == last else 0
            run_sum = np.cumsum(sizes) - sizes
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), 0))
            before = run_sum - run_sum[start] + np.where(start == 0, carried, 0)
            last, total = ends[1], int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, mine, np.int64)), pa.array(before)], names=[*b.schema.names, "_range", "_before"])

    rows = cut(ranges.mapInArrow(run, schema))
    sums = rows.groupBy(*group, "_range").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_part"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]) & (F.col("_range") == F.col("_part"))
    value = F.col("_ahead") + F.col("_before") + (1 if size is None else 0)
    return rows.join(offsets, same).select(*df.columns, value.alias(out))


def halve(axis: str, above: Column) -> list[Column]:
    """New ends of an axis of a node after its midpoint split."""
    low, high = F.col(f"n{axis}0"), F.col(f"n{axis}1")
    mid = (low + high) / 2.0
    return [F.when(above, mid).otherwise(low).alias(f"n{axis}0"), F.when(above, high).otherwise(mid).alias(f"n{axis}1")]


def descend(df: DataFrame, levels: int, kind: str, x: str, y: str, z: str | None = None) -> DataFrame:
    """Append `levels` letters of a midpoint split to `code`; needs nx0, nx1, ny0, ny1 (and nz0, nz1): the node's box.

    kind: "quad" (digits 0..3 SW SE NE NW, a tie goes west and south), "octant" (letters of the point tree, strictly
    above), "ring" (digits 0..7, at or above).
    """
    for _ in range(levels):
        mid = {a: (F.col(f"n{a}0") + F.col(f"n{a}1")) / 2.0 for a in ("x", "y", *("z" * (z is not None)))}
        if kind == "quad":
            letter = geo.quadrant(x, y, mid["x"], mid["y"]).cast("string")
            above = {"x": mid["x"] < F.col(x), "y": mid["y"] < F.col(y)}
        elif kind == "octant":
            letter = geo.octant_letter(x, y, z, mid["x"], mid["y"], mid["z"])
            above = {"x": F.col(x) > mid["x"], "y": F.col(y) > mid["y"], "z": F.col(z) > mid["z"]}
        else:
            letter = geo.ring_octant(x, y, z, mid["x"], mid["y"], mid["z"]).cast("string")
            above = {"x": ~(F.col(x) < mid["x"]), "y": ~(F.col(y) < mid["y"]), "z": ~(F.col(z) < mid["z"])}
        replaced = {c for a in above for c in (f"n{a}0", f"n{a}1")} | {"code"}
        keep = [c for c in df.columns if c not in replaced]
        df = df.select(*keep, F.concat("code", letter).alias("code"), *[c for a in above for c in halve(a, above[a])])
    return df


#: Points of a node up to which one task finishes the whole tree below it.
FINISH = 200_000
_BOX = ("nx0", "nx1", "ny0", "ny1", "nz0", "nz1")


def _limit(level: int, root_limit: int, most: int, growth: float) -> int:
    limit = root_limit
    for _ in range(level):
        limit = min(most, int(limit * growth))
    return limit


def finish_nodes(nodes: DataFrame, x: str, y: str, z: str, order: list[str], limits: list[int], level: int, keep: list[str]) -> DataFrame:
    """keep and node_code of the points of small nodes (code, box), a task for each: sorted once, then halved by arrays down to the last level."""
    schema = StructType([*nodes.select(*keep).schema.fields, StructField("node_code", StringType())])

    def run(key, table):
        rank = pc.sort_indices(table.select(order), sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()
        xyz = np.stack([table.column(c).to_numpy().astype(np.float64) for c in (x, y, z)], axis=1)
        box = np.array([table.column(c)[0].as_py() for c in _BOX]).reshape(3, 2)
        code = np.empty(table.num_rows, object)
        work = [(rank, key[0].as_py(), box, level)]
        while work:
            ids, name, ends, deep = work.pop()
            own = len(ids) if deep == len(limits) else limits[deep]
            code[ids[:own]] = name
            if len(rest := ids[own:]):
                mid = ends.sum(axis=1) / 2
                above = xyz[rest] > mid
                octant = above[:, 2] * 4 + above[:, 0] * 2 + above[:, 1]
                for k in np.unique(octant):
                    up = np.array([k >> 1 & 1, k & 1, k >> 2], bool)
                    half = np.where(up[:, None], np.stack((mid, ends[:, 1]), axis=1), np.stack((ends[:, 0], mid), axis=1))
                    work.append((rest[octant == k], name + geo.OCTANTS[k], half, deep + 1))
        return table.select(keep).append_column("node_code", pa.array(code, pa.string()))

    return nodes.groupBy("code").applyInArrow(run, schema)


def point_lod_tree(points: DataFrame, x: str, y: str, z: str, order: list[str], box: tuple[float, ...], root_limit: int, most: int, depth: int = 19, growth: float = 2.0, cut=None) -> DataFrame:
    """points with node_code: each node keeps its first points, the rest goes to octants; the limit grows by level up to `most`.

    What is left at the last level stays there, so no point is lost. Nodes of over FINISH points split level by level across
    tasks; smaller ones are finished by one task each. `cut` (DataFrame to DataFrame) may write the state out to end its lineage: only the
    points that large nodes hand down, never those that are settled.
    """
    keep = points.columns
    write = cut or (lambda df: df)
    x0, y0, z0, x1, y1, z1 = (float(v) for v in box)
    limits = [_limit(k, root_limit, most, growth) for k in range(depth)]
    # a number for each row, written with it where cut is given
    rest = write(points.select("*", F.lit("R").alias("code"), *[F.lit(v).alias(n) for n, v in zip(_BOX, (x0, x1, y0, y1, z0, z1), strict=True)], F.monotonically_increasing_id().alias("_id")))
    done = []
    for level in range(depth + 1):
        if level == depth:
            done.append(rest.select(*keep, F.col("code").alias("node_code")))
            break
        large = write(rest.groupBy("code").agg(F.count("*").alias("_n")).filter(F.col("_n") > FINISH).select("code"))
        done.append(finish_nodes(rest.join(large, "code", "left_anti"), x, y, z, order, limits, level, keep))
        if cut is not None and large.isEmpty():
            break
        mine = rest.join(large, "code", "left_semi")
        # the first of a node are few: they are found among the first of its parts, and only their numbers travel
        part = F.pmod(F.xxhash64("_id"), F.lit(SALT)).alias("_part")
        local = F.row_number().over(Window.partitionBy("code", "_part").orderBy(*order, "_id"))
        early = mine.select("code", "_id", *order, part).withColumn("_place", local).filter(F.col("_place") <= limits[level])
        whole = F.row_number().over(Window.partitionBy("code").orderBy(*order, "_id"))
        first = write(early.withColumn("_place", whole).filter(F.col("_place") <= limits[level]).select("_id"))
        done.append(mine.join(first, "_id", "left_semi").select(*keep, F.col("code").alias("node_code")))
        rest = write(descend(mine.join(first, "_id", "left_anti"), 1, "octant", x, y, z))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def path_code(depth: int, kind: str, x: str, y: str, z: str | None, box: tuple[float, ...]) -> Column:
    """Code of an item `depth` levels below the root "R", in closed form: the bits of its cell, one digit a level.

    The same splits as `descend`, without its loop. An expression of fixed size for any depth.
    """
    x0, y0, z0, x1, y1, z1 = (float(v) for v in box)

    def cell(c: str, low: float, high: float) -> Column:
        t = (F.col(c) - low) / (high - low) * float(1 << depth)
        k = F.floor(t) if kind == "ring" else F.ceil(t) - 1
        return F.greatest(F.lit(0), F.least(F.lit((1 << depth) - 1), k)).cast("bigint")

    bit = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k)).cast("bigint") % 2
    east, north = cell(x, x0, x1), cell(y, y0, y1)
    high = cell(z, z0, z1) if z else None

    def digit(k):
        a, b = bit(east, k), bit(north, k)
        ring = F.when(b == 1, F.when(a == 1, 2).otherwise(3)).otherwise(F.when(a == 1, 1).otherwise(0))
        if kind == "quad":
            return ring.cast("string")
        if kind == "ring":
            return (ring + bit(high, k) * 4).cast("string")
        return F.substring(F.lit("ACBDEGFH"), (bit(high, k) * 4 + a * 2 + b + 1).cast("int"), F.lit(1))

    if depth == 0:
        return F.lit("R")
    return F.concat(F.lit("R"), F.array_join(F.transform(F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1)), digit), ""))


def counted_tree(items: DataFrame, kind: str, x: str, y: str, z: str | None, box: tuple[float, ...], most: int, depth: int, weight: str | None = None) -> DataFrame:
    """items with node_code: a node whose count (or sum of weight) exceeds `most` splits at its midpoints, down to `depth`.

    All levels' codes are bit arithmetic on the item, so every prefix is counted in one aggregation (items are combined
    by full code first), and an item stops at its first prefix that is small enough.
    """
    full = items.withColumn("_full", path_code(depth, kind, x, y, z, box))
    sums = full.groupBy("_full").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    heavy = sums.select(F.explode(prefixes("_full")).alias("_prefix"), "_n").groupBy("_prefix").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > most).select("_prefix")
    deepest = sums.select("_full", F.explode(prefixes("_full")).alias("_prefix")).join(heavy, "_prefix", "left_semi").groupBy("_full").agg(F.max(F.length("_prefix")).alias("_deep"))
    out = full.join(deepest, "_full", "left")
    return out.select(*items.columns, F.substr("_full", F.lit(1), F.least(F.length("_full"), F.coalesce("_deep", F.lit(0)) + 1)).alias("node_code"))


def prefixes(code: str) -> Column:
    """All codes from the root to a node, the node included."""
    return F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substr(F.col(code), F.lit(1), n))


def grid_overlap_join(boxes: DataFrame, box: list[str], step: float, cells: DataFrame | None = None) -> DataFrame:
    """Each box with every cell (cx, cy) of a regular grid that it touches: candidate cells by sequence, no nested loop."""
    index = lambda c: F.floor(F.col(c) / step).cast("long")
    out = boxes.withColumn("cx", F.explode(F.sequence(index(box[0]), index(box[2])))).withColumn("cy", F.explode(F.sequence(index(box[1]), index(box[3]))))
    return out if cells is None else out.join(cells, ["cx", "cy"])


def box_join(left: DataFrame, right: DataFrame, lbox: list[str], rbox: list[str], step: float) -> DataFrame:
    """Pairs of overlapping 2D boxes by a grid equi-join; a pair that shares several cells is taken in the first one only."""
    a = grid_overlap_join(left, lbox, step)
    b = grid_overlap_join(right, rbox, step)
    c = [F.col(n) for n in (*lbox, *rbox)]
    touch = (c[0] <= c[6]) & (c[4] <= c[2]) & (c[1] <= c[7]) & (c[5] <= c[3])
    first = (F.col("cx") == F.floor(F.greatest(c[0], c[4]) / step)) & (F.col("cy") == F.floor(F.greatest(c[1], c[5]) / step))
    return a.join(b, ["cx", "cy"]).filter(touch & first).drop("cx", "cy")


def neighbourhoods(raster: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, ix, iy and v0..v3: a cell and its neighbours to the east, north and north-east (numbers only, else null), made on the raster's side once."""
    cells = raster.filter(F.col("v").isNotNull() & ~F.isnan("v")).select(*keys, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("v").cast("double").alias("v"))
    spots = F.array(*[F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(dx + 2 * dy).alias("k"), "v") for dx in (0, 1) for dy in (0, 1)])
    spread = cells.select(*keys, F.explode(spots).alias("s")).select(*keys, "s.*")
    return spread.groupBy(*keys, "ix", "iy").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])


def bilinear(points: DataFrame, raster: DataFrame, fx: Column, fy: Column, out: str = "sample", keys: tuple[str, ...] = ()) -> DataFrame:
    """points with the bilinear value of a raster (ix, iy, v) at grid coordinates; missing corners and NaN count as 0.

    One equi-join on the cell; points are neither multiplied nor grouped. keys: columns of both that tell rasters apart."""
    x, y = F.col("_fx") - F.floor("_fx"), F.col("_fy") - F.floor("_fy")
    v = [F.coalesce(F.col(f"v{k}"), F.lit(0.0)) for k in range(4)]
    value = v[0] * (1.0 - x) * (1.0 - y) + v[1] * x * (1.0 - y) + v[2] * (1.0 - x) * y + v[3] * x * y
    base = points.withColumn("_fx", fx).withColumn("_fy", fy).withColumns({"ix": F.floor("_fx").cast("long"), "iy": F.floor("_fy").cast("long")})
    return base.join(neighbourhoods(raster, keys), [*keys, "ix", "iy"], "left").select(*points.columns, value.alias(out))


def coverage_heights(points: DataFrame, lon: str, lat: str, rasters: DataFrame, last: bool = False, out: str = "ground") -> DataFrame:
    """points with the height of all coverages (path, ix, iy, v, west, north, step_x, step_y) at them: the sum, or the last one by path that is not 0.

    Points meet the coverages that hold them by a join with the table of coverages, a row per file; 0 where there is none."""
    covers = rasters.groupBy("path").agg(*[F.first(c).alias(f"_{c}") for c in ("west", "north", "step_x", "step_y")], F.max("ix").alias("_nx"), F.max("iy").alias("_ny"))
    inside = F.col(lon).between(F.col("_west"), F.col("_west") + F.col("_step_x") * (F.col("_nx") + 1)) & F.col(lat).between(F.col("_north") - F.col("_step_y") * (F.col("_ny") + 1), F.col("_north"))
    met = points.withColumn("_id", F.monotonically_increasing_id()).join(covers, inside, "left")
    sampled = bilinear(met, rasters.select("path", "ix", "iy", "v"), (F.col(lon) - F.col("_west")) / F.col("_step_x"), (F.col("_north") - F.col(lat)) / F.col("_step_y"), "_v", ("path",))
    value = F.max_by(F.when(F.col("_v") != 0, F.col("_v")), F.when(F.col("_v") != 0, F.col("path"))) if last else F.sum("_v")
    kept = [F.first(c).alias(c) for c in points.columns]
    return sampled.groupBy("_id").agg(*kept, F.coalesce(value, F.lit(0.0)).alias(out)).drop("_id")
