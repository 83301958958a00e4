"""Predicates and box relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators import tiling

BOX = ("minx", "miny", "minz", "maxx", "maxy", "maxz")


def parse_attribute_filter(text: str) -> list[tuple[str, str]]:
    """Pairs of "k=v1,v2;k2=v3"; parts that are not of that form are dropped."""
    pairs = []
    for part in text.split(";"):
        key, sep, values = part.partition("=")
        if sep and key.strip() and "=" not in values:
            pairs += [(key.strip(), v.strip()) for v in values.split(",") if v.strip()]
    return pairs


def attribute_filter(df: DataFrame, text: str, every_key: bool = False) -> DataFrame:
    """Rows that equal any (key, value) pair, null read as "null"; every_key asks for a match in each key."""
    names = {c.lower() for c in df.columns}
    tests: dict[str, list[Column]] = {}
    for key, value in parse_attribute_filter(text):
        known = F.coalesce(F.col(key).cast("string"), F.lit("null")) if key.lower() in names else F.lit("null")
        tests.setdefault(key, []).append(known == value)
    if not tests:
        return df
    by_key = [reduce(lambda a, b: a | b, t) for t in tests.values()]
    return df.filter(reduce((lambda a, b: a & b) if every_key else (lambda a, b: a | b), by_key))


def contains_point(x, y, z, box: tuple = BOX) -> Column:
    """Inclusive on all faces."""
    return F.col(x).between(F.col(box[0]), F.col(box[3])) & F.col(y).between(F.col(box[1]), F.col(box[4])) & F.col(z).between(F.col(box[2]), F.col(box[5]))


def overlaps(a: list[Column], b: list[Column], tolerance: float = 0.0) -> Column:
    """Whether two boxes (min then max, any dimension) touch, give or take the tolerance."""
    n = len(a) // 2
    return reduce(lambda p, q: p & q, [(a[k] <= b[k + n] + tolerance) & (b[k] <= a[k + n] + tolerance) for k in range(n)])


def intersection(a: list[Column], b: list[Column]) -> list[Column]:
    """The common box, null in all parts if it is empty or flat along an axis."""
    n = len(a) // 2
    low = [F.greatest(a[k], b[k]) for k in range(n)]
    high = [F.least(a[k + n], b[k + n]) for k in range(n)]
    solid = reduce(lambda p, q: p & q, [lo < hi for lo, hi in zip(low, high, strict=True)])
    return [F.when(solid, c) for c in low + high]


def contains_box(outer: list[Column], inner: list[Column]) -> Column:
    n = len(outer) // 2
    return reduce(lambda p, q: p & q, [(outer[k] <= inner[k]) & (inner[k + n] <= outer[k + n]) for k in range(n)])


def crosses_plane(box: list[Column], normal: tuple[float, float, float], d: float) -> Column:
    """Whether a box has corners on both sides of the plane n.p + d = 0 (or on it)."""
    low = reduce(lambda a, b: a + b, [F.least(box[k] * n, box[k + 3] * n) for k, n in enumerate(normal)])
    high = reduce(lambda a, b: a + b, [F.greatest(box[k] * n, box[k + 3] * n) for k, n in enumerate(normal)])
    return (low + d <= 0) & (high + d >= 0)


def stride_sample(df: DataFrame, file: list[str], order: list[str], percent: float, cut) -> DataFrame:
    """Every ceil(100 / percent)-th row of each file in its order; percent is held between 1 and 100. A file may be of any size (see tiling.placed)."""
    step = -int(-100 // max(1.0, min(100.0, percent)))
    return tiling.placed(df, file, order, "_place", cut).filter((F.col("_place") - 1) % step == 0).drop("_place")


def polygon_rings(ring: Column) -> Column:
    """A ring (x, y) without a repeated end, equal neighbours and points on a straight line (sine under 1e-6), closed again."""

    def tidy(points: Column) -> Column:
        n = F.size(points)
        at = lambda i: F.get(points, F.pmod(i, n))

        def keep(p, i):
            a, b = at(i - 1), at(i + 1)
            ux, uy, vx, vy = p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]
            size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
            return (size > 0) & (F.abs(ux * vy - uy * vx) >= size * 1e-6)

        return F.filter(points, keep)

    n = F.size(ring)
    opened = F.when((n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(ring)
    kept = tidy(opened)
    return F.when(F.size(kept) > 0, F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept)
