"""Geographic and box arithmetic as column expressions: all inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
SEMI_MAJOR = 6378137.0
E2 = 6.69437999014e-3
SEMI_MINOR = 6356752.3142


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def cut_fast(v) -> Column:
    """v floored to eight decimals."""
    return F.floor(_c(v) * F.lit(1e8)).cast("double") / F.lit(1e8)


def tile_x(lon, level: int) -> Column:
    n = 1 << level
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((_c(lon) + 180.0) / 360.0 * float(n)).cast("int")))


def tile_y(lat, level: int) -> Column:
    """Row of the geographic grid, 0 in the north."""
    n = 1 << level
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.lit(90.0) - _c(lat)) / 180.0 * float(n)).cast("int")))


def tile_bounds(x, y, level: int) -> list[Column]:
    """west, south, east, north of a tile."""
    n = float(1 << level)
    dx, dy = 360.0 / n, 180.0 / n
    return [_c(x) * dx - 180.0, F.lit(90.0) - (_c(y) + 1) * dy, (_c(x) + 1) * dx - 180.0, F.lit(90.0) - _c(y) * dy]


def bucket_id(x, y) -> Column:
    """16 bits of x below 16 bits of y."""
    return _c(x).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(_c(y).bitwiseAND(F.lit(0xFFFF)), 16))


def ecef(lon, lat, h) -> list[Column]:
    """Earth-centred x, y, z of geographic degrees and metres."""
    lam, phi = F.radians(_c(lon)), F.radians(_c(lat))
    n = F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return [(n + _c(h)) * F.cos(phi) * F.cos(lam), (n + _c(h)) * F.cos(phi) * F.sin(lam), (n * (1.0 - E2) + _c(h)) * F.sin(phi)]


def geographic(x, y, z) -> list[Column]:
    """lon, lat (degrees) and height of earth-centred coordinates, by the closed form of the ellipsoid's cubic outside its evolute."""
    x, y, z = _c(x), _c(y), _c(z)
    a2, e4 = SEMI_MAJOR * SEMI_MAJOR, E2 * E2
    xy = x * x + y * y
    p, q = xy / a2, z * z * ((1.0 - E2) / a2)
    r = (p + q - e4) / 6.0
    s = F.lit(e4) * p * q / (r * r * r * 4.0)
    t = F.cbrt(F.lit(1.0) + s + F.sqrt(s * (s + 2.0)))
    u = r * (F.lit(1.0) + t + F.lit(1.0) / t)
    v = F.sqrt(u * u + q * e4)
    w = (u + v - q) * E2 / (v * 2.0)
    k = F.sqrt(u + v + w * w) - w
    d = k * F.sqrt(xy) / (k + E2)
    far = F.sqrt(d * d + z * z)
    return [F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, d)), (k + (E2 - 1.0)) / k * far]


def enu(x, y, z) -> list[Column]:
    """East, north and up unit vectors (nine numbers) at an earth-centred point."""
    x, y, z = _c(x), _c(y), _c(z)
    ux, uy, uz = x / (SEMI_MAJOR * SEMI_MAJOR), y / (SEMI_MAJOR * SEMI_MAJOR), z / (SEMI_MINOR * SEMI_MINOR)
    un = F.sqrt(ux * ux + uy * uy + uz * uz)
    ux, uy, uz = ux / un, uy / un, uz / un
    en = F.sqrt(x * x + y * y)
    ex, ey = -y / en, x / en
    return [ex, ey, F.lit(0.0), -uz * ey, uz * ex, ux * ey - uy * ex, ux, uy, uz]


def mercator_to_degrees(x, y) -> list[Column]:
    """EPSG:3857 to degrees."""
    return [F.degrees(_c(x) / SEMI_MAJOR), F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / SEMI_MAJOR)) - F.lit(math.pi / 2))]


def degrees_to_mercator(lon, lat) -> list[Column]:
    return [F.radians(_c(lon)) * SEMI_MAJOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2.0)) * SEMI_MAJOR]


def tmerc_to_degrees(x, y, lon0: float, lat0: float = 0.0, k0: float = 1.0, fe: float = 0.0, fn: float = 0.0) -> list[Column]:
    """Inverse transverse Mercator by the series of Snyder (1987, pp. 60-64): a local frame, or UTM with its constants."""
    e2 = E2
    ep2 = e2 / (1 - e2)

    def arc(phi: float) -> float:
        return SEMI_MAJOR * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))

    m = F.lit(arc(math.radians(lat0))) + (_c(y) - fn) / k0
    mu = m / (SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    f = mu + F.sin(mu * 2) * (3 * e1 / 2 - 27 * e1**3 / 32) + F.sin(mu * 4) * (21 * e1**2 / 16 - 55 * e1**4 / 32) + F.sin(mu * 6) * (151 * e1**3 / 96) + F.sin(mu * 8) * (1097 * e1**4 / 512)
    c, t = F.cos(f) * F.cos(f) * ep2, F.tan(f) * F.tan(f)
    w = F.lit(1.0) - F.sin(f) * F.sin(f) * e2
    n, r = F.lit(SEMI_MAJOR) / F.sqrt(w), F.lit(SEMI_MAJOR * (1 - e2)) / F.pow(w, F.lit(1.5))
    d = (_c(x) - fe) / (n * k0)
    lat = f - n * F.tan(f) / r * (d * d / 2 - (t * 3 + 5 + c * 10 - c * c * 4 - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24 + (t * 90 + 61 + c * 298 + t * t * 45 - 252 * ep2 - c * c * 3) * F.pow(d, F.lit(6.0)) / 720)
    lon = (d - (t * 2 + 1 + c) * F.pow(d, F.lit(3.0)) / 6 + (F.lit(5.0) - c * 2 + t * 28 - c * c * 3 + 8 * ep2 + t * t * 24) * F.pow(d, F.lit(5.0)) / 120) / F.cos(f)
    return [F.degrees(lon) + lon0, F.degrees(lat)]


def to_degrees(x, y, z, epsg: int) -> list[Column]:
    """lon, lat, height from one of the supported systems; others raise."""
    if epsg == 4326:
        return [_c(x), _c(y), _c(z)]
    if epsg == 3857:
        return [*mercator_to_degrees(x, y), _c(z)]
    if epsg == 4978:
        return geographic(x, y, z)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        zone, south = epsg % 100, epsg >= 32700
        return [*tmerc_to_degrees(x, y, zone * 6 - 183, 0.0, 0.9996, 500000.0, 1e7 if south else 0.0), _c(z)]
    # Korean belts on GRS80 (central meridian), which differs from WGS84 by a tenth of a millimetre.
    belts = {5185: (125.0, 6e5), 5186: (127.0, 6e5), 5187: (129.0, 6e5), 5188: (131.0, 6e5)}
    if epsg in belts:
        lon0, fn = belts[epsg]
        return [*tmerc_to_degrees(x, y, lon0, 38.0, 1.0, 2e5, fn), _c(z)]
    if epsg == 5179:
        return [*tmerc_to_degrees(x, y, 127.5, 38.0, 0.9996, 1e6, 2e6), _c(z)]
    raise ValueError(f"coordinate system EPSG:{epsg} is not supported")


def vertical_radius(lat_rad) -> Column:
    """Radius of the prime vertical at a latitude in radians."""
    sin = F.sin(_c(lat_rad))
    return F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - F.lit(E2) * sin * sin)


def metres_between(lon1, lat1, lon2, lat2) -> list[Column]:
    """East-west metres at the middle latitude and north-south metres with the mean radius of both latitudes."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    mid = (a + b) / 2.0
    return [vertical_radius(mid) * F.cos(mid) * (F.radians(_c(lon2)) - F.radians(_c(lon1))), (vertical_radius(a) + vertical_radius(b)) / 2.0 * (b - a)]


def metres_to_degrees(metres, lat) -> list[Column]:
    """Degrees of longitude and latitude that so many metres make at a latitude."""
    phi = F.radians(_c(lat))
    return [F.degrees(_c(metres) / (vertical_radius(phi) * F.cos(phi))), F.degrees(_c(metres) / vertical_radius(phi))]


def degree_diagonal(minx, miny, minz, maxx, maxy, maxz) -> Column:
    """Diagonal in metres of a box in degrees."""
    dx, dy = metres_between(minx, miny, maxx, maxy)
    dz = _c(maxz) - _c(minz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def diagonal(minx, miny, minz, maxx, maxy, maxz) -> Column:
    dx, dy, dz = _c(maxx) - _c(minx), _c(maxy) - _c(miny), _c(maxz) - _c(minz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def region(minx, miny, minz, maxx, maxy, maxz) -> list[Column]:
    """Region bounding volume: radians, floored."""
    return [cut_fast(F.radians(_c(c))) for c in (minx, miny, maxx, maxy)] + [cut_fast(minz), cut_fast(maxz)]


def linear_from_srgb(c) -> Column:
    """Byte of the linear intensity of an sRGB byte."""
    v = _c(c) / 255.0
    lin = F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(lin * 255.0 + 0.5).cast("int")))


def quadrant(x, y, midx, midy) -> Column:
    """0 SW, 1 SE, 2 NE, 3 NW; a tie goes west and south."""
    east, north = _c(midx) < _c(x), _c(midy) < _c(y)
    return F.when(north, F.when(east, 2).otherwise(3)).otherwise(F.when(east, 1).otherwise(0))


# Letters of the point octree by z * 4 + x * 2 + y.
OCTANTS = "ACBDEGFH"


def octant_letter(x, y, z, midx, midy, midz) -> Column:
    """Letter of the point octree: bits z=4, x=2, y=1 where above the middle."""
    k = F.when(_c(z) > _c(midz), 4).otherwise(0) + F.when(_c(x) > _c(midx), 2).otherwise(0) + F.when(_c(y) > _c(midy), 1).otherwise(0)
    return F.substring(F.lit(OCTANTS), k + 1, F.lit(1))


def ring_octant(x, y, z, midx, midy, midz) -> Column:
    """0..3 SW SE NE NW of the lower half, 4..7 of the upper; below the middle goes low."""
    east, north = ~(_c(x) < _c(midx)), ~(_c(y) < _c(midy))
    ring = F.when(north, F.when(east, 2).otherwise(3)).otherwise(F.when(east, 1).otherwise(0))
    return ring + F.when(_c(z) < _c(midz), 0).otherwise(4)


def child_error(diag, limit, base) -> Column:
    """Geometric error of a point node's children, snapped in bands."""
    e = _c(diag) / 2.0 * F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.lit(1000.0) / _c(limit)))
    return F.when(e < 0.01, 0.01).when(e < 0.1, 0.1).when((e > 0.5) & (_c(base) < 1.0), 1.0).otherwise(e)


def power_of_two(v, how: str = "nearest") -> Column:
    """nearest (tie goes down), higher, or lower (of an exact power the half)."""
    exact = F.log2(_c(v))
    up = F.pow(F.lit(2.0), F.ceil(exact))
    low = F.pow(F.lit(2.0), F.ceil(exact) - 1)
    if how == "higher":
        return up.cast("int")
    if how == "lower":
        return low.cast("int")
    floor = F.pow(F.lit(2.0), F.floor(exact))
    return F.when(_c(v) - floor <= up - _c(v), floor).otherwise(up).cast("int")


def legend(value: Column, stops: list[tuple[float, float]]) -> Column:
    """A channel of a legend of (value, channel) stops: a mix of the nearest stops strictly below and above, or the only one of them.

    A value that equals a stop is mixed from that stop's neighbours; one at an end takes its one neighbour."""
    table = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(float(c)).alias("c")) for v, c in sorted(stops)])
    below, above = F.filter(table, lambda s: s["v"] < value), F.filter(table, lambda s: s["v"] > value)
    low, high = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    ratio = (value - low["v"]) / (high["v"] - low["v"])
    return F.when(F.size(below) == 0, high["c"]).when(F.size(above) == 0, low["c"]).otherwise(low["c"] + (high["c"] - low["c"]) * ratio)
