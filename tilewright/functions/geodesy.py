"""Column expressions for geodesy and web-mercator tiling.

Angles are degrees, lengths metres. Tiles are numbered from the top left corner of the map; pixel
numbers are rounded half to even, as ``rint`` does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = math.pi * EARTH_RADIUS / 180
C = Column | str


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lon_to_m(lat: C) -> Column:
    """Metres in a degree of longitude at a latitude."""
    return METRES_PER_DEGREE * F.cos(F.radians(col(lat)))


def m_to_lon(lat: C) -> Column:
    return 1 / lon_to_m(lat)


def haversine(lon_a: C, lat_a: C, lon_b: C, lat_b: C) -> Column:
    """Great-circle distance."""
    lon_a, lat_a, lon_b, lat_b = map(col, (lon_a, lat_a, lon_b, lat_b))
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    a = half(lat_a - lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a - lon_b)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def pixel_size(lat: C, zoom: C) -> Column:
    """Metres in a web-mercator pixel."""
    return 2 * math.pi * EARTH_RADIUS * F.cos(F.radians(col(lat))) / F.pow(F.lit(2.0), col(zoom) + 8)


def _ratio_y(lat: C) -> Column:
    return F.log(F.tan(F.radians(col(lat) + 90) / 2)) / math.pi


def to_mercator(lon: C, lat: C) -> tuple[Column, Column]:
    """Easting and northing of the spherical web-mercator projection."""
    return F.radians(col(lon)) * EARTH_RADIUS, _ratio_y(lat) * math.pi * EARTH_RADIUS


def lat_of_ratio(y: Column) -> Column:
    return 360 / math.pi * F.atan(F.exp(math.pi * y)) - 90


def tile_corner(x: C, y: C, zoom: C) -> tuple[Column, Column]:
    """(lat, lon) of a tile's top left corner."""
    half = F.pow(F.lit(2.0), col(zoom) - 1)
    return lat_of_ratio(1 - col(y) / half), (col(x) / half - 1) * 180


def pixel(lat: C, lon: C, zoom: C) -> tuple[Column, Column]:
    scale = F.pow(F.lit(2.0), col(zoom) + 7)
    return (
        F.rint((col(lon) / 180 + 1) * scale).cast("bigint"),
        F.rint((1 - _ratio_y(lat)) * scale).cast("bigint"),
    )


def pixel_place(x: C, y: C, zoom: C) -> tuple[Column, Column]:
    """(lat, lon) of a pixel."""
    scale = F.pow(F.lit(2.0), col(zoom) + 7)
    return lat_of_ratio(1 - col(y) / scale), (col(x) / scale - 1) * 180


def tile(lat: C, lon: C, zoom: C) -> tuple[Column, Column]:
    x, y = pixel(lat, lon, zoom)
    return F.floor(x / 256), F.floor(y / 256)


def quadkey(x: C, y: C, zoom: int) -> Column:
    """Base-4 digits of a tile, the most significant first."""
    x, y = col(x), col(y)
    digit = lambda a: F.getbit(x, a) + 2 * F.getbit(y, a)
    if zoom < 1:
        return F.lit("")
    return F.concat(*[digit(F.lit(a)).cast("int").cast("string") for a in range(zoom - 1, -1, -1)])


def texture_cell(lat: C, lon: C, zoom: C) -> tuple[Column, Column]:
    """The texture (16 by 16 tiles) of a place, as the numbers of its first tile."""
    scale = F.pow(F.lit(2.0), col(zoom) - 5)
    cell = lambda ratio: F.floor(ratio * scale) * 16
    return cell(col(lon) / 180 + 1), cell(1 - _ratio_y(lat))


def texture_coordinates(lat: C, lon: C, x: C, y: C, zoom: C) -> tuple[Column, Column]:
    """(s, t) of a place in a texture, clamped to it."""
    scale = F.pow(F.lit(2.0), col(zoom) - 5)
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    s = (col(lon) / 180 + 1) * scale - F.floor(col(x) / 16)
    t = 1 - ((1 - _ratio_y(lat)) * scale - F.floor(col(y) / 16))
    return clamp(s), clamp(t)


def binary_prefix(x: C) -> Column:
    """The first 24 binary digits of a fraction; one and above give all ones."""
    return F.when(col(x) >= 1, "1" * 24).otherwise(F.lpad(F.bin((col(x) * (1 << 24)).cast("bigint")), 24, "0"))


def parent_cell(cell: C, levels: C) -> Column:
    """The texture cell some zoom levels up that holds a texture cell."""
    return F.floor(F.floor(col(cell) / F.pow(F.lit(2.0), col(levels))) / 16) * 16


def grid_place(lat: C, lon: C, zoom: C) -> tuple[Column, Column]:
    """A place in textures of the grid of a zoom, with fractions."""
    scale = F.pow(F.lit(2.0), col(zoom) - 5)
    return (col(lon) / 180 + 1) * scale, (1 - _ratio_y(lat)) * scale


def snapped(value: C, near: float) -> Column:
    """The nearest whole number where that is within ``near``, else the value."""
    whole = F.round(col(value))
    return F.when(F.abs(col(value) - whole) > near, col(value)).otherwise(whole)
