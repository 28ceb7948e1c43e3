"""Column expressions for names, keys and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.geodesy import C, col


def signed_name(lat: C, lon: C) -> Column:
    """+47-123: the south-west corner of a tile."""
    return F.format_string("%+03d%+04d", F.floor(col(lat)).cast("int"), F.floor(col(lon)).cast("int"))


def block_name(lat: C, lon: C) -> Column:
    """The name of the ten-degree block; floors below zero too."""
    return signed_name(F.floor(col(lat) / 10) * 10, F.floor(col(lon) / 10) * 10)


def hemisphere_name(lat: C, lon: C) -> Column:
    """N47W123."""
    a, b = F.floor(col(lat)).cast("int"), F.floor(col(lon)).cast("int")
    return F.concat(
        F.when(a >= 0, "N").otherwise("S"), F.format_string("%02d", F.abs(a)),
        F.when(b >= 0, "E").otherwise("W"), F.format_string("%03d", F.abs(b)),
    )


def parse_hemisphere(name: C) -> tuple[Column, Column]:
    """(lat, lon) of a name such as N47W123, null if it is none."""
    pattern = r"([NS])(\d{2})([EW])(\d{3})"
    part = lambda i: F.regexp_extract(col(name), pattern, i)
    number = lambda sign, digits, minus: F.when(part(sign) == minus, -1).otherwise(1) * part(digits).try_cast("int")
    return number(1, 2, "S"), number(3, 4, "W")


def tile_path(root: str, lat: C, lon: C, *more: str) -> Column:
    return F.concat_ws("/", F.lit(root), block_name(lat, lon), signed_name(lat, lon), *map(F.lit, more))


def texture_name(x: C, y: C, zoom: C, provider: C) -> Column:
    return F.format_string("%d_%d_%s%d", col(y), col(x), col(provider), col(zoom))


def parse_texture_name(name: C) -> Column:
    """struct(y, x, provider, zoom); the zoom is the two digits before the extension."""
    parts = F.split(col(name), "_")
    rest = F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "_")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("y"), F.get(parts, F.lit(1)).try_cast("int").alias("x"),
        F.regexp_extract(rest, r"^(.*)\d\d\.\w+$", 1).alias("provider"),
        F.regexp_extract(rest, r"(\d\d)\.\w+$", 1).try_cast("int").alias("zoom"),
    )


def url(template: C, zoom: C, x: C, y: C, key: C, switch: C | None = None) -> Column:
    """Fills {zoom}, {x}, {y}, {-y}, {quadkey} and {switch:a,b,c}; the switch is picked by a hash of the tile."""
    out, z = col(template), col(zoom)
    down = (F.pow(F.lit(2.0), z) - 1 - col(y)).cast("bigint")
    for mark, value in (("{zoom}", z), ("{x}", col(x)), ("{y}", col(y)), ("{-y}", down), ("{quadkey}", col(key))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    choices = F.split(F.regexp_extract(out, r"\{switch:([^}]*)\}", 1), ",")
    pick = col(switch) if switch is not None else col(x) + col(y)
    chosen = F.element_at(choices, (F.pmod(pick, F.size(choices)) + 1).cast("int"))
    return F.regexp_replace(out, F.lit(r"\{switch:[^}]*\}"), chosen)


def readable_size(n: C, units: str = "KMGT") -> Column:
    """Bytes in units of 1024; what is over the last of the units is given in it."""
    n = col(n).cast("double")
    shown = [F.format_string(f"%.1f{unit}", n / 1024**power) for power, unit in enumerate(["", *units])]
    out = shown.pop()
    for power in reversed(range(len(shown))):
        out = F.when(n < 1024 ** (power + 1), shown[power]).otherwise(out)
    return out


def readable_time(seconds: C) -> Column:
    s = F.floor(col(seconds))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def colour_code(code: C) -> Column:
    """L20C10S-30 style codes: a letter and a signed number for light, contrast and saturation."""
    part = lambda letter: F.coalesce(F.regexp_extract(col(code), letter + r"(-?\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(part("L").alias("light"), part("C").alias("contrast"), part("S").alias("saturation"))


def airport_key(icao: C, iata: C, local: C, name: C, lon: C, lat: C) -> Column:
    """struct(key, key_type): the first known of icao (4 letters), iata (3), local code, name, else the place."""
    kinds = [
        ("icao", F.substring(col(icao), 1, 4)), ("iata", F.substring(col(iata), 1, 3)), ("local_ref", col(local)), ("name", col(name)),
    ]
    key, kind = F.concat_ws(",", col(lon).cast("string"), col(lat).cast("string")), F.lit("place")
    for label, value in reversed(kinds):
        known = value.isNotNull() & (value != "")
        key, kind = F.when(known, value).otherwise(key), F.when(known, label).otherwise(kind)
    return F.struct(key.alias("key"), kind.alias("key_type"))


def short_text(text: C, size: int = 60) -> Column:
    """Entities decoded, and cut to ``size`` with three dots."""
    out = col(text)
    for entity, sign in (("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.when(F.char_length(out) > size, F.concat(F.substring(out, 1, size - 3), F.lit("..."))).otherwise(out)


def first_sufficient(values: Column, limit: Column) -> Column:
    """The place (from 0) of the first of an array's values that is at most a limit; 0 if there is none."""
    at = F.array_position(F.transform(values, lambda v: v <= limit), F.lit(True))
    return F.greatest(at - 1, F.lit(0))


def archive_zone(lat: C, lon: C) -> Column:
    """The archive of elevations that a tile is in: a letter for each four degrees (S before southern ones), a number for each six."""
    a, b = col(lat), col(lon)
    letter = F.char((65 + F.when(a >= 0, F.floor(a / 4)).otherwise(F.floor((-1 - a) / 4))).cast("bigint"))
    return F.concat(F.when(a < 0, "S").otherwise(""), letter, F.lpad((31 + F.floor(b / 6)).cast("string"), 2, "0"))
