"""Column expressions for elevation profiles, depths, quantisation and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.geodesy import C, col


def transition(ratio: C, kind: str) -> Column:
    """A ramp over [0, 1]: spline, linear or parabolic."""
    r = col(ratio)
    ramps = {"spline": 3 * F.pow(r, 2) - 2 * F.pow(r, 3), "linear": r, "parabolic": 2 * r - F.pow(r, 2)}
    return ramps[kind]


def elevation_ramp(ratio: C, low: C, high: C, kind: str, steepness: float = 3.0) -> Column:
    """An elevation between two ends: plane, spline or tanh."""
    r = col(ratio)
    if kind == "tanh":
        share = (F.tanh(steepness * (2 * r - 1)) / F.tanh(F.lit(steepness)) + 1) / 2
    else:
        share = transition(r, {"plane": "linear"}.get(kind, kind))
    return col(low) + (col(high) - col(low)) * share


def depth_ratio(is_coast: C, mask: C, strength: float = 1.0) -> Column:
    """0 on the coast, else ten times the mask's share of 255, between 0.1 and 1."""
    return F.when(col(is_coast), F.lit(0.0)).otherwise(F.greatest(F.least(10.0 * strength * col(mask) / 255, F.lit(1.0)), F.lit(0.1)))


def altitude_steps(low: C, high: C) -> Column:
    """struct(span, steps): the least span of the set that holds a range, and its steps in a metre (65535 in all)."""
    spread = F.ceil(col(high)) - F.floor(col(low))
    out = F.struct(F.lit(13107).alias("span"), F.lit(5).alias("steps"))
    for span, steps in ((4369, 15), (1285, 51), (771, 85)):
        out = F.when(spread < span - 1, F.struct(F.lit(span).alias("span"), F.lit(steps).alias("steps"))).otherwise(out)
    return out


def quantised_normal(x: C, y: C, strength: float = 1.0) -> tuple[Column, Column]:
    """Components of a normal as unsigned 16-bit numbers; y points the other way."""
    return F.rint((1 + strength * col(x)) / 2 * 65535).cast("int"), F.rint((1 - strength * col(y)) / 2 * 65535).cast("int")


def clamp_byte(x: Column) -> Column:
    return F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(255.0)).cast("int")


def brightness_contrast(v: C, brightness: float, contrast: float) -> Column:
    """A byte moved by ``brightness`` and stretched about the middle by ``contrast`` percent."""
    return clamp_byte((col(v) + brightness - 127.5) * (1 + contrast / 100) + 127.5)


def saturation(r: C, g: C, b: C, percent: float) -> tuple[Column, Column, Column]:
    """Colours moved from their grey by a percentage."""
    grey = 0.299 * col(r) + 0.587 * col(g) + 0.114 * col(b)
    k = 1 + percent / 100
    return tuple(clamp_byte(grey + (col(c) - grey) * k) for c in (r, g, b))


def levels(v: C, low: float, high: float) -> Column:
    """A byte stretched so that [low, high] becomes [0, 255]."""
    return clamp_byte((col(v) - low) * 255.0 / (high - low))


def blend(below: C, above: C, alpha: C) -> Column:
    """A byte over another by an alpha of 0 to 255."""
    return clamp_byte((col(above) * col(alpha) + col(below) * (255 - col(alpha))) / 255.0)


def patch_altitude(tags: C, own: C, ground: C, mean: C) -> Column:
    """A node's elevation in a patch: its own tag, else by its way's tags, else the ground.

    The way's tags in order of precedence: cst_alt_abs (metres), cst_alt_rel (metres above the mean
    ground of the way), var_alt_rel (above the ground at the node), altitude (metres; the mean ground
    if it is no number).
    """
    t, mean_ = col(tags), col(mean)
    number = lambda k: t[k].try_cast("double")
    flat = F.when(F.map_contains_key(t, "altitude"), F.coalesce(number("altitude"), mean_))
    return F.coalesce(col(own).try_cast("double"), number("cst_alt_abs"), mean_ + number("cst_alt_rel"), col(ground) + number("var_alt_rel"), flat, col(ground))


def blended(layers: Column) -> Column:
    """struct(shade, below) of layers (shade, mask, priority), 0 to 255, from the bottom up; ``below`` is the weight of the masks.

    A soft mask leaves out pixels that are nearly black or white. Low layers share with what lies
    below and add no weight; medium ones share and add; high ones and masks add.
    """

    def step(acc: Column, x: Column) -> Column:
        extreme = ((x["shade"] * 3 >= 735) | (x["shade"] * 3 <= 35)) & x["mask"].between(1, 253)
        m = F.when(extreme, 0).otherwise(x["mask"])
        share = F.floor(255 * m / F.nullif(acc["below"] + m, F.lit(0))).cast("int")
        a = F.when(x["priority"].isin("low", "medium"), F.coalesce(share, m)).otherwise(m)
        a = F.least(a, F.lit(255))
        shade = F.rint((x["shade"] * a + acc["shade"] * (255 - a)) / 255).cast("int")
        return F.struct(shade.alias("shade"), F.when(x["priority"] == "low", acc["below"]).otherwise(acc["below"] + m).cast("int").alias("below"))

    return F.aggregate(layers, F.struct(F.lit(0).alias("shade"), F.lit(0).alias("below")), step)
