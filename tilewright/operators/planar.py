"""Exact arrangements of segments on a lattice, and polygons from them.

Ends of segments are whole numbers of lattice steps, of magnitude below 2^19. What lies on a line is
merged first: a line's key is its slope and offset, quotients of whole numbers that are exact as keys,
and running sums over its ends, in order, give the stretches that have segments, how many, and their
flags. So overlaps cost what their ends cost, however many there are. Then stretches of different lines
are cut where they meet, by whole numbers; a meeting point is written as quotient and remainder, so the
same point comes out alike from any two segments through it. Up to 2^13 steps different points stay
apart as well.

Polygons are closed rings, inside by the even-odd rule each. A ray from the middle of each piece counts
the edges of each ring below it, and those it lies on; that tells whether the areas on either side are
in a set of rings. Boundaries of unions, differences and the like are the pieces whose sides differ,
directed with the inside on the left; their areas and rings follow.

Rows with a null in a coordinate or a group, and segments without length, are left out; rows that repeat
are segments of their own. Columns of the group keep their names, which must not be among those named
here; other columns are ignored. Empty tables give empty ones. ``size`` is the width of the cells and
strips in which segments meet, in steps; without it all segments of a group meet, which is best where a
group has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.shapes import segment_cells
from tilewright.operators.components import components
from tilewright.session import written

_ENDS = ("x", "y", "x2", "y2")
UPRIGHT = float("inf")


def on_lattice(df: DataFrame, steps: int) -> DataFrame:
    """``df`` with its segments' ends as whole numbers of steps, of which there are so many to a unit."""
    return df.withColumns({c: F.rint(F.col(c) * steps).cast("bigint") for c in _ENDS})


def ring_edges(rings: DataFrame, ring: str, *keep: str) -> DataFrame:
    """x, y, x2, y2 and the columns in ``keep`` for each edge of closed rings."""
    from tilewright.functions.shapes import segments

    out = rings.select(*keep, F.explode(segments(ring)).alias("_s"))
    return out.select(*keep, F.col("_s.a.x").alias("x"), F.col("_s.a.y").alias("y"), F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2"))


def _forward(df: DataFrame) -> DataFrame:
    """Segments from their smaller end, with slope and offset of their lines."""
    a, b = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    rest = [c for c in df.columns if c not in _ENDS]
    out = df.select(*rest, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).where("_a <> _b AND _a.x + _a.y + _b.x + _b.y IS NOT NULL")
    out = out.select(*rest, "_a.x", "_a.y", F.col("_b.x").alias("x2"), F.col("_b.y").alias("y2"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    up = dx == 0
    return out.withColumn("slope", F.when(up, F.lit(UPRIGHT)).otherwise(dy / dx)).withColumn(
        "offset", F.when(up, F.col("x").cast("double")).otherwise((F.col("y") * dx - F.col("x") * dy) / dx)
    )


def stretches(segments: DataFrame, *group: str, flags: str | None = None, bits: int = 8) -> DataFrame:
    """group, slope, offset, x, y, x2, y2, n, flags: the stretches of lines that have segments, and the flags of all of them.

    ``segments`` has the group, ends in steps and, if it is named, a column of so many bits. Stretches of
    a line don't overlap. A line has as many rows as it has different ends.
    """
    flag = F.coalesce(F.col(flags).cast("bigint"), F.lit(0)) if flags else F.lit(0).cast("bigint")
    known = segments.where(" AND ".join(f"{g} IS NOT NULL" for g in group)).select(*group, *_ENDS, flag.alias("flags"))
    each = [f"_{b}" for b in range(bits if flags else 0)]
    end = lambda x, y, sign: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(sign).alias("sign"))
    ends = _forward(known).select(*group, "slope", "offset", "flags", F.explode(F.array(end("x", "y", 1), end("x2", "y2", -1))).alias("_e"))
    bit = lambda b: F.sum(F.col("_e.sign") * F.shiftright("flags", b).bitwiseAND(1)).alias(f"_{b}")
    ends = ends.groupBy(*group, "slope", "offset", F.col("_e.x").alias("x"), F.col("_e.y").alias("y")).agg(
        F.sum("_e.sign").alias("n"), *(bit(b) for b in range(len(each)))
    )
    line = Window.partitionBy(*group, "slope", "offset").orderBy("x", "y")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ends.select(
        *group, "slope", "offset", "x", "y", F.lead("x").over(line).alias("x2"), F.lead("y").over(line).alias("y2"),
        F.sum("n").over(so_far).alias("n"), *(F.sum(c).over(so_far).alias(c) for c in each),
    ).where("n > 0")
    joined = sum((F.when(F.col(c) > 0, 1 << b).otherwise(0) for b, c in enumerate(each)), F.lit(0).cast("bigint"))
    return out.select(*group, "slope", "offset", *_ENDS, "n", joined.alias("flags"))


def pieces(found: DataFrame, *group: str, size: int | None = None) -> DataFrame:
    """The stretches cut where they meet: group, slope, offset, x, y, x2, y2 (doubles), n, flags.

    A pair of stretches that meets in several cells gives the same cut each time, and counts once.
    """
    found = written(found, "stretches")  # it is read three times
    own = found.withColumn("_c", F.explode(segment_cells(*_ENDS, size)) if size else F.lit(None))
    cells = [F.col(f"_c.{c}").alias(c) for c in ("cx", "cy")] if size else []
    own = own.select(*group, *_ENDS, *cells)
    p, q, c = own.alias("p"), own.alias("q"), F.col
    same = [c(f"p.{g}") == c(f"q.{g}") for g in (*group, *(("cx", "cy") if size else ()))]
    ends = lambda t: F.struct(*(c(f"{t}.{e}") for e in _ENDS))
    on = ends("p") < ends("q")
    for s in same:
        on = s & on
    met = p.join(q, on)
    u, v = ((c(f"{t}.x2") - c(f"{t}.x"), c(f"{t}.y2") - c(f"{t}.y")) for t in "pq")
    w = (c("q.x") - c("p.x"), c("q.y") - c("p.y"))
    cross = lambda a, b: a[0] * b[1] - a[1] * b[0]
    met = met.withColumns({"_det": cross(u, v), "_s": cross(w, v), "_t": cross(w, u)}).where("_det <> 0")
    sign = F.signum("_det").cast("bigint")
    met = met.withColumns({"_s": c("_s") * sign, "_t": c("_t") * sign, "_d": F.nullif(F.abs("_det"), F.lit(0).cast("bigint"))}).where("_s BETWEEN 0 AND _d AND _t BETWEEN 0 AND _d")

    def place(axis: int) -> Column:
        """A coordinate as quotient and remainder: the same for the same point."""
        whole = c(f"p.{'xy'[axis]}") * c("_d") + c("_s") * u[axis]
        rest = F.pmod(whole, c("_d"))
        return F.call_function("div", whole - rest, c("_d")) + rest / c("_d")

    met = met.withColumns({"_x": place(0), "_y": place(1)})
    cut = lambda t, k: F.struct(*(c(f"{t}.{e}").alias(e) for e in _ENDS), ((c(k) > 0) & (c(k) < c("_d"))).alias("inside"))
    cuts = met.select(*(c(f"p.{g}").alias(g) for g in group), F.explode(F.array(cut("p", "_s"), cut("q", "_t"))).alias("k"), "_x", "_y")
    cuts = cuts.where("k.inside").groupBy(*group, *(c(f"k.{e}").alias(e) for e in _ENDS)).agg(F.sort_array(F.collect_set(F.struct("_x", "_y"))).alias("_cuts"))
    known = found.join(cuts, [*group, *_ENDS], "left")
    stop = lambda x, y: F.array(F.struct(c(x).cast("double").alias("_x"), c(y).cast("double").alias("_y")))
    none = F.array().cast("array<struct<_x:double,_y:double>>")
    # points of a stretch are in the order of x, and of y where it stands upright
    stops = F.concat(stop("x", "y"), F.coalesce("_cuts", none), stop("x2", "y2"))
    pairs = F.zip_with(F.slice("_stops", F.lit(1), F.size("_stops") - 1), F.slice("_stops", F.lit(2), F.size("_stops")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = known.withColumn("_stops", stops).select(*group, "slope", "offset", "n", "flags", F.explode(pairs).alias("k"))
    return out.select(*group, "slope", "offset", c("k.a._x").alias("x"), c("k.a._y").alias("y"), c("k.b._x").alias("x2"), c("k.b._y").alias("y2"), "n", "flags")


def sides(found: DataFrame, edges: DataFrame, in_b: str, ring: str, *group: str, size: int | None = None) -> DataFrame:
    """Pieces with ``left`` and ``right``: structs (a, b), whether the sides are in a ring of A and in one of B.

    ``edges`` are those of closed rings (group, ring, in_b, ends in steps), of which ``found`` are the pieces.
    Right and left are seen from a piece's first end to its second.
    """
    c = F.col
    mid = found.withColumns({"_mx": (c("x") + c("x2")) / 2, "_my": (c("y") + c("y2")) / 2, "_up": c("slope") == UPRIGHT})
    strip = F.floor(F.when(c("_up"), c("_my")).otherwise(c("_mx")) / (size or 1)) if size else F.lit(0).cast("bigint")
    mid = mid.withColumn("_strip", strip)
    own = _forward(edges.select(*group, c(ring).alias("_ring"), c(in_b).alias("_in_b"), *_ENDS))
    across = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)) if size else F.array(F.lit(0).cast("bigint")))
    keep = [*group, "_ring", "_in_b", *(c(e).alias(f"_{e}") for e in _ENDS), c("slope").alias("_slope"), c("offset").alias("_offset")]
    flat = own.where(c("x") < c("x2")).select(*keep, F.lit(False).alias("_up"), across(c("x"), c("x2")).alias("_strip"))
    tall = own.where(c("y") != c("y2")).select(*keep, F.lit(True).alias("_up"), across(c("y"), c("y2")).alias("_strip"))
    met = mid.join(flat.unionByName(tall), [*group, "_up", "_strip"])
    low, high = F.least("_y", "_y2"), F.greatest("_y", "_y2")
    spans = F.when(c("_up"), (low <= c("_my")) & (c("_my") < high)).otherwise((c("_x") <= c("_mx")) & (c("_mx") < c("_x2")))
    lies_on = (c("slope") == c("_slope")) & (c("offset") == c("_offset"))
    turn = (c("_x2") - c("_x")) * (c("_my") - c("_y")) - (c("_y2") - c("_y")) * (c("_mx") - c("_x"))
    # below a flat piece, left of an upright one
    under = F.when(c("_up"), F.when(c("_y2") > c("_y"), turn < 0).otherwise(turn > 0)).otherwise(turn > 0)
    key = [*group, "slope", "offset", *_ENDS]
    met = met.where(spans & (lies_on | under))
    each = met.groupBy(*key, "_ring", "_in_b").agg(F.count(F.when(lies_on, 1)).alias("on"), F.count(F.when(~lies_on, 1)).alias("under"))
    odd = lambda n: n % 2 == 1
    inside = lambda b, n: F.coalesce(F.bool_or(odd(n) & (c("_in_b") == b)), F.lit(False))
    low_side = F.struct(inside(False, c("under")).alias("a"), inside(True, c("under")).alias("b"))
    high_side = F.struct(inside(False, c("under") + c("on")).alias("a"), inside(True, c("under") + c("on")).alias("b"))
    out = each.groupBy(*key).agg(low_side.alias("_low"), high_side.alias("_high"))
    up = c("slope") == UPRIGHT
    return out.select(*key, F.when(up, c("_low")).otherwise(c("_high")).alias("left"), F.when(up, c("_high")).otherwise(c("_low")).alias("right"))


UNION = lambda s: s["a"] | s["b"]
COMMON = lambda s: s["a"] & s["b"]
LESS = lambda s: s["a"] & ~s["b"]
EITHER = lambda s: s["a"] != s["b"]


def area_of(inside) -> Column:
    """An aggregate over pieces with sides: the area of what ``inside`` says of a side, in squares of steps."""
    gain = inside(F.col("left")).cast("int") - inside(F.col("right")).cast("int")
    return F.sum(gain * (F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2


def boundary(sided: DataFrame, inside, *group: str) -> DataFrame:
    """group, slope, x, y, x2, y2: the pieces between inside and outside, with the inside on the left."""
    left, right = inside(F.col("left")), inside(F.col("right"))
    turned = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b)).alias(a)
    return sided.where(left != right).select(*group, "slope", turned("x", "x2"), turned("y", "y2"), turned("x2", "x"), turned("y2", "y"))


def traced(edges: DataFrame, *group: str) -> DataFrame:
    """A boundary's pieces with ``ring``, the number of the closed ring that a piece is part of.

    Where several rings meet in a point, what follows a piece is the piece on the other side of the same
    sector of the inside; so parts that touch in a point only are rings of their own.
    """
    c = F.col
    known = written(edges.withColumn("_id", F.monotonically_increasing_id()), "boundary")
    ahead = (c("x2") > c("x")) | ((c("x2") == c("x")) & (c("y2") > c("y")))
    # directions in their order around a point: the right half from below to above, then the left half
    at = lambda x, y, half, out: F.struct(c(x).alias("x"), c(y).alias("y"), half.cast("int").alias("half"), F.lit(out).alias("out"))
    ends = known.select(*group, "_id", "slope", F.explode(F.array(at("x", "y", ~ahead, True), at("x2", "y2", ahead, False))).alias("e"))
    around = Window.partitionBy(*group, "e.x", "e.y").orderBy("e.half", "slope")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_id").over(around), F.last("_id").over(whole))
    nexts = ends.withColumn("b", before).where("NOT e.out").select(c("_id").alias("a"), "b")
    roots = components(nexts).withColumnsRenamed({"node": "_id", "root": "ring"})
    return known.join(roots, "_id").drop("_id")
