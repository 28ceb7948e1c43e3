"""Triangle meshes as a DataFrame: a row for each triangle with corners (x1, y1), (x2, y2), (x3, y3) and a kind.

Kinds are 0 land, 1 inland water, 2 sea; vertices are told apart by their coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import shapes
from tilewright.functions.geodesy import texture_cell
from tilewright.operators import rings
from tilewright.operators.spatial import with_cells
from tilewright.operators.ways import numbered
from tilewright.session import cut_lineage

SIDES = ((1, 2), (2, 3), (3, 1))


def corner(i: int) -> Column:
    return F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))


def area() -> Column:
    c = F.col
    return F.abs((c("x2") - c("x1")) * (c("y3") - c("y1")) - (c("x3") - c("x1")) * (c("y2") - c("y1"))) / 2


def barycentre() -> tuple[Column, Column]:
    c = F.col
    return (c("x1") + c("x2") + c("x3")) / 3, (c("y1") + c("y2") + c("y3")) / 3


def contains(x: Column, y: Column) -> Column:
    """Whether a point lies in the triangle, bounds included: no two sides see it on opposite hands."""
    side = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (y - F.col(f"y{i}")) - (x - F.col(f"x{i}")) * (F.col(f"y{j}") - F.col(f"y{i}"))
    hands = [side(i, j) for i, j in SIDES]
    return ~(F.greatest(*hands) > 0) | ~(F.least(*hands) < 0)


def vertex_kinds(mesh: DataFrame, kind: str = "kind") -> DataFrame:
    """x, y, kinds: the bits 1 << kind of all triangles at a vertex; coast if land and water meet."""
    each = mesh.select(F.explode(F.array(corner(1), corner(2), corner(3))).alias("p"), F.expr(f"shiftleft(1, {kind})").alias("b"))
    out = each.groupBy("p").agg(F.bit_or("b").alias("kinds"))
    return out.select("p.x", "p.y", "kinds", ((F.col("kinds").bitwiseAND(1) != 0) & (F.col("kinds").bitwiseAND(6) != 0)).alias("coast"))


def side_kinds(mesh: DataFrame, kind: str = "kind") -> DataFrame:
    """a, b (ends in order), kinds and triangles of every side."""
    sides = F.array(*[F.struct(F.least(corner(i), corner(j)).alias("a"), F.greatest(corner(i), corner(j)).alias("b")) for i, j in SIDES])
    each = mesh.select(F.explode(sides).alias("s"), F.expr(f"shiftleft(1, {kind})").alias("k")).where("s.a <> s.b")
    return each.groupBy("s.a", "s.b").agg(F.bit_or("k").alias("kinds"), F.count("*").alias("triangles"))


def recut(mesh: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """Water triangles cut at sides that join two coast vertices without being land's; others as they are.

    A cut side gets its midpoint. One cut side makes two triangles, two make three, three make four;
    a triangle of coast vertices only, without a side to cut, is cut in three at its barycentre.
    Columns: the key, kind, part, the corners, and ``cuts``.
    """
    coast = vertex_kinds(mesh, kind).where("coast").select(F.struct("x", "y").alias("p"))
    free = side_kinds(mesh, kind).where(F.col("kinds").bitwiseAND(1) == 0)
    for end in ("a", "b"):
        free = free.join(coast.withColumnRenamed("p", end), end, "left_semi")
    sides = mesh.where(F.col(kind) > 0).select(*key, F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.least(corner(i), corner(j)).alias("a"), F.greatest(corner(i), corner(j)).alias("b")) for n, (i, j) in enumerate(SIDES)
    ])).alias("s"))
    hit = sides.select(*key, "s.n", F.col("s.a").alias("a"), F.col("s.b").alias("b")).join(free.select("a", "b"), ["a", "b"], "left_semi")
    mask = hit.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1, n)")).alias("_cut"))
    corners = mesh.where(F.col(kind) > 0).select(*key, F.explode(F.array(*[F.struct(corner(i).alias("p")) for i in (1, 2, 3)])).alias("q"))
    shore = corners.select(*key, F.col("q.p").alias("p")).join(coast, "p", "left_semi").groupBy(*key).agg(F.count("*").alias("_coast"))
    known = mesh.join(mask, key, "left").join(shore, key, "left")
    known = known.withColumn("_cut", F.coalesce("_cut", F.lit(0))).withColumn("_coast", F.coalesce("_coast", F.lit(0)))
    p = [corner(1), corner(2), corner(3)]
    mid = [F.struct(*[((F.col(f"{c}{i}") + F.col(f"{c}{j}")) / 2).alias(c) for c in ("x", "y")]) for i, j in SIDES]
    centre = F.struct(*[v.alias(c) for v, c in zip(barycentre(), ("x", "y"))])
    tri = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    parts = F.when(
        F.col("_cut") == 0,
        F.when(F.col("_coast") == 3, F.array(*[tri(p[i], p[(i + 1) % 3], centre) for i in range(3)])).otherwise(F.array(tri(*p))),
    ).when(F.col("_cut") == 7, F.array(tri(p[0], mid[0], mid[2]), tri(mid[0], p[1], mid[1]), tri(mid[2], mid[1], p[2]), tri(*mid)))
    for n in range(3):
        a, b, c, m = p[n], p[(n + 1) % 3], p[(n + 2) % 3], mid[n]
        parts = parts.when(F.col("_cut") == 1 << n, F.array(tri(a, m, c), tri(m, b, c)))
        # two cut sides: n and the next one, which meet at corner b
        after = mid[(n + 1) % 3]
        parts = parts.when(F.col("_cut") == (1 << n | 1 << (n + 1) % 3), F.array(tri(m, b, after), tri(a, m, after), tri(a, after, c)))
    out = known.select(*key, kind, F.bit_count("_cut").alias("cuts"), F.posexplode(parts).alias("part", "t"))
    return out.select(*key, kind, "part", "cuts", *[F.col(f"t.{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("abc", 1) for c in ("x", "y")])


def mask_cells(mesh: DataFrame, lat: Column, lon: Column, zoom: int) -> DataFrame:
    """Triangles dealt to the mask cell (til_x, til_y) of a place in them, and to neighbours within a quarter cell."""
    x, y = texture_cell(lat, lon, zoom)
    fx, fy = texture_cell(lat, lon, zoom + 2)
    quarter = lambda v: F.pmod(F.floor(v / 16), F.lit(4))
    side = lambda q: F.when(q == 0, -16).when(q == 3, 16).otherwise(0)
    out = mesh.withColumns({"_x": x, "_y": y, "_sx": side(quarter(fx)), "_sy": side(quarter(fy))})
    cells = F.array_distinct(F.array(*[
        F.struct((F.col("_x") + dx).alias("til_x"), (F.col("_y") + dy).alias("til_y")) for dx in (F.lit(0), F.col("_sx")) for dy in (F.lit(0), F.col("_sy"))
    ]))
    return out.withColumn("_cell", F.explode(cells)).select(*mesh.columns, "_cell.til_x", "_cell.til_y")


def smooth_levels(nodes: DataFrame, corners: DataFrame, triangle: list[str], passes: int) -> DataFrame:
    """nodes (x, y, z) with the elevations of the corners' nodes smoothed: in each pass a node takes the mean of its triangles' means.

    ``corners`` has the triangle's key, x and y. All triangles of a pass see the same elevations, so
    their order doesn't matter. Lineage is cut after each pass.
    """
    for _ in range(passes):
        mean = corners.join(nodes, ["x", "y"]).groupBy(*triangle).agg(F.avg("z").alias("_m"))
        new = corners.join(mean, triangle).groupBy("x", "y").agg(F.avg("_m").alias("_z"))
        nodes = cut_lineage(nodes.join(new, ["x", "y"], "left").select("x", "y", F.coalesce("_z", "z").alias("z")))
    return nodes


def numbered_by_appearance(rows: DataFrame, keys: list[str], order: str, group: str, name: str) -> DataFrame:
    """group, keys and a number from 1 for each distinct key of a group, by its first place in the order."""
    first = rows.groupBy(group, *keys).agg(F.min(order).alias("_first"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("_first")).cast("bigint")
    return first.select(group, *keys, number.alias(name))


def cut_along_grid(mesh: DataFrame, size: float) -> DataFrame:
    """The triangles' parts in each grid cell they touch: the mesh's columns, cx, cy and ``ring`` (closed, empty if nothing is left).

    The ring is cut in units of cells, so that a cell's sides are whole numbers.
    """
    xs, ys = [F.col(f"x{i}") for i in (1, 2, 3)], [F.col(f"y{i}") for i in (1, 2, 3)]
    dealt = with_cells(mesh, F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys), size).withColumnsRenamed({"_cx": "cx", "_cy": "cy"})
    ring = F.array(*[shapes.point(xs[i] - F.col("cx") * size, ys[i] - F.col("cy") * size) for i in (0, 1, 2, 0)])
    return dealt.withColumn("ring", rings.clipped(ring, 0.0, 0.0, size, size))


def locality_key(x: Column, y: Column, bits: int = 16) -> Column:
    """A number in which places near each other are mostly near: the bits of x and y, both in [0, 1), take turns (16 each at most)."""

    def spread(v: Column) -> Column:
        out = F.least(F.greatest(F.floor(v * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")
        for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            out = out.bitwiseOR(F.shiftleft(out, step)).bitwiseAND(F.lit(mask).cast("bigint"))
        return out

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def by_locality(mesh: DataFrame, key: list[str], name: str = "place") -> DataFrame:
    """The mesh with a new number of each triangle, from 1: triangles near each other get numbers near each other.

    They go by the ``locality_key`` of their barycentre, then by ``key``, which tells them apart. A
    triangle with a null corner comes first.
    """
    x, y = barycentre()
    keyed = mesh.withColumn("_key", locality_key(x, y))
    return numbered(keyed, [F.col("_key"), *map(F.col, key)], name).select(*mesh.columns, name)
