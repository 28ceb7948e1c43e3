"""Text formats: key=value catalogs and settings, node and edge lists, meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """path, line (from 0), value: the lines of text files with their numbers, read in splits.

    A split's lines are numbered where they are read; what comes before a split is a sum over a small
    table of splits. With ``together`` the files of a folder count as one, in the order of their names.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), "value")
    blocks = rows.groupBy("path", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    # one row for each split, so few even for large folders
    before = Window.partitionBy(*([] if together else ["path"])).orderBy("path", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    return rows.join(blocks.select("path", "_b", "_at"), ["path", "_b"]).select("path", (F.col("_at") + F.col("_m")).alias("line"), "value")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, name (of the file), entries: the key=value lines of each file; comments and blank lines are left out, the last line of a key counts."""
    lines = numbered_lines(spark, path).select("path", "line", F.trim("value").alias("v")).where("v LIKE '%=%' AND v NOT LIKE '#%'")
    pairs = lines.select("path", "line", F.trim(F.regexp_extract("v", r"^([^=]+)=", 1)).alias("k"), F.trim(F.regexp_extract("v", r"^[^=]+=(.*)$", 1)).alias("v"))
    last = pairs.groupBy("path", "k").agg(F.max_by("v", "line").alias("v"))
    entries = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("entries"))
    return entries.select("path", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("name"), "entries")


def sectioned(spark: SparkSession, path: str) -> DataFrame:
    """name (of the section), entries: key=value lines below headers such as ``[name]``, of many sections to a file; otherwise like ``catalog``.

    A section is in one file, whole; its lines are together in it.
    """
    lines = numbered_lines(spark, path).withColumn("v", F.trim("value"))
    head = F.regexp_extract("v", r"^\[(.*)\]$", 1)
    # lines of a file are in ranges by their number; a range begins with the last header before it
    block = F.floor(F.col("line") / 65_536)
    lines = lines.select("path", "line", "v", block.alias("_b"), F.when(F.col("v").rlike(r"^\[.*\]$"), head).alias("_head"))
    ends = lines.where("_head IS NOT NULL").groupBy("path", "_b").agg(F.max_by("_head", "line").alias("_last"))
    blocks = lines.select("path", "_b").distinct().join(ends, ["path", "_b"], "left")
    before = Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    blocks = blocks.select("path", "_b", F.last("_last", True).over(before).alias("_last"))
    so_far = Window.partitionBy("path", "_b").orderBy("line")
    named = lines.join(blocks, ["path", "_b"]).select("line", "v", "_head", F.coalesce(F.last("_head", True).over(so_far), "_last").alias("name")).where("name IS NOT NULL")
    pair = F.when(F.col("_head").isNull() & F.expr("v LIKE '%=%' AND v NOT LIKE '#%'"), F.regexp_extract("v", r"^([^=]+)=", 1))
    pairs = named.select("name", "line", F.trim(pair).alias("k"), F.trim(F.regexp_extract("v", r"^[^=]+=(.*)$", 1)).alias("v"))
    last = pairs.groupBy("name", "k").agg(F.max_by("v", "line").alias("v"))
    entries = F.filter(F.collect_list(F.struct("k", "v")), lambda e: e["k"].isNotNull())
    return last.groupBy("name").agg(F.map_from_entries(entries).alias("entries"))


def filter_lists(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file), filters: array of (name, args) from lines such as ``brightness-contrast 5 10``, in their order."""
    lines = numbered_lines(spark, path).where("trim(value) <> '' AND trim(value) NOT LIKE '#%'")
    parts = F.split(F.trim("value"), r"\s+")
    step = F.struct(F.col("line"), F.get(parts, F.lit(0)).alias("name"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda a: a.cast("double")).alias("args"))
    listed = lines.groupBy("path").agg(F.sort_array(F.collect_list(step)).alias("f"))
    return listed.select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("name"), F.transform("f", lambda f: F.struct(f["name"].alias("name"), f["args"].alias("args"))).alias("filters"))


def typed(settings: DataFrame, schema: dict[str, tuple[str, object]], common: DataFrame | None = None) -> DataFrame:
    """Settings as typed columns: a value of its own, else the common one, else the default. Nothing is evaluated.

    ``common`` has one row at most; an empty one leaves the defaults.
    """
    base = settings
    if common is not None:
        if common.limit(2).count() > 1:
            raise ValueError("common settings are one row")
        base = settings.join(common.select(F.col("entries").alias("_common")), F.lit(True), "left")
    out = []
    for key, (kind, default) in schema.items():
        own = F.col("entries")[key]
        value = F.coalesce(own, F.col("_common")[key]) if common is not None else own
        value = F.regexp_replace(value, "^['\"]|['\"]$", "")
        out.append(F.coalesce(value.try_cast(kind), F.lit(default).cast(kind)).alias(key))
    return base.select("name", *out)


def ordered_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of white-space separated columns with the line's number in its file (``line``)."""
    parts = F.split(F.trim("value"), r"\s+")
    named = numbered_lines(spark, path).where("trim(value) <> '' AND trim(value) NOT LIKE '#%'").orderBy("path", "line")
    return named.select("path", F.col("line").cast("int").alias("line"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def write_nodes(nodes: DataFrame, path: str) -> None:
    """``id x y z`` lines in the order of id, nine decimals."""
    text = nodes.repartitionByRange("id").sortWithinPartitions("id").select(F.format_string("%d %.9f %.9f %.9f", "id", "x", "y", "z").alias("value"))
    text.write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """``id a b flags`` lines in the order of id."""
    text = edges.repartitionByRange("id").sortWithinPartitions("id").select(F.format_string("%d %d %d %d", "id", "a", "b", "flags").alias("value"))
    text.write.text(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).cast("bigint").alias("id"), *[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])


def read_mesh(spark: SparkSession, path: str, together: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (path, idx, lon, lat, z, nx, ny) and triangles (path, idx, n1, n2, n3, kind) of mesh files, read by lines.

    A file has a header of four lines, then the vertices, normals and triangles, each after its
    count. Elevations are stored as hundred-thousandths; numbers of vertices start at 1. With
    ``together`` the files of a folder are the parts of one mesh, as ``write_mesh`` leaves them.
    """
    lines = numbered_lines(spark, path, together).withColumn("path", F.lit(path) if together else F.col("path"))
    count = lambda name: F.trim("value").try_cast("bigint").alias(name)
    sized = lines.where("line = 4").select("path", count("n"))
    sized = sized.join(lines.select("path", F.col("line").alias("_l"), count("m")), "path").where("_l = n * 2 + 10").select("path", "n", "m")
    every = lines.join(sized, "path")  # a row for each mesh
    num = lambda i: F.get(F.split(F.trim("value"), r"\s+"), F.lit(i))

    def part(first: Column, size: str, kinds: dict[str, str]) -> DataFrame:
        own = every.where((F.col("line") >= first) & (F.col("line") < first + F.col(size)))
        return own.select("path", (F.col("line") - first).cast("int").alias("idx"), *[num(i).cast(k).alias(c) for i, (c, k) in enumerate(kinds.items())])

    at = part(F.lit(5), "n", dict.fromkeys(("lon", "lat", "z"), "double"))
    normal = part(F.col("n") + 8, "n", dict.fromkeys(("nx", "ny"), "double"))
    tri = part(F.col("n") * 2 + 11, "m", dict.fromkeys(("n1", "n2", "n3", "kind"), "int"))
    vertices = at.join(normal, ["path", "idx"]).withColumn("z", F.col("z") * 100_000)
    return vertices, tri.select("path", "idx", *[(F.col(c) - 1).alias(c) for c in ("n1", "n2", "n3")], "kind")


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str, version: str = "1.3") -> None:
    """A mesh of any size as the lines of a mesh file, in parts whose names follow the order of lines."""
    n, m = vertices.count(), triangles.count()
    spark = vertices.sparkSession
    head = {0: f"MeshVersionFormatted {version}", 1: "Dimension 3", 2: "", 3: "Vertices", 4: str(n), n + 5: "", n + 6: "Normals", n + 7: "", 2 * n + 8: "", 2 * n + 9: "Triangles", 2 * n + 10: str(m)}
    lines = spark.createDataFrame(list(head.items()), "line bigint, value string")
    at = lambda df, first, text: df.select((F.col("idx") + F.lit(first)).cast("bigint").alias("line"), text.alias("value"))
    lines = lines.unionByName(at(vertices, 5, F.format_string("%.9f %.9f %.9f 0", "lon", "lat", F.col("z") / 100_000)))
    lines = lines.unionByName(at(vertices, n + 8, F.format_string("%.6f %.6f 0", "nx", "ny")))
    corner = lambda c: F.col(c) + 1
    lines = lines.unionByName(at(triangles, 2 * n + 11, F.format_string("%d %d %d %d", corner("n1"), corner("n2"), corner("n3"), "kind")))
    lines.repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(path)


def mesh_text(vertices: DataFrame, triangles: DataFrame, version: str = "1.3") -> DataFrame:
    """One row with the text of a small mesh, as ``read_mesh`` reads it."""
    place = F.format_string("%.9f %.9f %.9f 0", "lon", "lat", F.col("z") / 100_000)
    listed = lambda df, text: df.agg(F.sort_array(F.collect_list(F.struct("idx", text.alias("t")))).alias("a")).select(F.transform("a", lambda r: r["t"]).alias("a"))
    p = listed(vertices, place).withColumnRenamed("a", "p")
    q = listed(vertices, F.format_string("%.6f %.6f 0", "nx", "ny")).withColumnRenamed("a", "q")
    t = listed(triangles, F.format_string("%d %d %d %d", F.col("n1") + 1, F.col("n2") + 1, F.col("n3") + 1, "kind")).withColumnRenamed("a", "t")
    head = F.array(F.lit(f"MeshVersionFormatted {version}"), F.lit("Dimension 3"), F.lit(""), F.lit("Vertices"))
    size = lambda c: F.array(F.size(c).cast("string"))
    body = F.concat(head, size("p"), "p", F.array(F.lit(""), F.lit("Normals"), F.lit("")), "q", F.array(F.lit(""), F.lit("Triangles")), size("t"), "t")
    return p.crossJoin(q).crossJoin(t).select(F.array_join(body, "\n").alias("value"))  # single rows


def write_elements(elements: DataFrame, path: str) -> None:
    """``id a b c kind`` lines in the order of id."""
    text = elements.repartitionByRange("id").sortWithinPartitions("id").select(F.format_string("%d %d %d %d %d", "id", "a", "b", "c", "kind").alias("value"))
    text.write.text(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """id, a, b, c, kind of triangles; comments are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'")
    kind = lambda c: "int" if c == "kind" else "bigint"
    return rows.select(*[F.get(parts, F.lit(i)).cast(kind(c)).alias(c) for i, c in enumerate(("id", "a", "b", "c", "kind"))])


def read_objects(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """name, lon, lat, alt (may be null), heading, vertices (x, y, z), triangles (lists of three indices) of object texts.

    The first line ends in ``ANCHOR lon lat [alt] heading``; ``VT`` lines have vertices, ``IDX`` and
    ``IDX10`` lines have indices, and ``TRIS offset count`` names a stretch of them. A file is one
    object, or several with a separator between them.
    """
    whole = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path, wholetext=True)
    lines = F.split("value", "\r?\n")
    anchor = F.split(F.trim(F.regexp_extract(F.get(lines, F.lit(0)), "ANCHOR(.*)$", 1)), r"\s+")
    n = F.size(anchor)
    words = lambda line: F.split(F.trim(line), r"\s+")
    numbers = lambda kind, at, to: F.transform(F.filter(lines, lambda s: s.rlike(rf"^{kind}\s")), lambda s: F.transform(F.slice(words(s), at, to), lambda v: v.cast("double")))
    index = F.flatten(F.transform(F.filter(lines, lambda s: s.startswith("IDX")), lambda s: F.transform(F.slice(words(s), 2, 20), lambda v: v.cast("int"))))
    out = whole.where("trim(value) <> ''").select(
        F.get(lines, F.lit(0)).alias("name"), F.get(anchor, F.lit(0)).cast("double").alias("lon"), F.get(anchor, F.lit(1)).cast("double").alias("lat"),
        F.when(n > 3, F.get(anchor, F.lit(2)).cast("double")).alias("alt"), F.get(anchor, n - 1).cast("double").alias("heading"),
        F.transform(numbers("VT", 2, 3), lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"), F.get(v, F.lit(2)).alias("z"))).alias("vertices"),
        index.alias("_index"), numbers("TRIS", 2, 2).alias("_parts"),
    )
    part = lambda p: F.slice("_index", F.get(p, F.lit(0)).cast("int") + 1, F.get(p, F.lit(1)).cast("int"))
    flat = F.flatten(F.transform("_parts", part))
    size = (F.size(flat) / 3).cast("int")
    three = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.slice(flat, k * 3 + 1, 3))).otherwise(F.array().cast("array<array<int>>"))
    return out.select("name", "lon", "lat", "alt", "heading", "vertices", three.alias("triangles"))


def placed_vertices(ground: Column | None = None) -> Column:
    """The vertices of ``read_objects`` as (lon, lat, z): turned by the heading around the anchor; ``ground`` counts where it has no altitude."""
    from tilewright.functions.geodesy import METRES_PER_DEGREE

    turn = F.radians("heading")
    base = F.col("alt") if ground is None else F.coalesce("alt", ground)

    def place(v: Column) -> Column:
        east, south = v["x"] * F.cos(turn) - v["z"] * F.sin(turn), v["x"] * F.sin(turn) + v["z"] * F.cos(turn)
        return F.struct(
            (F.col("lon") + east / METRES_PER_DEGREE / F.cos(F.radians("lat"))).alias("lon"), (F.col("lat") - south / METRES_PER_DEGREE).alias("lat"), (base + v["y"]).alias("z")
        )

    return F.transform("vertices", place)


def overlay_polygon(ring: str, kind: Column, parameter: Column) -> Column:
    """A polygon as the text of an overlay: one winding of points."""
    listed = F.transform(ring, lambda p: F.format_string("POLYGON_POINT %.7f %.7f", p["x"], p["y"]))
    return F.concat(F.format_string("BEGIN_POLYGON %d %d 2\nBEGIN_WINDING\n", kind, parameter), F.array_join(listed, "\n"), F.lit("\nEND_WINDING\nEND_POLYGON"))


def matrix_sets(spark: SparkSession, path: str) -> DataFrame:
    """id, levels (array of id, scale, width) of the tile matrix sets in capabilities XML."""
    level = "array<struct<`ows:Identifier`:string,ScaleDenominator:double,TileWidth:int>>"
    rows = spark.read.format("xml").option("rowTag", "TileMatrixSet").schema(f"`ows:Identifier` string, TileMatrix {level}").load(path)
    levels = F.transform("TileMatrix", lambda m: F.struct(m["ows:Identifier"].alias("id"), m["ScaleDenominator"].alias("scale"), m["TileWidth"].alias("width")))
    return rows.where("TileMatrix IS NOT NULL").select(F.col("`ows:Identifier`").alias("id"), levels.alias("levels"))
