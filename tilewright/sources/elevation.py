"""Square elevation files: ``.hgt`` (big-endian, north first) and ``.raw`` (little-endian, south first) 16-bit samples."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.names import parse_hemisphere

NO_DATA = -32768


def decoded(files: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """lat, lon (of the file's name, such as N47W123), n, row, col, value of files (path, content); no data is null.

    ``box`` (west, south, east, north, in degrees) skips files of other squares by their names, before a
    sample is looked at. A file without a square in its name has null lat and lon, and is in no box.
    """
    if box:
        lat, lon = parse_hemisphere(F.element_at(F.split("path", "/"), -1))
        files = files.where(lat.between(box[1], box[3]) & lon.between(box[0], box[2]))

    def cells(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = int(np.sqrt(len(data) // 2))
                if n * n * 2 != len(data):
                    raise ValueError(f"{name} holds no square of samples")
                z = np.frombuffer(data, ">i2" if name.endswith(".hgt") else "<i2").reshape(n, n)
                z = z if name.endswith(".hgt") else z[::-1]
                where = re.search(r"([NS])(\d{2})([EW])(\d{3})", name.rpartition("/")[2])
                lat, lon = (int(where[2]) * (-1 if where[1] == "S" else 1), int(where[4]) * (-1 if where[3] == "W" else 1)) if where else (None, None)
                for at in range(0, n, max(1, 100_000 // n)):
                    part = z[at : at + max(1, 100_000 // n)]
                    row, col = np.divmod(np.arange(part.size), n)
                    v = part.ravel().astype(np.float32)
                    size = part.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lat] * size, pa.int32()), pa.array([lon] * size, pa.int32()), pa.array(np.full(size, n, np.int32)),
                         pa.array((row + at).astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(v, mask=v == NO_DATA)],
                        ["lat", "lon", "n", "row", "col", "value"],
                    )

    return files.select("path", "content").mapInArrow(cells, "lat int, lon int, n int, row int, col int, value float")


def read(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The samples of ``.hgt`` and ``.raw`` files of a folder (see ``decoded``); with a box only its squares' files are opened."""
    files = spark.read.format("binaryFile")
    if box:
        squares = [f"{'NS'[a < 0]}{abs(a):02d}{'EW'[b < 0]}{abs(b):03d}" for a in range(box[1], box[3] + 1) for b in range(box[0], box[2] + 1)]
        files = files.option("pathGlobFilter", "*{" + ",".join(squares) + "}*")
    return decoded(files.load(path), box)


def packed(squares: DataFrame, n: int) -> DataFrame:
    """path, content: squares (lat, lon, row, col, value) of n by n samples as ``.hgt`` files, north first; no data where there is no value."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        z, v = np.full((n, n), NO_DATA, ">i2"), rows["value"].to_numpy(np.float64, na_value=np.nan)
        known = ~np.isnan(v)
        z[rows["row"].to_numpy()[known], rows["col"].to_numpy()[known]] = np.rint(v[known])
        a, b = int(rows["lat"].iloc[0]), int(rows["lon"].iloc[0])
        return pd.DataFrame({"path": [f"{'NS'[a < 0]}{abs(a):02d}{'EW'[b < 0]}{abs(b):03d}.hgt"], "content": [z.tobytes()]})

    return squares.select("lat", "lon", "row", "col", F.col("value").cast("double").alias("value")).groupBy("lat", "lon").applyInPandas(pack, "path string, content binary")


def info(spark: SparkSession, path: str) -> DataFrame:
    """path and n of each file; the samples are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sqrt(F.col("length") / 2).cast("int").alias("n"))


def write_blocks(raster: DataFrame, path: str, rows: int = 256, cols: int = 256) -> None:
    """Writes (row, col, value) as blocks of little-endian 32-bit floats, row by row; no data is NaN."""

    def pack(cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(cells["br"].iloc[0]) * rows, int(cells["bc"].iloc[0]) * cols
        block = np.full((rows, cols), np.nan, "<f4")
        block[cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0] = cells["value"].to_numpy(np.float64, na_value=np.nan)
        return pd.DataFrame({"row": [r0], "col": [c0], "rows": [rows], "cols": [cols], "data": [block.tobytes()]})

    block = lambda c, n: F.floor(F.col(c) / n).alias("b" + c[0])
    dealt = raster.select("row", "col", F.col("value").cast("double").alias("value"), block("row", rows), block("col", cols))
    dealt.groupBy("br", "bc").applyInPandas(pack, "row bigint, col bigint, rows int, cols int, data binary").write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of the cells with data of ``write_blocks``."""

    def cells(batches):
        for batch in batches:
            for b in batch.to_pylist():
                v = np.frombuffer(b["data"], "<f4")
                at = np.flatnonzero(~np.isnan(v))
                r, c = np.divmod(at, b["cols"])
                yield pa.RecordBatch.from_arrays([pa.array(r + b["row"]), pa.array(c + b["col"]), pa.array(v[at].astype("f4"))], ["row", "col", "value"])

    return spark.read.parquet(path).mapInArrow(cells, "row bigint, col bigint, value float")
