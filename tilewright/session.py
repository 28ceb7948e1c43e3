"""Session helpers shared by the library: tables of a folder, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as it is stored, that a task should take.
SHARE = 1 << 24


def tasks(df: DataFrame) -> int | None:
    """How many tasks the tables that ``df`` reads ask for, if that is more than the session's number for a shuffle."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = min(-(-sum(s for s in sizes if s < 1 << 60) // SHARE), 1 << 14)  # where Spark doesn't know the size it says all there is
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its tables ask for, if the session's number for a shuffle is too small.

    What is grouped, ordered or joined by the keys stays where it is, so a task's memory doesn't grow with the table.
    """
    n = tasks(df)
    return df.repartition(n, *keys) if n else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, a local one, as in tests, gets a default; on a cluster a folder
    of one machine would lose tables, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def run_folder(spark: SparkSession) -> str:
    """The folder below the shared one that holds all tables that this application writes for itself."""
    return f"{scratch_dir(spark).rstrip('/')}/tilewright/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a written table."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Removes the tables that this application has written for itself; whether there were any.

    Results of the library's functions read such tables when they are used, so call it when all
    results have been taken or written elsewhere. Other applications' tables and checkpoints stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the shared folder; lost executors cost nothing."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
