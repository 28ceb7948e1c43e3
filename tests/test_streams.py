import datetime
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.streaming import queues


def stream_of(spark, folder, batches, schema):
    """A stream that takes one file, and so one batch, after the other."""
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        columns = [c.split()[0] for c in schema.split(", ")]
        pd.DataFrame(rows, columns=columns).to_parquet(f"{folder}/{i}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_open_items_are_forgotten(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(d)
    batches = [
        [(1, 1, False, day(0)), (2, 3, False, day(0)), (2, 2, None, day(0)), (3, 1, True, day(0)), (4, 2, False, day(1)), (4, 1, True, day(0))],
        [(4, 3, True, day(2)), (9, 1, True, day(100))],
        [(1, 2, True, day(101)), (2, 4, False, day(101))],
    ]
    kept = {(3, "done", 1), (4, "done", 1), (4, "done", 2), (9, "done", 1)}
    for ts, more in (("ts", {(1, "done", 1)}), (None, {(1, "done", 2), (2, "dead", 3)})):
        attempts = stream_of(spark, tmp_path / f"in-{ts}", batches, "k long, i long, good boolean, ts timestamp")
        got = queues.drain(queues.bounded_retries(attempts, "k", "i", "good", ts=ts, remember="30 days"), "test-retries").collect()
        assert sorted(map(tuple, got)) == sorted(kept | more)


def test_stages_run_at_once_and_are_counted(spark, tmp_path):
    batches = [[(10 * b + i,) for i in range(10)] for b in range(4)]
    active = []

    def seen(df):
        active.append(len(spark.streams.active))
        return df.where("n % 5 <> 0")

    numbers = stream_of(spark, tmp_path / "in", batches, "n long")
    out, counts = queues.chained(numbers, [("even", lambda df: df.where("n % 2 = 0")), ("some", seen), ("twice", lambda df: df.select((F.col("n") * 2).alias("m")))])
    want = [n for n in range(40) if n % 2 == 0 and n % 5]
    assert sorted(r["m"] for r in out["twice"].collect()) == [2 * n for n in want] and out["even"].count() == 20
    assert counts == {"even": (40, 20), "some": (20, len(want)), "twice": (len(want), len(want))}
    assert active == [1] and not spark.streams.active
    rows = queues.progress(spark, counts).orderBy("stage").collect()
    assert [(r["name"], r["done"], r["pending"]) for r in rows] == [("even", 20, 20), ("some", 16, 4), ("twice", 16, 0)]


def test_a_stage_that_fails_stops_the_others(spark, tmp_path):
    numbers = stream_of(spark, tmp_path / "in", [[(1,), (2,)]], "n long")
    bad = lambda df: df.select(F.raise_error(F.lit("no such tile")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no such tile"):
        queues.chained(numbers, [("first", lambda df: df), ("second", bad), ("third", lambda df: df)])
    assert not spark.streams.active
