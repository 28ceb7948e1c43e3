"""Tag queries over a column ``tags`` of type map<string, string>."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAUSE = re.compile(r'^(node|way|rel|relation)\["([^"]+)"(?:="([^"]*)")?\]$')


def parse(clause: str) -> tuple[str, str, str | None]:
    """way["k"="v"] -> (way, k, v); way["k"] -> (way, k, None), which any value meets."""
    found = _CLAUSE.match(clause.strip().rstrip(";"))
    if not found:
        raise ValueError(f"not a tag query: {clause!r}")
    return found[1], found[2], found[3]


def holds(clauses: list[tuple], tags: str = "tags") -> Column:
    """Whether any of the clauses holds."""
    each = [F.map_contains_key(tags, k) if v is None else F.coalesce(F.col(tags)[k] == v, F.lit(False)) for _, k, v in clauses]
    return functools.reduce(operator.or_, each)


def select(df: DataFrame, clauses: list[tuple], keep: list[str] | None = None, tags: str = "tags") -> DataFrame:
    """Rows that a clause holds for, with the tags in ``keep`` (all without it)."""
    found = df.where(holds(clauses, tags))
    return found if keep is None else found.withColumn(tags, F.map_filter(tags, lambda k, _: k.isin(keep)))


def without(df: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """Rows that have none of the keys."""
    return df.where(~F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys))))


def mark_direct(rows: DataFrame, members: DataFrame, key: str, clauses: list[tuple], tags: str = "tags") -> DataFrame:
    """``direct`` is true for rows that a clause holds for, false for those that only a member list names."""
    found = rows.withColumn("direct", holds(clauses, tags))
    named = members.select(key).distinct().withColumn("_named", F.lit(True))
    return found.join(named, key, "left").where(F.col("direct") | F.coalesce("_named", F.lit(False))).drop("_named")
