"""Relations of member ways by role, and rules on classes of surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROLES = ("outer", "inner")


def by_role(members: DataFrame, relation: str = "relation", way: str = "way", role: str = "role") -> DataFrame:
    """relation, outer, inner: the member ways of either role in order; members of other roles are dropped."""
    ways = lambda r: F.sort_array(F.collect_list(F.when(F.col(role) == r, F.col(way)))).alias(r)
    return members.where(F.col(role).isin(*ROLES)).groupBy(relation).agg(*map(ways, ROLES))


def without_owned(direct: DataFrame, members: DataFrame, selected: DataFrame, relation: str = "relation", way: str = "way", role: str = "role") -> DataFrame:
    """The ways of ``direct`` that no selected relation has as an outer or inner member."""
    owned = members.where(F.col(role).isin(*ROLES)).join(selected.select(relation), relation, "left_semi").select(way)
    return direct.join(owned, way, "left_anti")


def lake_class(area: Column, name: Column, least: float, large: float, keep: list[str]) -> Column:
    """none, water or sea_like: large lakes count as sea, but for those whose names are to keep."""
    kept = F.coalesce(name.isin(*keep), F.lit(False))
    return F.when(area < least, "none").when((area < large) | kept, "water").otherwise("sea_like")


def left_out(kind: Column, wish: Column) -> Column:
    """Whether a list of kinds such as ``2, 5`` leaves a kind out; ``*`` leaves out all, an empty one none."""
    listed = F.transform(F.split(wish, ","), lambda k: F.trim(k))
    return (F.trim(wish) == "*") | F.array_contains(listed, kind.cast("string"))


def forest_class(excluded: Column, altitude: Column) -> Column:
    """The class of a wood by its elevation, unless it is excluded."""
    return F.when(excluded, "excluded").when(altitude > 30, "conifer").when(altitude > 20, "mixed").otherwise("broadleaf")


def by(group: str, order: str) -> WindowSpec:
    """Rows of a group in an order."""
    return Window.partitionBy(group).orderBy(order)
