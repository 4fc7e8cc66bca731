"""Equi-joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows, so there are at most HOT_PARTS hot keys, whatever the data.
HOT_PARTS = 500


def join_hot_split(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, ``groups``, whose column ``size`` counts the key's rows.

    Rows of hot keys never meet in one task: the hot part of ``groups`` has at most ``HOT_PARTS`` rows (each holds more
    than 1/HOT_PARTS of ``total``), so it is broadcast and the rows stay where they are. All other keys have at most
    total/HOT_PARTS rows and are joined by shuffle. NULL keys match nothing.
    """
    limit = max(1, total // HOT_PARTS)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    in_hot = rows.join(F.broadcast(hot), keys)
    in_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return in_hot.unionByName(in_cold)
