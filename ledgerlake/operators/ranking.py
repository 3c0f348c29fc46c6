"""Places, best rows and running numbers within keys. Filters on a place reach the map side: a task hands on no
more rows of a key than can be in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.analytics import with_spine


def placed(totals: DataFrame, by: str, within: list[str] = ()) -> DataFrame:
    """Adds `place`, equal values sharing one, the greatest first. Meant for frames of one row an entity."""
    return totals.withColumn("place", F.rank().over(Window.partitionBy(*within).orderBy(F.col(by).desc())))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """Adds the running number (from 1) of a row within its keys; `order` must tell rows apart."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per(df: DataFrame, keys: list[str], order: list[str | Column], k: int, name: str = "position") -> DataFrame:
    """The first k rows of every key."""
    return numbered(df, keys, order, name).filter(F.col(name) <= k)


def latest_per(df: DataFrame, keys: list[str], time: str, *tie: str) -> DataFrame:
    """The newest row of every key."""
    return first_per(df, keys, [F.col(c).desc() for c in (time, *tie)], 1).drop("position")


def compared(results: DataFrame, entities: DataFrame, key: str = "org") -> DataFrame:
    """Every entity beside its result, with a note where there is none."""
    rows = with_spine(entities, results.select(key, "result", "evidence_used"), key, ["evidence_used"])
    return rows.withColumn("note", F.when(F.col("result").isNull(), "not recorded").otherwise("recorded"))
