"""Operators that choose or compare rows: windows, ranks, sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def ranked(df: DataFrame, keys: Keys, order: Sequence[Column], name: str = "rank", at_most: int | None = None) -> DataFrame:
    """[W3, T3] ``df`` with the row number in each group; at most so many a group (Spark limits groups before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if at_most is None else out.filter(F.col(name) <= at_most)


def first_rows(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """[W1, W2, W4, W5, W10] The first row of each group in a total order."""
    return ranked(df, keys, order, "_rank", 1).drop("_rank")


def latest_by(df: DataFrame, keys: Keys, sequence: Sequence[str]) -> DataFrame:
    """[C2, W1] The row with the largest ``sequence`` of each key, by aggregation: no sort, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*sequence)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def duplicate_flag(df: DataFrame, keys: Keys, order: Sequence[Column], name: str = "is_duplicate") -> DataFrame:
    """[W11] True for all but the first row of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def duplicate_keys(df: DataFrame, keys: Keys) -> DataFrame:
    """[A23, W12] Keys met more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def change_from_previous(df: DataFrame, keys: Keys, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """[W6] Previous value minus this one; 0 for a group's first row or a null."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.coalesce(before - F.col(value), F.lit(0)))


def gap_to_best(df: DataFrame, keys: Keys, value: str, name: str, best: str = "max") -> DataFrame:
    """[W7, W8] Distance of ``value`` to the group's best, which is its largest or smallest."""
    over = Window.partitionBy(*keys)
    gap = F.max(value).over(over) - F.col(value) if best == "max" else F.col(value) - F.min(value).over(over)
    return df.withColumn(name, gap)


def best_flag(df: DataFrame, keys: Keys, value: str, name: str) -> DataFrame:
    """[W9] Whether ``value`` is the group's smallest; false for null."""
    least = F.min(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.coalesce(F.col(value) == least, F.lit(False)))


def keep_top_entities(df: DataFrame, entity: str, by: Column, n: int) -> DataFrame:
    """[A26, U2] Rows of the ``n`` entities with the largest ``by``, ties to the smaller entity."""
    top = df.groupBy(entity).agg(by.alias("_by")).orderBy(F.desc_nulls_last("_by"), entity).limit(n)
    return df.join(F.broadcast(top.select(entity)), entity, "left_semi")  # n rows


def union_by_name(*frames: DataFrame) -> DataFrame:
    """[U1, U3, S12] All rows; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def difference(all_keys: DataFrame, processed: DataFrame, keys: Keys) -> DataFrame:
    """[U4, S15] Distinct keys of the first that the second lacks; nulls count as equal."""
    return all_keys.select(*keys).subtract(processed.select(*keys))
