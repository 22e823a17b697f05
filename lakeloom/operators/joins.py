"""Joins beyond a plain equi join. No hint decides a side: Spark broadcasts what it measures to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import first_rows


def assemble(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """[J3, J4, J10] ``base`` left-joined with one-row-a-key aggregates."""
    for part in parts:
        base = base.join(part, list(keys), "left")
    return base


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, how: str = "left", bin_width: float | None = None) -> DataFrame:
    """[J6, J7] Points with the ranges of their key that hold them, both ends included.

    ``bin_width`` cuts ranges to bins of that many units of ``at`` and adds the bin to the
    key, so a key with very many ranges spreads over tasks; a range yields one row a bin that it touches. Columns of
    ``ranges`` that clash, except the keys, must be renamed before.
    """
    left, right = points.alias("p"), ranges.alias("r")
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys]
    if bin_width:
        number = lambda x: F.floor(F.col(x).cast("double") / bin_width)
        left = points.withColumn("_bin", number(at)).alias("p")
        right = ranges.withColumn("_bin", F.explode(F.sequence(number(start), number(end)))).alias("r")
        on.append(F.col("p._bin") == F.col("r._bin"))
    on += [F.col(f"p.{at}") >= F.col(f"r.{start}"), F.col(f"p.{at}") <= F.col(f"r.{end}")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    dropped = [F.col(f"r.{k}") for k in keys]
    out = left.join(right, condition, how)
    if bin_width:
        out = out.drop(F.col("p._bin"), F.col("r._bin"))
    return out.drop(*dropped)


def interval_join(starts: DataFrame, ends: DataFrame, key: str, start_at: str, end_at: str, within: str, how: str = "left") -> DataFrame:
    """[J1] Each start with the ends of its key from its time on, up to ``within`` later; works on batches and streams with watermarks."""
    right = ends.withColumnRenamed(key, f"_{key}")
    on = (F.col(key) == F.col(f"_{key}")) & (F.col(end_at) >= F.col(start_at)) & (F.col(end_at) <= F.col(start_at) + F.expr(f"INTERVAL {within}"))
    return starts.join(right, on, how).drop(f"_{key}")


def join_latest(facts: DataFrame, dimension: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """[J16] Left join to the latest version of a dimension."""
    return facts.join(first_rows(dimension, [key], order), key, "left")


def role_join(facts: DataFrame, dimension: DataFrame, key: str, roles: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """[J11] The same dimension joined once for each role: {column of facts: prefix}; ``columns`` maps its columns to suffixes."""
    for own, prefix in roles.items():
        side = dimension.select(F.col(key).alias(f"_{prefix}"), *[F.col(c).alias(f"{prefix}_{n}") for c, n in columns.items()])
        facts = facts.join(side, F.col(own) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    return facts


def orphans(facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None) -> DataFrame:
    """[J17, Q10] Rows whose non-null key the dimension lacks."""
    side = dimension.select(F.col(dimension_key or key).alias("_k")).distinct()
    return facts.filter(F.col(key).isNotNull()).join(side, F.col(key) == F.col("_k"), "left_anti")


def with_several(df: DataFrame, key: str) -> DataFrame:
    """[J19] Rows of keys that have more than one row."""
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return df.join(several, key, "left_semi")


def overlaps(history: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """[J18, Q14] (key, a, b): intervals of a key that overlap, each with the one before it; an open end is endless.

    Sorted intervals overlap if one begins before the furthest end so far: one window, no self join, no pairs.
    """
    order = Window.partitionBy(key).orderBy(F.col(start), F.col(row_id))
    far = F.struct(F.coalesce(F.col(end).cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("e"), F.col(row_id).alias("i"))
    before = F.max(far).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("_before", before)
    return marked.filter(F.col(start).cast("timestamp") < F.col("_before.e")).select(key, F.col("_before.i").alias("a"), F.col(row_id).alias("b"))


def lifecycle(starts: DataFrame, ends: DataFrame, key: str, received: str | None = None) -> DataFrame:
    """[J12, M9] One row for each end, with its start's columns.

    ``data_quality`` is 'missing_start' where there is no start (or, with ``received``, the name of a
    time column of both sides, where it came after the end), else 'ok'; ``record_source`` tells the same by name.
    Clashing columns of ``ends``, except the key, must be renamed before.
    """
    side = starts.withColumn("_has_start", F.lit(True))
    if received:
        side = side.withColumnRenamed(received, "_start_received")
    out = ends.join(side, key, "left")
    known = F.coalesce(F.col("_has_start"), F.lit(False))
    if received:
        known = known & (F.col("_start_received") <= F.col(received))
    quality = F.when(known, "ok").otherwise("missing_start")
    source = F.when(known, "trip_end_update").otherwise("trip_end_upsert")
    return out.withColumn("data_quality", quality).withColumn("record_source", source).drop("_has_start", "_start_received")
