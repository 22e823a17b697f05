"""Distinct counts that add up: sketches and bitmaps kept by window and key, united to coarser ones without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's buckets; the relative deviation is about 1.04 / 2^(LG / 2), 1.6 % here.
LG = 12


def sketches(columns: dict[str, str | Column], lg: int = LG) -> dict[str, Column]:
    """[A24, M3, M4] Measures for a grouping, streams too: one HLL sketch (binary, of bounded size) for each {name: what to count}."""
    return {name: F.hll_sketch_agg(F.col(x).cast("string") if isinstance(x, str) else x.cast("string"), F.lit(lg)) for name, x in columns.items()}


def united(stored: DataFrame, keys: Sequence[str | Column], columns: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """[A24, M4] Keys, estimates of the united sketches in ``columns`` (whole numbers), and sums of plain counts."""
    return stored.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns]
    )


def within(estimate: Column | str, exact: Column | str, lg: int = LG, deviations: float = 4.0) -> Column:
    """Whether an estimate is as near to the exact count as a sketch promises."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (estimate, exact))
    return F.abs(a - b) <= F.greatest(F.lit(1.0), b * (deviations * 1.04 / 2 ** (lg / 2)))


def bitmaps(df: DataFrame, keys: Sequence[str | Column], id_col: str, name: str = "ids") -> DataFrame:
    """[A18, A20] (keys, ``<name>_bucket``, ``<name>``, ``rows``): the distinct whole numbers of each group as bitmaps of 32,768 numbers, 4 KB each.

    Null ids are in no bitmap; ``rows`` counts those of a bucket, the null ones under a null bucket.
    """
    grouped = df.groupBy(*keys, F.bitmap_bucket_number(id_col).alias(f"{name}_bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias(name), F.count(F.lit(1)).alias("rows"))


def united_bitmaps(stored: DataFrame, keys: Sequence[str | Column], name: str = "ids") -> DataFrame:
    """[A18, A20] Bitmaps of coarser ``keys``, from those of finer ones. They may be united again."""
    return stored.groupBy(*keys, f"{name}_bucket").agg(F.bitmap_or_agg(name).alias(name), F.sum("rows").alias("rows"))


def distinct_of(stored: DataFrame, keys: Sequence[str], name: str = "ids", as_name: str = "distinct_ids") -> DataFrame:
    """[A18, A20] (keys, ``as_name``, ``rows``): exact distinct numbers, from bitmaps of the keys or of finer ones."""
    counted = united_bitmaps(stored, keys, name).withColumn("_n", F.when(F.col(f"{name}_bucket").isNotNull(), F.bitmap_count(name)).otherwise(0))
    return counted.groupBy(*keys).agg(F.sum("_n").alias(as_name), F.sum("rows").alias("rows"))
