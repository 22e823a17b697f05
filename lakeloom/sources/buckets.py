"""Tables laid out by a hash of their key, so that a merge reads and replaces only the buckets it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import diff, upsert
from .sinks import exists


@dataclass(frozen=True)
class BucketTable:
    """[C1, M10] A Parquet table of ``n`` folders ``_bucket=i``, one writer.

    Choose ``n`` so that a bucket is a few files. A batch writes a mark when it is done: the same number again changes nothing.
    Without a mark, that is after a failure, it may run again: a merge by key gives the same rows. Beside the rows lie the
    buckets' checksums (rows, and sums of their hashes in two halves, which no order changes), for :func:`changed_rows`.
    """

    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    n: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are read."""
        stored = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        df = spark.read.schema(stored).parquet(f"{self.path}/rows") if exists(spark, f"{self.path}/rows") else spark.createDataFrame([], stored)
        return (df if buckets is None else df.filter(F.col("_bucket").isin(list(buckets)))).drop("_bucket")

    def _write(self, df: DataFrame, touched: Sequence[int]) -> None:
        dealt = df.select(*self.schema.names, self.bucket().alias("_bucket")).hint("rebalance", "_bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        sums = self.checksums(self.read(df.sparkSession, touched))
        sums.withColumn("_bucket", F.col("bucket")).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/sums")

    def merge(self, batch: DataFrame, number: int | None = None, sequence: Sequence[str] = ()) -> list[int]:
        """Upserts ``batch`` by key (the largest ``sequence`` of a key counts); returns the touched buckets, none if batch ``number`` is done already."""
        spark, mark = batch.sparkSession, f"{self.path}/batches/{number}"
        if number is not None and exists(spark, f"{mark}/_SUCCESS"):
            return []
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())  # n rows at most
        if touched:
            self._write(upsert(self.read(spark, touched), batch.select(*self.schema.names), self.keys, sequence), touched)
        if number is not None:
            spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").json(mark)
        return touched

    def checksums(self, df: DataFrame) -> DataFrame:
        """(bucket, rows, low, high) of ``df``: equal for equal rows in any order, nulls told from values."""
        every = [F.col(f"`{c}`") for c in self.schema.names]
        h = df.select(self.bucket().alias("bucket"), F.xxhash64(*every, *[c.isNull() for c in every]).alias("h"))
        half = lambda shift: F.sum(F.shiftrightunsigned("h", shift).bitwiseAND(0xFFFFFFFF))
        return h.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), half(0).alias("low"), half(32).alias("high"))

    def stored_checksums(self, spark: SparkSession) -> DataFrame:
        kind = "bucket int, rows long, low long, high long"
        return spark.read.schema(kind).parquet(f"{self.path}/sums") if exists(spark, f"{self.path}/sums") else spark.createDataFrame([], kind)


def checksum_tree(leaves: DataFrame, fan: int = 16, depth: int = 2) -> DataFrame:
    """[C5] (level, node, rows, low, high): the leaves (level 0) and the sums of ``fan`` nodes each above them, up to ``depth``."""
    sums = [F.sum(c).alias(c) for c in ("rows", "low", "high")]
    up = lambda k: leaves.groupBy(F.lit(k).alias("level"), F.expr(f"bucket div {fan**k}").cast("int").alias("node")).agg(*sums)
    out = up(0)
    for k in range(1, depth + 1):
        out = out.unionByName(up(k))
    return out


def differing_buckets(old: BucketTable, new: BucketTable, spark: SparkSession) -> list[int]:
    """[C5, C6] Buckets whose checksums differ, from the stored sums alone; the tables must have the same keys and number of buckets."""
    if old.keys != new.keys or old.n != new.n:
        raise ValueError("the tables have different buckets")
    a, b = (t.stored_checksums(spark).select("bucket", F.struct("rows", "low", "high").alias(name)) for t, name in ((old, "a"), (new, "b")))
    both = a.join(b, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return sorted(r[0] for r in both.select("bucket").collect())  # n rows at most


def changed_rows(old: BucketTable, new: BucketTable, spark: SparkSession, deletes: bool = False) -> DataFrame:
    """[C5, C6, Q13] The rows of :func:`diff`; only buckets that differ are read and joined, equal ones are not scanned."""
    buckets = differing_buckets(old, new, spark)
    return diff(old.read(spark, buckets), new.read(spark, buckets), list(new.keys), deletes)
