"""Watermarked windows, stream joins and streaming changes. Each function also takes a batch, where a watermark does nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import scd1, scd2, scd2_insert, scd2_merge, unseen, upsert
from ..operators.joins import interval_join
from ..sources.buckets import BucketTable
from ..sources.sinks import exists


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """[M1] A watermark on ``column``, made a timestamp with zone (a watermark needs one)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(df: DataFrame, time: str, width: str, keys: Sequence[str], measures: dict[str, Column], delay: str | None = None) -> DataFrame:
    """[M2, M3, M4, A24] Measures of each window and key, with the window's start and end."""
    df = event_time(df, time, delay) if delay else df
    grouped = df.groupBy(F.window(F.col(time), width), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *measures)


def enrich(events: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """[J15] Static dimensions left-joined to a stream by key."""
    for dim, key in dimensions:
        events = events.join(dim, key, "left")
    return events


def order_lifecycle(starts: DataFrame, ends: DataFrame, key: str, start_at: str, end_at: str, within: str = "90 days") -> DataFrame:
    """[J1, M1] Each start with its end up to ``within`` later; on streams, a start without one comes out once the watermark has passed."""
    return interval_join(event_time(starts, start_at, within), event_time(ends, end_at, within), key, start_at, end_at, within)


def start(df: DataFrame, sink: str, path: str, checkpoint: str, available_now: bool = True, mode: str = "append", partitions: Sequence[str] = ()) -> StreamingQuery:
    """[M5, M6] A query to files: a window comes out once, after the watermark has passed its end."""
    writer = df.writeStream.outputMode(mode).format(sink).option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partitions)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fan_out(queries: dict[str, DataFrame], base: str, checkpoints: str, available_now: bool = True) -> list[StreamingQuery]:
    """[M7] One query for each frame, each with a checkpoint of its own."""
    return [start(df, "parquet", f"{base}/{name}", f"{checkpoints}/{name}", available_now) for name, df in queries.items()]


def change_sink(load: Callable[[], DataFrame | None], store: Callable[[DataFrame], None], keys: Sequence[str], sequence: Sequence[str], tracked: Sequence[str] = (), kind: int = 1):
    """[M9, M10] For ``foreachBatch``: a batch's changes merged into a type 1 or type 2 table.

    A batch that is run again after a failure gives the same table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        current = load()
        if kind == 1:
            both = batch if current is None else current.unionByName(batch)
            store(scd1(both, keys, sequence))
        else:
            store(scd2(batch, keys, sequence, tracked) if current is None else scd2_merge(current, batch, keys, sequence, tracked))

    return apply


def upsert_sink(load: Callable[[], DataFrame | None], store: Callable[[DataFrame], None], keys: Sequence[str], sequence: Sequence[str] = ()):
    """[C1] For ``foreachBatch``: a keyed upsert of each batch."""
    return lambda batch, number: store(upsert(load(), batch, keys, sequence))


def bucket_sink(table: BucketTable, sequence: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """[M10, C2] For ``foreachBatch``: each key's latest row by ``sequence`` in a table of buckets. Only touched buckets are read and replaced; late rows don't win."""

    def apply(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, list(table.keys)
        latest = scd1(batch.select(*table.schema.names), keys, sequence)
        touched = [r[0] for r in latest.select(table.bucket()).distinct().collect()]  # table.n rows at most
        newer = scd1(table.read(spark, touched).unionByName(latest), keys, sequence).join(latest.select(*keys).distinct(), keys, "left_semi")
        table.merge(newer, number, sequence)

    return apply


@dataclass
class HistoryTable:
    """[M10, C3] A type 2 table for ``foreachBatch``, in ``n`` buckets of its keys; beside it the log of changes, each batch in a folder of its own, in the same buckets.

    Batches may be late, hold deletes or come again. Only the buckets that a batch touches are read and replaced, in history and log. A batch that runs again
    after a failure at any point gives the same rows: its own part of the log is not read, and intervals that are made again come out alike.
    """

    path: str
    keys: Sequence[str]
    sequence: Sequence[str]
    tracked: Sequence[str]
    schema: T.StructType
    deletes: Column | None = None
    n: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def _kind(self) -> T.StructType:
        return T.StructType([*self.schema.fields, *[T.StructField(c, self.schema[self.sequence[0]].dataType) for c in ("valid_from", "valid_to")]])

    def _stored(self, spark: SparkSession, part: str, kind: T.StructType, parts: Sequence[str]) -> DataFrame:
        whole = T.StructType([*kind.fields, *[T.StructField(p, T.IntegerType()) for p in parts]])
        return spark.read.schema(whole).parquet(f"{self.path}/{part}") if exists(spark, f"{self.path}/{part}") else spark.createDataFrame([], whole)

    def _timed(self) -> bool:
        return isinstance(self.schema[self.sequence[0]].dataType, T.TimestampType)

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """The touched buckets; none if the batch is done already."""
        spark, names = batch.sparkSession, self.schema.names
        if exists(spark, f"{self.path}/done/{number}/_SUCCESS"):
            return []
        at, here = self.sequence[0], F.col("_bucket").isin
        found = batch.groupBy(self._bucket()).agg(F.unix_micros(F.min(at)), F.unix_micros(F.max(at))) if self._timed() else batch.select(self._bucket()).distinct()
        found = found.collect()  # n rows at most
        touched = sorted(r[0] for r in found)
        if touched:
            stored = lambda: self._stored(spark, "log", self.schema, ["batch", "_bucket"]).filter(here(touched))
            log = stored().filter(F.col("batch") < number).select(*names)
            seen = log
            if self._timed():  # a row that comes again is of the batch's span of time
                lo, hi = (F.timestamp_micros(F.lit(x)) for x in (min(r[1] for r in found), max(r[2] for r in found)))
                seen = log.filter(F.col(at).between(lo, hi))
            fresh = unseen(seen, batch.select(*names), self.keys, self.sequence)
            self._dealt(fresh).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/log/batch={number}")
            fresh = stored().filter(F.col("batch") == number).select(*names)
            history = self._stored(spark, "history", self._kind(), ["_bucket"]).filter(here(touched)).select(*self._kind().names)
            history = scd2_insert(history, log, fresh, self.keys, self.sequence, self.tracked, deletes=self.deletes)
            # Rows of a key never vanish altogether, so every touched bucket is written.
            self._dealt(history).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/history")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").json(f"{self.path}/done/{number}")
        return touched

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, "history", self._kind(), ["_bucket"]).select(*self._kind().names)
