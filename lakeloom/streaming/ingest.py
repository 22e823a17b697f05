"""Streams of files and payloads on their way into tables: counted expectations, late rows, batches that may run twice."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.columns import decode_json, missing_fields
from ..sources.sinks import exists

CORRUPT = "_corrupt_record"


def json_stream(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = CORRUPT, **options) -> DataFrame:
    """[M11, S1] JSON lines of a folder as a stream of declared columns; lines that can't be read are whole in ``corrupt``, all else null."""
    declared = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    return spark.readStream.schema(declared).option("columnNameOfCorruptRecord", corrupt).options(**options).json(path)


class CountLog(StreamingQueryListener):
    """[M11, Q1] Keeps the counts that ``expect(..., observation=name)`` observes: one folder a batch below ``path``.

    Counts are observed where the rows pass, without a job of their own. A batch that runs again after a failure writes the same folder, so sums over
    all batches count every row once. ``name`` tells the query from others of the session.
    """

    def __init__(self, spark: SparkSession, name: str, path: str) -> None:
        self.spark, self.name, self.path = spark, name, path
        self.ended, self.failed = threading.Condition(), None
        self.runs: set[str] = set()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(self.name)
        if counts is None:
            return
        try:
            found = counts.asDict()
            rows = [(rule, found["rows"], n) for rule, n in found.items() if rule != "rows"]
            self.spark.createDataFrame(rows, "rule string, rows long, broken long").coalesce(1).write.mode("overwrite").json(f"{self.path}/query={event.progress.id}/batch={event.progress.batchId}")
        except Exception as e:  # the listener bus would only log it
            self.failed = e

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.runs.add(str(event.runId))
            self.ended.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Returns once the counts of a finished query are stored; events reach a listener a little after the query's end."""
        with self.ended:
            if not self.ended.wait_for(lambda: str(query.runId) in self.runs, seconds):
                raise TimeoutError("the end of the query was not heard of")
        if self.failed:
            raise self.failed

    def counts(self) -> DataFrame:
        """(rule, rows, broken) over all batches."""
        stored = self.spark.read.schema("rule string, rows long, broken long").json(f"{self.path}/*/*")
        return stored.groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("broken").alias("broken"))


def replay_sink(path: str, partitions: Sequence[str] = (), prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """[C11, S20] For ``foreachBatch``: each batch in a folder of its own, ``batch=n``, that it replaces when it runs again."""
    return lambda df, number: prepare(df).write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={number}")


def outcomes(payloads: DataFrame, schema: T.StructType, required: Sequence[str], payload: str = "payload") -> DataFrame:
    """[S7, S20] Payload bytes decoded: ``record``, ``outcome`` ('good' or 'dead') and the ``reason`` of a dead letter, whose payload stays beside it."""
    record, missing = F.col("record"), F.col("_missing")
    decoded = payloads.withColumn("record", decode_json(payload, schema)).withColumn("_missing", F.concat_ws(",", missing_fields("record", required)))
    reason = F.when(record.isNull(), "malformed").when(missing != "", F.concat(F.lit("missing "), missing))
    return decoded.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), "good").otherwise("dead")).drop("_missing")


class LateSplit:
    """[M8, S18, M1] For ``foreachBatch``: rows behind the watermark go to a side table instead of vanishing.

    A batch's watermark is the last event time of the batches before less the delay, as it is for Spark's own operators; it is read
    from the marks that each batch leaves, so it holds over restarts, and a batch that runs again gives the same rows. One pass
    writes a batch, ``late=false`` and ``late=true`` apart, and observes its last event time and counts on the way.
    """

    def __init__(self, path: str, time: str, delay: timedelta) -> None:
        self.path, self.time, self.delay = path, time, delay

    def watermark(self, spark: SparkSession, number: int) -> datetime | None:
        if not exists(spark, f"{self.path}/marks"):
            return None
        marks = spark.read.schema("number long, last timestamp, rows long, late long").json(f"{self.path}/marks/*")
        last = marks.filter(F.col("number") < number).agg(F.max("last")).head()[0]
        return None if last is None else last - self.delay

    def __call__(self, df: DataFrame, number: int) -> None:
        spark, mark = df.sparkSession, Observation()
        limit = self.watermark(spark, number)
        late: Column = F.lit(False) if limit is None else F.coalesce(F.col(self.time) < F.lit(limit), F.lit(False))
        rows = df.withColumn("late", late).observe(mark, F.max(self.time).alias("last"), F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/batch={number}")
        found = mark.get
        kept = spark.createDataFrame([(number, found["last"], found["rows"], found["late"])], "number long, last timestamp, rows long, late long")
        kept.coalesce(1).write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{self.path}/marks/batch={number}")

    def rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows of all batches, with ``batch`` and ``late``."""
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
        return spark.read.schema(whole).parquet(f"{self.path}/rows")
