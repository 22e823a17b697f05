"""Streams whose rows arrive late and out of order, in several runs of one query: state, counts, late rows, changes, payloads.

``events`` arrive up to half a day after they happen, and are staged in slices of six days of arrival. After each slice the same query runs
to its end and stops; the next run goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import history as H
from ..operators import rules as R
from ..sources import files as S
from ..sources import queue as Q
from ..sources import sinks as K
from ..sources.buckets import BucketTable, changed_rows
from ..streaming import ingest as G
from ..streaming import state as P
from ..streaming import windows as W
from .base import ntz, query, table
from .streams import work_folder

_HALF_DAY = 43_200
_ORIGIN = 1_704_067_200  # 2024-01-01
_SLICE = 6 * 86_400
_SLICES = 6


def _slice(late_seconds: Column) -> Column:
    """Rows of before the first slice arrive with it, those of after the last one with that."""
    number = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + late_seconds - _ORIGIN) / _SLICE).cast("int")
    return F.least(F.greatest(number, F.lit(0)), F.lit(_SLICES - 1))


def _jitter() -> Column:
    return F.col("event_id") * 7919 % _HALF_DAY


_SQL_SLICE = "least(greatest(floor((floor(epoch(ts)) + {} - 1704067200) / 518400), 0), 5)"
_SQL_JITTER = "event_id * 7919 % 43200"


def arriving(spark: SparkSession, sf_dir: str, late_seconds: Column | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("slice", _slice(_jitter() if late_seconds is None else late_seconds))


def in_slices(rows: DataFrame, stage: Callable[[DataFrame, int], None], run: Callable[[], StreamingQuery | None]) -> None:
    """Stages one slice after the other and runs the query to its end after each."""
    for number in range(_SLICES):
        stage(rows.filter(F.col("slice") == number).drop("slice"), number)
        if (q := run()) is not None:
            q.awaitTermination()


#: The folder of staged files is read as a pattern, which may match nothing yet.
def to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


_TRIPS = """
    s AS (SELECT event_id // 2 AS trip_id, event_id AS start_id, ts AS started_at FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 0),
    e AS (SELECT event_id // 2 AS trip_id, event_id AS end_id, ts AS ended_at, value AS fare FROM events WHERE event_id % 2 = 1)
"""


@query("stream_trip_state", f"""
    WITH {_TRIPS}, w AS (SELECT greatest((SELECT max(epoch_ms(started_at)) FROM s), (SELECT max(epoch_ms(ended_at)) FROM e)) - 43200000 AS watermark)
    SELECT e.trip_id, end_id, ended_at, fare, start_id, started_at, CASE WHEN start_id IS NULL THEN 'missing_start' ELSE 'ok' END AS data_quality,
           CASE WHEN start_id IS NULL THEN 'trip_end_upsert' ELSE 'trip_end_update' END AS record_source
    FROM e LEFT JOIN s ON s.trip_id = e.trip_id WHERE start_id IS NOT NULL OR epoch_ms(ended_at) + 21600000 <= (SELECT watermark FROM w)
""")  # fmt: skip
def stream_trip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M9, J12, M5] Starts and ends of trips in any order, over restarts: an end gets its start whenever either arrives, or is given up by a timer."""
    folder, is_end = work_folder(spark), F.col("event_id") % 2 == 1
    rows = arriving(spark, sf_dir).filter(is_end | (F.col("user_id") % 7 != 0))
    trips = rows.select(
        F.expr("event_id div 2").alias("trip_id"), is_end.alias("is_end"), "ts", "slice",
        F.when(~is_end, F.col("event_id")).alias("start_id"), F.when(~is_end, F.col("ts")).alias("started_at"),
        F.when(is_end, F.col("event_id")).alias("end_id"), F.when(is_end, F.col("ts")).alias("ended_at"), F.when(is_end, F.col("value")).alias("fare"),
    )
    source = spark.readStream.schema(trips.drop("slice").schema).parquet(f"{folder}/i[n]").withWatermark("ts", "12 hours")
    out = P.paired(source, "trip_id", "ts", "is_end", ["start_id", "started_at"], ["end_id", "ended_at", "fare"], wait_seconds=6 * 3600, keep_seconds=86_400)
    with P.state_store(spark):
        in_slices(trips, lambda df, n: df.write.mode("append").parquet(f"{folder}/in"), lambda: W.start(out, "parquet", f"{folder}/out", f"{folder}/checkpoint"))
    stored = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return stored.withColumns({"started_at": ntz("started_at"), "ended_at": ntz("ended_at")})


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("value", T.DoubleType())])
_REQUIRED = ("event_id", "user_id", "event_type", "ts")


def _json_text() -> Column:
    """Events as JSON: some without a user, some of an unknown type, some cut off."""
    user = F.when(F.col("event_id") % 13 != 0, F.col("user_id"))
    kind = F.when(F.col("event_id") % 11 == 0, "unknown").otherwise(F.col("event_type"))
    whole = F.to_json(F.struct("event_id", user.alias("user_id"), kind.alias("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value"))
    return F.when(F.col("event_id") % 97 == 0, F.substring(whole, 1, 7)).otherwise(whole)


_BROKEN = "event_id % 97 = 0"


@query("stream_expectations", f"""
    WITH r(rule, broken) AS (
        SELECT 'well_formed', count(*) FILTER (WHERE {_BROKEN}) FROM events UNION ALL SELECT 'user_given', count(*) FILTER (WHERE {_BROKEN} OR event_id % 13 = 0 OR user_id IS NULL) FROM events
        UNION ALL SELECT 'type_known', count(*) FILTER (WHERE {_BROKEN} OR event_id % 11 = 0 OR event_type NOT IN ('signup', 'click', 'purchase', 'view', 'error')) FROM events)
    SELECT rule, (SELECT count(*) FROM events) AS rows, broken, (SELECT count(*) FROM events WHERE NOT ({_BROKEN} OR event_id % 11 = 0)) AS stored FROM r
""")  # fmt: skip
def stream_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M11, Q1, Q2, S1, S2] JSON lines as a stream: broken ones kept whole, expectations counted batch by batch where the rows pass, violators of one dropped."""
    folder = work_folder(spark)
    rules = [
        R.Rule("well_formed", F.col(G.CORRUPT).isNull()), R.Rule("user_given", F.col("user_id").isNotNull()),
        R.Rule("type_known", F.col("event_type").isin("signup", "click", "purchase", "view", "error"), "drop"),
    ]
    name = f"expectations_{folder[-12:]}"
    source = S.bronze(G.json_stream(spark, f"{folder}/i[n]", _EVENT))
    checked, log = R.expect(source, rules, observation=name), G.CountLog(spark, name, f"{folder}/counts")
    spark.streams.addListener(log)
    try:
        def run() -> None:
            q = W.start(checked, "parquet", f"{folder}/out", f"{folder}/checkpoint")
            q.awaitTermination()
            log.wait(q)

        in_slices(arriving(spark, sf_dir), lambda df, n: df.select(_json_text().alias("value")).write.mode("append").text(f"{folder}/in"), run)
    finally:
        spark.streams.removeListener(log)
    stored = spark.read.schema(checked.schema).parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("stored"))
    return log.counts().join(stored)  # one row


@query("stream_late_rows", f"""
    WITH a AS (SELECT event_type, ts, {_SQL_SLICE.format("CASE WHEN event_id % 50 = 0 THEN 864000 ELSE " + _SQL_JITTER + " END")} AS slice FROM events),
    m AS (SELECT slice, max(ts) AS last FROM a GROUP BY 1), w AS (SELECT slice, max(last) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOUR AS watermark FROM m)
    SELECT event_type, count(*) FILTER (WHERE NOT coalesce(ts < watermark, false)) AS kept, count(*) FILTER (WHERE coalesce(ts < watermark, false)) AS late, count(*) AS all_rows FROM a JOIN w USING (slice) GROUP BY 1
""")  # fmt: skip
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M8, S18, M1] Rows behind the watermark are put aside and counted: kept and late ones are all rows."""
    folder = work_folder(spark)
    rows = arriving(spark, sf_dir, F.when(F.col("event_id") % 50 == 0, 864_000).otherwise(_jitter())).select("event_id", "event_type", "ts", "slice")
    schema, split = rows.drop("slice").schema, G.LateSplit(f"{folder}/split", "ts", timedelta(hours=12))
    source = spark.readStream.schema(schema).parquet(f"{folder}/i[n]")
    in_slices(rows, lambda df, n: df.write.mode("append").parquet(f"{folder}/in"), lambda: to_end(source, split, f"{folder}/checkpoint"))
    counts = F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("late"), F.count(F.lit(1)).alias("all_rows")
    return split.rows(spark, schema).groupBy("event_type").agg(*counts)


@query("payload_stream", f"""
    SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'dead' END AS outcome, reason, count(*) AS n, count(DISTINCT event_id) AS n_distinct
    FROM (SELECT event_id, CASE WHEN {_BROKEN} THEN 'malformed' WHEN event_id % 13 = 0 THEN 'missing user_id' END AS reason FROM events) GROUP BY 1, 2
""")  # fmt: skip
def payload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S7, S20, S21] Payload bytes from a queue, read from the earliest segment on and never twice, decoded; dead letters keep their payload and a reason."""
    spark.dataSource.register(Q.PayloadQueue)
    folder = work_folder(spark)
    rows = arriving(spark, sf_dir).select(_json_text().alias("payload"), "slice")
    letters = lambda df: G.outcomes(df, _EVENT, _REQUIRED)
    sink = G.replay_sink(f"{folder}/out", ["outcome"], letters)
    source = lambda: spark.readStream.format("payload_queue").load(f"{folder}/queue")
    in_slices(rows, lambda df, n: Q.append_segment(df, f"{folder}/queue", n), lambda: to_end(source(), sink, f"{folder}/checkpoint"))
    to_end(source(), sink, f"{folder}/checkpoint").awaitTermination()  # finds nothing new
    stored = spark.read.parquet(f"{folder}/out")
    id_of = F.coalesce(F.col("record.event_id").cast("string"), F.concat_ws("/", "segment", "file", "position"))
    return stored.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_of).alias("n_distinct"))


_SCD2_DELETES = """
    o AS (SELECT user_id, event_id, ts, event_type, value, event_type = 'error' AS gone, CASE WHEN lag(event_id) OVER w IS NULL OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
    h0 AS (SELECT user_id, run, gone, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, min(ts) AS valid_from FROM g GROUP BY 1, 2, 3),
    h AS (SELECT user_id, event_id, ts, event_type, value, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY run) AS valid_to, gone FROM h0)
"""


def _deleted() -> Column:
    return F.col("event_type") == "error"


@query("scd2_late_changes", f"WITH {_SCD2_DELETES} SELECT * EXCLUDE (gone) FROM h WHERE NOT gone")
def scd2_late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C3, M10] A type 2 table from thirds of the changes in no order of time, one of them twice, deletes among them: equal to all changes at once."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    spec = (["user_id"], ["ts", "event_id"], ["event_type"])
    history = H.scd2(rows.filter("event_id % 3 = 1"), *spec, deletes=_deleted())
    log = rows.filter("event_id % 3 = 1")
    for part in (rows.filter("event_id % 3 = 2"), rows.filter("event_id % 3 <> 1")):
        history, fresh = H.scd2_split(history, log, part, *spec, deletes=_deleted())
        log = log.unionByName(fresh)
    return history


@query("stream_scd2", f"WITH {_SCD2_DELETES} SELECT * EXCLUDE (gone) FROM h WHERE NOT gone")
def stream_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M10, C3, M11] A stream of late and deleting changes into a type 2 table; the change log is its bronze table."""
    folder = work_folder(spark)
    rows = arriving(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value", "slice")
    table2 = W.HistoryTable(f"{folder}/history", ["user_id"], ["ts", "event_id"], ["event_type"], rows.drop("slice").schema, deletes=_deleted(), n=8)
    source = spark.readStream.schema(rows.drop("slice").schema).parquet(f"{folder}/i[n]")
    in_slices(rows, lambda df, n: df.write.mode("append").parquet(f"{folder}/in"), lambda: to_end(source, table2.merge, f"{folder}/checkpoint"))
    out = table2.read(spark)
    return out.withColumns({c: ntz(c) for c in ("ts", "valid_from", "valid_to")})


def _orders_table(spark: SparkSession, sf_dir: str, folder: str) -> tuple[BucketTable, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return BucketTable(f"{folder}/orders", ("o_orderkey",), orders.schema, 32), orders


@query("merged_buckets", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey <= 40 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 3 OR o_orderkey <= 40")
def merged_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C1, C13] A table in buckets of its key; a small batch reads and replaces the buckets it touches, and nothing when it comes again."""
    held, orders = _orders_table(spark, sf_dir, work_folder(spark))
    held.merge(orders.filter("o_orderkey % 7 <> 3"), 0)
    batch = orders.filter("o_orderkey <= 40").withColumn("o_orderstatus", F.lit("new"))
    for number in (1, 1):
        held.merge(batch, number)
    return held.read(spark)


@query("stream_merged_buckets", "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_merged_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M10, C2] Changes of a stream, late ones too, merged into a type 1 table by buckets instead of a new snapshot a batch."""
    folder = work_folder(spark)
    rows = arriving(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value", "slice")
    schema = rows.drop("slice").schema
    held = BucketTable(f"{folder}/users", ("user_id",), schema, 16)
    source = spark.readStream.schema(schema).parquet(f"{folder}/i[n]")
    in_slices(rows, lambda df, n: df.write.mode("append").parquet(f"{folder}/in"), lambda: to_end(source, W.bucket_sink(held, ["ts", "event_id"]), f"{folder}/checkpoint"))
    return held.read(spark).withColumn("ts", ntz("ts"))


@query("checksum_diff", """
    SELECT o_orderkey, o_custkey, o_orderstatus || CASE WHEN o_orderkey % 500 = 1 THEN '!' ELSE '' END AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 1000 = 7 THEN 'insert' ELSE 'update_postimage' END AS _change_type
    FROM orders WHERE o_orderkey % 500 = 1 OR o_orderkey % 1000 = 7
""")  # fmt: skip
def checksum_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C5, C6, Q13] The rows in which two tables differ, from checksums of their buckets and the rows of those that differ."""
    folder = work_folder(spark)
    old, orders = _orders_table(spark, sf_dir, f"{folder}/old")
    new = BucketTable(f"{folder}/new", old.keys, old.schema, old.n)
    old.merge(orders.filter("o_orderkey % 1000 <> 7"))
    new.merge(orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 500 == 1, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))))
    return changed_rows(old, new, spark)


@query("microbatch_files", f"""
    WITH a AS (SELECT {_SQL_SLICE.format(_SQL_JITTER)} AS slice, count(*) AS n FROM events GROUP BY 1)
    SELECT (SELECT count(*) FROM events) AS rows, cast(sum(ceil(n * 200 / 100000.0)) AS BIGINT) AS files FROM a
""")  # fmt: skip
def microbatch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C11] A micro-batch sink that writes as many files as a batch's rows need, and none for an empty batch."""
    folder = work_folder(spark)
    rows = arriving(spark, sf_dir).select("event_id", "event_type", "slice")
    schema = rows.drop("slice").schema
    source = spark.readStream.schema(schema).parquet(f"{folder}/i[n]")
    sink = K.write_microbatch(f"{folder}/out", row_bytes=200, file_bytes=100_000)
    in_slices(rows, lambda df, n: df.write.mode("append").parquet(f"{folder}/in"), lambda: to_end(source, sink, f"{folder}/checkpoint"))
    stored = spark.read.schema(schema).parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("rows"))
    return stored.join(S.listing(spark, f"{folder}/out", "part-*").agg(F.count(F.lit(1)).alias("files")))  # one row each
