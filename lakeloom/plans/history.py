"""Change data over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.joins import overlaps, with_several
from .base import ntz, query, table

_SCD2 = """
    o AS (SELECT user_id, event_id, ts, event_type, value, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
    h0 AS (SELECT user_id, run, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, min(ts) AS valid_from FROM g GROUP BY 1, 2),
    h AS (SELECT user_id, event_id, ts, event_type, value, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY run) AS valid_to FROM h0)
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.scd2(changes(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type"])


@query("scd1", "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C2]"""
    return H.scd1(changes(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query("scd2", f"WITH {_SCD2} SELECT * FROM h")
def scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C3]"""
    return event_history(spark, sf_dir)


@query("scd2_incremental", f"WITH {_SCD2} SELECT * FROM h")
def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C3, M10] History of the first part of the events, then the rest merged: equal to all at once."""
    rows = changes(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    first = H.scd2(rows.filter(early), ["user_id"], ["ts", "event_id"], ["event_type"])
    return H.scd2_merge(first, rows.filter(~early), ["user_id"], ["ts", "event_id"], ["event_type"])


@query("scd2_as_of", f"WITH {_SCD2} SELECT user_id, event_type, valid_from FROM h WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def scd2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C9]"""
    return H.as_of(event_history(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "event_type", "valid_from")


@query("changed_users", f"WITH {_SCD2} SELECT user_id, event_id, valid_from FROM h WHERE user_id IN (SELECT user_id FROM h GROUP BY 1 HAVING count(*) > 1)")
def changed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J19] History of entities with more than one row."""
    return with_several(event_history(spark, sf_dir), "user_id").select("user_id", "event_id", "valid_from")


@query("interval_overlaps", """
    WITH i AS (SELECT event_id, user_id, ts, ts + to_minutes(cast(value * 10 AS BIGINT)) AS until FROM events WHERE value IS NOT NULL),
    m AS (SELECT user_id, event_id, ts, max((until, event_id)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i)
    SELECT user_id, struct_extract(b, 2) AS a, event_id AS b FROM m WHERE ts < struct_extract(b, 1)
""")  # fmt: skip
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J18] Intervals that begin before an earlier one of the user has ended."""
    until = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.bround(F.col("value") * 10, 0).cast("long") * 60_000_000)
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), until.alias("until"))
    return overlaps(rows, "user_id", "ts", "until", "event_id")


def _old_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they were: some absent, some with another status."""
    status = F.when(F.col("o_orderkey") % 10 == 0, "P").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").withColumn("o_orderstatus", status)


_OLD = "old AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 7 <> 0)"


@query("upsert", f"WITH {_OLD}, src AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0) SELECT * FROM src UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C1, C13]"""
    return H.upsert(_old_orders(spark, sf_dir), table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0"), ["o_orderkey"])


@query("upsert_some_columns", f"""
    WITH {_OLD}, src AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
    SELECT coalesce(old.o_orderkey, src.o_orderkey) AS o_orderkey, o_custkey, CASE WHEN src.o_orderkey IS NULL THEN old.o_orderstatus ELSE src.o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM old FULL JOIN src ON old.o_orderkey = src.o_orderkey
""")  # fmt: skip
def upsert_some_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C1] A source with fewer columns keeps the target's others."""
    return H.upsert(_old_orders(spark, sf_dir), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


@query("snapshot_diff", f"""
    WITH {_OLD} SELECT n.*, CASE WHEN old.o_orderkey IS NULL THEN 'insert' ELSE 'update_postimage' END AS _change_type FROM orders n LEFT JOIN old ON old.o_orderkey = n.o_orderkey
    WHERE old.o_orderkey IS NULL OR old.o_orderstatus IS DISTINCT FROM n.o_orderstatus
""")  # fmt: skip
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C5]"""
    return H.diff(_old_orders(spark, sf_dir), table(spark, sf_dir, "orders"), ["o_orderkey"])


@query("incremental_read", f"WITH {_OLD} SELECT n.* FROM orders n LEFT JOIN old ON old.o_orderkey = n.o_orderkey WHERE old.o_orderkey IS NULL OR old.o_orderstatus IS DISTINCT FROM n.o_orderstatus")
def incremental_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C6] Version 2 of a table of which version 1 was seen."""
    return H.incremental_or_full(table(spark, sf_dir, "orders"), _old_orders(spark, sf_dir), ["o_orderkey"], 2, 1)


@query("incremental_merge", """
    WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), lim AS (SELECT max(cast(o_orderdate AS DATE)) - 1 AS d FROM t),
    s AS (SELECT *, upper(o_orderstatus) || '!' AS note FROM orders WHERE cast(o_orderdate AS DATE) >= (SELECT d FROM lim))
    SELECT *, NULL AS note FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s
""")  # fmt: skip
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C15] Rows from the day before the last one on, with a new column."""
    orders = table(spark, sf_dir, "orders")
    target = orders.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return H.incremental_merge(target, orders.withColumn("note", F.concat(F.upper("o_orderstatus"), F.lit("!"))), ["o_orderkey"], "o_orderdate")


@query("snapshot_check", f"""
    WITH {_OLD}, c AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
    x AS (SELECT c.*, old.o_orderkey IS NOT NULL AS known, old.o_orderstatus IS DISTINCT FROM c.o_orderstatus AS changed FROM c LEFT JOIN old ON old.o_orderkey = c.o_orderkey),
    a AS (SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN x.changed THEN TIMESTAMP '2024-02-01' END AS valid_to FROM old o LEFT JOIN x ON x.o_orderkey = o.o_orderkey),
    b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, TIMESTAMP '2024-02-01' AS valid_from, cast(NULL AS TIMESTAMP) AS valid_to FROM x WHERE NOT known OR changed)
    SELECT *, md5(cast(o_orderkey AS VARCHAR) || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')) AS row_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")  # fmt: skip
def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C4]"""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    at = lambda t: F.lit(t).cast("timestamp")
    first = H.snapshot(_old_orders(spark, sf_dir).select(columns), None, "o_orderkey", ["o_orderstatus"], at("2024-01-01"))
    second = H.snapshot(table(spark, sf_dir, "orders").select(columns), first, "o_orderkey", ["o_orderstatus"], at("2024-02-01"))
    return second.withColumns({"valid_from": ntz("valid_from"), "valid_to": ntz("valid_to")})


@query("pipeline_checkpoints", "SELECT event_type AS pipeline, max(event_id) AS version, max(ts) AS saved_at FROM events GROUP BY 1")
def pipeline_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C7] A checkpoint table after the runs of an earlier and a later part."""
    events = table(spark, sf_dir, "events")
    of = lambda df: df.groupBy(F.col("event_type").alias("pipeline")).agg(F.max("event_id").alias("version"), F.max("ts").alias("saved_at"))
    early = events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return H.save_checkpoint(of(early), of(events))


@query("aligned_schema", "SELECT *, cast(NULL AS VARCHAR) AS segment, cast(NULL AS INTEGER) AS tier FROM region")
def aligned_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C14, C16] Columns added to meet a declared schema, then the contract is enforced."""
    from pyspark.sql import types as T

    region = table(spark, sf_dir, "region")
    declared = T.StructType([*region.schema.fields, T.StructField("segment", T.StringType()), T.StructField("tier", T.IntegerType())])
    return H.enforce(H.align(region, declared), declared)


@query("snapshot_union", "SELECT o_orderkey, 'orders' AS side FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey, 'items' FROM lineitem WHERE l_returnflag = 'R'")
def snapshot_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[U1, U2, U3]"""
    from ..operators.rows import union_by_name

    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("orders").alias("side"))
    b = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.lit("items").alias("side"), F.col("l_orderkey").alias("o_orderkey"))
    return union_by_name(a, b).distinct()
