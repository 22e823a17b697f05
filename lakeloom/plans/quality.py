"""Data quality over the tables."""

from __future__ import annotations

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import validators as V
from ..operators.joins import orphans
from ..operators.rows import duplicate_keys
from .base import ntz, query, table
from .history import _SCD2, event_history


def item_rules() -> list[R.Rule]:
    return [
        R.Rule("keys_present", F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull(), "fail"),
        R.Rule("quantity_in_range", F.col("l_quantity").between(1, 45), "warn"),
        R.Rule("flag_known", F.col("l_returnflag").isin("A", "N"), "drop"),
        R.Rule("mostly_cheap", F.col("l_extendedprice") < 90_000, "fail", 0.95),
        R.Rule("tax_text", F.col("l_tax").cast("string").rlike(r"^\d+(\.\d+)?$"), "warn", 0.95),
    ]


@query("expect_drop", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE coalesce(l_returnflag IN ('A', 'N'), false)")
def expect_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q1, Q2, Q3] Warned rows stay, dropped ones go; a failing rule would stop the job."""
    rules = [r for r in item_rules() if r.mostly == 1.0]
    return R.expect(table(spark, sf_dir, "lineitem"), rules).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("rule_report", """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT (l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL)) AS a, count(*) FILTER (WHERE NOT coalesce(l_quantity BETWEEN 1 AND 45, false)) AS b,
               count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)) AS c, count(*) FILTER (WHERE NOT coalesce(l_extendedprice < 90000, false)) AS d, count(*) FILTER (WHERE l_tax IS NULL) AS e FROM lineitem)
    SELECT 'keys_present' AS rule, 'fail' AS severity, n AS "rows", a AS broken, a = 0 AS passed FROM c UNION ALL SELECT 'quantity_in_range', 'warn', n, b, b = 0 FROM c
    UNION ALL SELECT 'flag_known', 'drop', n, c, c = 0 FROM c UNION ALL SELECT 'mostly_cheap', 'fail', n, d, d <= n * 0.05 + 1e-9 FROM c UNION ALL SELECT 'tax_text', 'warn', n, e, e <= n * 0.05 + 1e-9 FROM c
""")  # fmt: skip
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q4, Q5, Q6, Q9, Q10, Q11] All rules in one pass."""
    return R.report(table(spark, sf_dir, "lineitem"), item_rules())


@query("standings_report", """
    WITH s AS (SELECT l_suppkey, l_linenumber AS position, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(position BETWEEN 1 AND 25, false)) AS b FROM s)
    SELECT 'position_in_range' AS rule, 'fail' AS severity, n AS "rows", b AS broken, b = 0 AS passed FROM c
""")  # fmt: skip
def standings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q7]"""
    standings = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return R.report(standings, [R.Rule("position_in_range", F.col("position").between(1, 25), "fail")])


@query("key_uniqueness", """
    SELECT cast(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_keys, count(*) / sum(n) AS unique_share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
""")  # fmt: skip
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q9, Q10]"""
    return R.uniqueness(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("duplicate_event_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A23, W12]"""
    return duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("source_freshness", """
    SELECT epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) / 3600.0 AS age_hours, 'x' AS status FROM events
""".replace("'x' AS status", "CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) / 3600.0 > 24 THEN 'error' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) / 3600.0 > 12 THEN 'warn' ELSE 'pass' END AS status").replace("max(ts)", "date_trunc('second', max(ts))"))  # fmt: skip
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q12]"""
    return R.freshness(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31").cast("timestamp"))


@query("layer_row_loss", """
    WITH b AS (SELECT count(*) AS before FROM lineitem), a AS (SELECT count(*) AS after FROM lineitem WHERE l_quantity < 50)
    SELECT before, after, (before - after) / before AS loss, (before - after) / before < 0.001 AS passed FROM a, b
""")  # fmt: skip
def layer_row_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q13]"""
    items = table(spark, sf_dir, "lineitem")
    return R.row_loss(items, items.filter("l_quantity < 50"))


@query("history_integrity", f"""
    WITH {_SCD2}, k AS (SELECT user_id, count(*) FILTER (WHERE valid_to IS NULL) AS open, count(*) FILTER (WHERE valid_from >= valid_to) AS reversed FROM h GROUP BY 1)
    SELECT count(*) AS keys, count(*) FILTER (WHERE open <> 1) AS not_one_open, cast(sum(reversed) AS BIGINT) AS reversed FROM k
""")  # fmt: skip
def history_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q14]"""
    return R.history_report(event_history(spark, sf_dir), ["user_id"])


_RESULTS = """
    r AS (SELECT CASE WHEN l_suppkey % 40 = 0 THEN NULL ELSE l_suppkey END AS driver_id, year(o_orderdate) AS season, month(o_orderdate) AS round, l_quantity AS points, l_extendedprice / 300 AS fastest_lap_seconds,
          CASE l_returnflag WHEN 'A' THEN 'FINISHED' WHEN 'R' THEN 'OTHER' ELSE 'LOST' END AS status_category FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""


@query("result_validation", f"""
    WITH {_RESULTS}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE driver_id IS NULL) AS d, count(*) FILTER (WHERE season IS NULL) AS s, count(*) FILTER (WHERE round IS NULL) AS r, count(*) FILTER (WHERE points NOT BETWEEN 0 AND 26) AS p,
        count(*) FILTER (WHERE fastest_lap_seconds NOT BETWEEN 60 AND 300) AS f, count(*) FILTER (WHERE status_category = 'LOST') AS l FROM r),
    x AS (SELECT 'driver_id given' AS rule, 'warn' AS severity, n AS "rows", d AS broken FROM c UNION ALL SELECT 'driver_id present', 'fail', n, d FROM c UNION ALL SELECT 'season present', 'fail', n, s FROM c UNION ALL SELECT 'round present', 'fail', n, r FROM c
        UNION ALL SELECT 'points 0 to 26', 'fail', n, p FROM c UNION ALL SELECT 'fastest lap 60 to 300 s', 'warn', n, f FROM c UNION ALL SELECT 'category known', 'fail', n, l FROM c)
    SELECT *, broken = 0 AS passed FROM x
""")  # fmt: skip
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q4, Q5] The rules of race results, and of their keys, in one pass."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    category = F.when(F.col("l_returnflag") == "A", "FINISHED").when(F.col("l_returnflag") == "R", "OTHER").otherwise("LOST")
    found = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.when(F.col("l_suppkey") % 40 != 0, F.col("l_suppkey")).alias("driver_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round"),
        F.col("l_quantity").alias("points"), (F.col("l_extendedprice") / 300).alias("fastest_lap_seconds"), category.alias("status_category"),
    )
    return R.report(found, V.key_rules(found, ["driver_id", "absent"]) + V.result_rules(found))


@query("lap_validation", """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_orderkey IS NULL) AS s, count(*) FILTER (WHERE l_suppkey IS NULL) AS d, count(*) FILTER (WHERE l_linenumber IS NULL) AS k,
        count(*) FILTER (WHERE l_linenumber <> 1 AND l_extendedprice / 300 NOT BETWEEN 50 AND 300) AS t, count(*) FILTER (WHERE l_returnflag = 'N') AS u FROM lineitem),
    x AS (SELECT 'session_key present' AS rule, 'fail' AS severity, n, s AS broken FROM c UNION ALL SELECT 'driver_number present', 'fail', n, d FROM c UNION ALL SELECT 'lap_number present', 'fail', n, k FROM c
        UNION ALL SELECT 'lap outside the pit 50 to 300 s', 'warn', n, t FROM c UNION ALL SELECT 'compound known', 'warn', n, u FROM c)
    SELECT 'laps' AS input, rule, severity, n AS "rows", broken, broken = 0 AS passed FROM x UNION ALL SELECT 'no laps', rule, severity, 0, 0, true FROM x
""")  # fmt: skip
def lap_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q6] The rules of laps, and the same over no laps, which pass."""
    compound = F.when(F.col("l_returnflag") == "A", "SOFT").when(F.col("l_returnflag") == "R", "WET").when(F.col("l_returnflag") == "N", "SQUARE")
    laps = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_key"), F.col("l_suppkey").alias("driver_number"), F.col("l_linenumber").alias("lap_number"), (F.col("l_extendedprice") / 300).alias("lap_duration_seconds"),
        (F.col("l_linenumber") == 1).alias("is_pit_out_lap"), compound.alias("compound"),
    )
    parts = [R.report(df, V.lap_rules(df)).select(F.lit(name).alias("input"), "rule", "severity", "rows", "broken", "passed") for name, df in (("laps", laps), ("no laps", laps.filter("session_key < 0")))]
    return parts[0].unionByName(parts[1])


@query("standings_validation", """
    WITH s AS (SELECT year(o_orderdate) AS season, o_custkey AS driver_id, cast(o_orderkey % 30 AS INTEGER) AS current_position FROM orders),
    d AS (SELECT count(*) AS k FROM (SELECT season, driver_id FROM s GROUP BY 1, 2 HAVING count(*) > 1)), b AS (SELECT count(*) AS n, count(*) FILTER (WHERE current_position NOT BETWEEN 1 AND 25) AS b FROM s)
    SELECT 'position 1 to 25' AS rule, 'fail' AS severity, n AS "rows", b AS broken, b = 0 AS passed FROM b UNION ALL SELECT 'one row for each season, driver_id', 'fail', n, k, k = 0 FROM b, d
""")  # fmt: skip
def standings_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q7] Positions in range and unique keys, in one report."""
    found = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_custkey").alias("driver_id"), (F.col("o_orderkey") % 30).cast("int").alias("current_position"))
    return V.report_with_key(found, V.standings_rules(found), V.standings_key(found))


@query("history_checks", f"""
    WITH {_SCD2}, all_rows AS (SELECT user_id, valid_from, CASE WHEN user_id % 50 = 0 THEN valid_to + INTERVAL 1 DAY ELSE valid_to END AS valid_to, md5(cast(user_id AS VARCHAR) || '|' || cast(event_id % 5000 AS VARCHAR)) AS row_id FROM h),
    checked AS (SELECT *, coalesce(bool_or(valid_to IS NULL) OVER w, false) OR coalesce(valid_from < max(valid_to) OVER w, false) AS overlap FROM all_rows
        WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, valid_to NULLS LAST, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE valid_to IS NULL) AS open, count(*) FILTER (WHERE valid_from >= valid_to) AS rev, count(*) FILTER (WHERE overlap) AS ov FROM checked GROUP BY 1),
    r AS (SELECT cast(sum(n) AS BIGINT) AS versions, count(*) FILTER (WHERE open <> 1) AS not_one_open, cast(sum(rev) AS BIGINT) AS reversed, cast(sum(ov) AS BIGINT) AS overlapping, (SELECT count(*) FROM (SELECT row_id FROM all_rows GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM k)
    SELECT *, not_one_open + reversed + overlapping + repeated_ids = 0 AS passed FROM r
""")  # fmt: skip
def history_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q14] All checks of a type 2 history in one row; some users' versions are made to overlap."""
    end = F.when(F.col("user_id") % 50 == 0, F.col("valid_to") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to"))
    row_id = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), (F.col("event_id") % 5000).cast("string")))
    rows = event_history(spark, sf_dir).select("user_id", "valid_from", end.alias("valid_to"), row_id.alias("row_id"))
    return R.integrity_report(rows, ["user_id"], "row_id")


@query("expectation_counts", """
    SELECT 'quantity_in_range' AS rule, 'warn' AS severity, count(*) FILTER (WHERE NOT coalesce(l_quantity BETWEEN 1 AND 45, false)) AS broken, count(*) AS rows_after, false AS stopped FROM lineitem
    UNION ALL SELECT 'flag_known', 'drop', count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)), count(*) FILTER (WHERE coalesce(l_returnflag IN ('A', 'N'), false)), false FROM lineitem
    UNION ALL SELECT 'cheap', 'fail', count(*) FILTER (WHERE NOT coalesce(l_extendedprice < 50000, false)), 0, true FROM lineitem
""")  # fmt: skip
def expectation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q1, Q2, Q3] What each kind of expectation does: rows broken, observed on the way of one job a rule; rows left; and whether the run stopped."""
    items, lines = table(spark, sf_dir, "lineitem"), []
    for rule in (R.Rule("quantity_in_range", F.col("l_quantity").between(1, 45)), R.Rule("flag_known", F.col("l_returnflag").isin("A", "N"), "drop")):
        seen = Observation()
        left = R.expect(items, [rule], seen).count()
        lines.append((rule.name, rule.severity, seen.get[rule.name], left, False))
    strict = R.Rule("cheap", F.col("l_extendedprice") < 50_000, "fail")
    broken = R.report(items, [strict]).head()["broken"]
    try:
        lines.append((strict.name, strict.severity, broken, R.expect(items, [strict]).count(), False))
    except SparkRuntimeException as e:
        if e.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        lines.append((strict.name, strict.severity, broken, 0, True))
    return spark.createDataFrame(lines, "rule string, severity string, broken long, rows_after long, stopped boolean")


@query("value_coverage", """
    SELECT 'event_type' AS "column", count(DISTINCT event_type) AS distinct_values, 5::BIGINT AS expected, count(DISTINCT event_type) = 5 AS passed FROM events
    UNION ALL SELECT 'hour', count(DISTINCT hour(ts)), 24, count(DISTINCT hour(ts)) = 24 FROM events UNION ALL SELECT 'weekday', count(DISTINCT dayofweek(ts)), 7, count(DISTINCT dayofweek(ts)) = 7 FROM events
""")  # fmt: skip
def value_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q15]"""
    events = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("weekday"))
    return R.coverage(events, {"event_type": 5, "hour": 24, "weekday": 7})


@query("unknown_parts", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def unknown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J17, Q10] The relationships test."""
    found = orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size < 40"), "l_partkey", "p_partkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


@query("table_audit", "SELECT 'orders' AS \"table\", count(*) AS \"rows\", 6 AS columns, max(o_orderdate) AS latest FROM orders UNION ALL SELECT 'events', count(*), 6, max(ts) FROM events")
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q16, C13]"""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    one = lambda df, name, at: R.table_stats(df, name).join(df.agg(ntz(F.max(at)).alias("latest")))
    return one(orders, "orders", "o_orderdate").unionByName(one(events, "events", "ts"))
