"""Staging, enrichment, star schema and marts; orders stand for trips, nations for zones, regions for boroughs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_part, minute_boundaries, safe_divide, surrogate_key, weekday_name, weekday_number, year_month
from ..operators.joins import orphans, role_join
from ..operators.rows import first_rows, union_by_name
from ..operators.rules import reconcile
from .base import ntz, query, table, total
from .streams import work_folder


@query("staged_trips", """
    SELECT md5(concat_ws('-', coalesce(cast(event_type AS VARCHAR), '_null_'), coalesce(cast(user_id AS VARCHAR), '_null_'))) AS trip_key, event_id, event_type, user_id, ts, strftime(ts, '%Y-%m-%d') AS pickup_date,
           upper(trim(event_type)) AS flag, coalesce(value, 0) AS fare
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events WHERE value > 1) WHERE rn = 1
""")  # fmt: skip
def staged_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P8, W2, X8] The first row loaded of each composite key, cleaned."""
    events = table(spark, sf_dir, "events").filter("value > 1").withColumn("hour", F.date_trunc("hour", "ts"))
    first = first_rows(events, ["event_type", "user_id", "hour"], [F.asc("ts"), F.asc("event_id")])
    return first.select(
        surrogate_key("event_type", "user_id").alias("trip_key"), "event_id", "event_type", "user_id", "ts", F.to_date("ts").cast("string").alias("pickup_date"),
        F.upper(F.trim("event_type")).alias("flag"), F.coalesce("value", F.lit(0.0)).alias("fare"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P9, J11] Items with both nations, weekday, time of day and flags."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    zones = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    joined = role_join(base, zones, "n_nationkey", {"c_nationkey": "pickup", "s_nationkey": "dropoff"}, {"n_name": "zone", "r_name": "borough"})
    hour = (F.col("l_orderkey") % 24).cast("int")
    return joined.select(
        "l_orderkey", "l_linenumber", "c_nationkey", "pickup_zone", "pickup_borough", "dropoff_zone", "dropoff_borough", "o_orderdate", hour.alias("pickup_hour"),
        weekday_number("o_orderdate").alias("weekday"), weekday_name("o_orderdate").alias("day_name"), day_part(hour).alias("time_of_day"),
        F.coalesce(F.col("pickup_zone").isin("FRANCE", "GERMANY", "NATION_1") | F.col("dropoff_zone").isin("FRANCE", "GERMANY", "NATION_1"), F.lit(False)).alias("is_airport"),
        "l_returnflag", "l_quantity", "l_extendedprice", "l_tax", F.round(safe_divide("l_discount", "l_tax"), 6).alias("tip_pct"),
    )


_TRIPS = """
    WITH z AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    t AS (SELECT l_orderkey, l_linenumber, c_nationkey, p.n_name AS pickup_zone, p.r_name AS pickup_borough, d.n_name AS dropoff_zone, d.r_name AS dropoff_borough, o_orderdate,
                 cast(l_orderkey % 24 AS INTEGER) AS pickup_hour, cast(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, dayname(o_orderdate) AS day_name,
                 CASE WHEN l_orderkey % 24 BETWEEN 6 AND 9 THEN 'morning_rush' WHEN l_orderkey % 24 BETWEEN 10 AND 15 THEN 'midday' WHEN l_orderkey % 24 BETWEEN 16 AND 19 THEN 'evening_rush'
                      WHEN l_orderkey % 24 BETWEEN 20 AND 22 THEN 'evening' ELSE 'overnight' END AS time_of_day,
                 coalesce(p.n_name IN ('FRANCE', 'GERMANY', 'NATION_1') OR d.n_name IN ('FRANCE', 'GERMANY', 'NATION_1'), false) AS is_airport,
                 l_returnflag, l_quantity, l_extendedprice, l_tax, round(CASE WHEN l_tax IS NULL OR l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS tip_pct
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
          LEFT JOIN z p ON c_nationkey = p.n_nationkey LEFT JOIN z d ON s_nationkey = d.n_nationkey)
"""


@query("enriched_trips", _TRIPS + "SELECT * FROM t")
def enriched_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir)


@query("hourly_demand", _TRIPS + """
    SELECT pickup_hour, weekday, day_name, time_of_day, count(*) AS trip_count, round(avg(l_quantity), 4) AS avg_distance, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_fare,
           round(count(*) FILTER (WHERE is_airport) / count(*), 6) AS pct_airport, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS pct_card,
           count(DISTINCT o_orderdate) AS distinct_days, round(count(*) / count(DISTINCT o_orderdate), 6) AS avg_trips_per_day
    FROM t GROUP BY 1, 2, 3, 4
""")  # fmt: skip
def hourly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A16, J14] Hour by weekday; the days of a slot are counted in the same aggregation, so no join back is needed."""
    n = F.count(F.lit(1))
    share = lambda c: F.round(safe_divide(F.count_if(c), n), 6)
    return trips(spark, sf_dir).groupBy("pickup_hour", "weekday", "day_name", "time_of_day").agg(
        n.alias("trip_count"), F.round(F.avg("l_quantity"), 4).alias("avg_distance"), safe_divide(total("l_extendedprice"), n).alias("avg_fare"),
        share(F.col("is_airport")).alias("pct_airport"), share(F.col("l_returnflag") == "R").alias("pct_card"),
        F.count_distinct("o_orderdate").alias("distinct_days"), F.round(safe_divide(n, F.count_distinct("o_orderdate")), 6).alias("avg_trips_per_day"),
    )


def date_dimension(spark: SparkSession, first: str, end: str) -> DataFrame:
    """[P11, X10] One row a day from ``first`` to the day before ``end``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("date_day"))
    d = F.col("date_day")
    return days.select(
        d, F.year(d).alias("year"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.dayofweek(d).alias("weekday"),
        weekday_name(d).alias("day_name"), F.dayofyear(d).alias("day_of_year"), F.weekofyear(d).alias("week_of_year"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), year_month(d).alias("year_month"),
    )


@query("order_dates", """
    SELECT strftime(d, '%Y-%m-%d') AS date_day, cast(year(d) AS INTEGER) AS year, cast(month(d) AS INTEGER) AS month, monthname(d) AS month_name, cast(quarter(d) AS INTEGER) AS quarter, cast(dayofweek(d) + 1 AS INTEGER) AS weekday,
           dayname(d) AS day_name, cast(dayofyear(d) AS INTEGER) AS day_of_year, cast(weekofyear(d) AS INTEGER) AS week_of_year, dayofweek(d) IN (0, 6) AS is_weekend, strftime(d, '%Y-%m') AS year_month,
           (SELECT count(*) FROM orders WHERE cast(o_orderdate AS DATE) = cast(d AS DATE)) AS n_orders
    FROM range(TIMESTAMP '1992-01-01', TIMESTAMP '2004-01-01', INTERVAL 1 DAY) r(d)
""")  # fmt: skip
def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P11, J13] The date dimension with each day's orders."""
    counts = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date_day")).agg(F.count(F.lit(1)).alias("n"))
    return date_dimension(spark, "1992-01-01", "2004-01-01").join(counts, "date_day", "left").withColumn("n_orders", F.coalesce("n", F.lit(0))).drop("n").withColumn("date_day", F.col("date_day").cast("string"))


@query("zone_month_revenue", _TRIPS + """
    SELECT c_nationkey, pickup_zone, pickup_borough, strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS trip_count, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_fare,
           round(avg(l_quantity), 4) AS avg_distance, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS fare_per_trip, round(avg(tip_pct), 4) AS avg_tip_pct,
           count(*) FILTER (WHERE is_airport) AS airport_trips, count(*) FILTER (WHERE l_returnflag = 'A') AS card_trips, count(*) FILTER (WHERE l_returnflag = 'R') AS cash_trips
    FROM t WHERE o_orderdate >= TIMESTAMP '1992-01-01' AND o_orderdate < TIMESTAMP '2004-01-01' GROUP BY 1, 2, 3, 4
""")  # fmt: skip
def zone_month_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A17, J13] Zone by month, days of the date dimension only."""
    return zone_months(spark, trips(spark, sf_dir))


def zone_months(spark: SparkSession, rides: DataFrame) -> DataFrame:
    dates = date_dimension(spark, "1992-01-01", "2004-01-01").select("date_day", "year_month")
    joined = rides.join(dates, F.to_date("o_orderdate") == F.col("date_day"))
    n = F.count(F.lit(1))
    return joined.groupBy("c_nationkey", "pickup_zone", "pickup_borough", "year_month").agg(
        n.alias("trip_count"), total("l_extendedprice").alias("total_fare"), F.round(F.avg("l_quantity"), 4).alias("avg_distance"),
        safe_divide(total("l_extendedprice"), n).alias("fare_per_trip"), F.round(F.avg("tip_pct"), 4).alias("avg_tip_pct"),
        F.count_if("is_airport").alias("airport_trips"), F.count_if(F.col("l_returnflag") == "A").alias("card_trips"), F.count_if(F.col("l_returnflag") == "R").alias("cash_trips"),
    )


@query("zone_flags", "SELECT n_nationkey AS zone_id, n_name AS zone, r_name AS borough, n_name LIKE '%A%' AS is_airport, r_name = 'EUROPE' AS is_central FROM nation JOIN region ON n_regionkey = r_regionkey")
def zone_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P10]"""
    zones = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return zones.select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone"), F.col("r_name").alias("borough"), F.col("n_name").contains("A").alias("is_airport"), (F.col("r_name") == "EUROPE").alias("is_central"))


@query("zone_coverage", """
    SELECT 'customer' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')
    UNION ALL SELECT 'part' AS side, p_partkey AS id FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity = 1) ON l_partkey = p_partkey WHERE l_partkey IS NULL
""")  # fmt: skip
def zone_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J17, U1, Q11] Keys that no fact of a kind uses, of two sides."""
    a = orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"))
    b = orphans(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").filter("l_quantity = 1"), "p_partkey", "l_partkey").select(F.lit("part").alias("side"), F.col("p_partkey").alias("id"))
    return union_by_name(a, b)


@query("revenue_reconciliation", _TRIPS + """
    SELECT cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS fact_total, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS mart_total, 0.0::DOUBLE AS distance, true AS passed FROM t
""")  # fmt: skip
def revenue_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A28] Fact and mart from the same joined rows, which are stored once."""
    path, joined = f"{work_folder(spark)}/trips", trips(spark, sf_dir)
    joined.write.parquet(path)
    rides = spark.read.schema(joined.schema).parquet(path)
    return reconcile(rides, zone_months(spark, rides), total("l_extendedprice"), total("total_fare"))


@query("trip_minutes", "SELECT a.user_id, a.event_id, a.ts, a.prev, date_diff('minute', prev, ts) AS minutes, cast(date_diff('day', prev, ts) AS INTEGER) AS days FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) a WHERE prev IS NOT NULL")
def trip_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X11] Minutes, counted by boundaries, and days since a user's event before."""
    from pyspark.sql import Window

    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = table(spark, sf_dir, "events").withColumn("prev", prev).filter("prev IS NOT NULL")
    return out.select("user_id", "event_id", "ts", ntz("prev").alias("prev"), minute_boundaries("prev", "ts").alias("minutes"), F.datediff("ts", "prev").alias("days"))
