"""Results, laps, stints and standings; an order stands for a race or session, a supplier for a driver, items for laps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_number, clock_seconds, gap_seconds, is_digits, status_category
from ..operators.joins import range_join
from ..operators.rows import best_flag, change_from_previous, gap_to_best, keep_top_entities
from .base import dealt, query, table, total

_RACE = "r AS (SELECT cast(year(o_orderdate) AS INTEGER) AS season, l_orderkey AS race, o_orderdate, l_suppkey AS driver, l_linenumber AS position, l_quantity AS points, l_extendedprice AS lap_ms, l_returnflag AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    items, orders = dealt(items.count(), (items, "l_orderkey"), (orders, "o_orderkey"))  # the count reads footers only
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.year("o_orderdate").alias("season"), F.col("l_orderkey").alias("race"), "o_orderdate", F.col("l_suppkey").alias("driver"), F.col("l_linenumber").alias("position"),
        F.col("l_quantity").alias("points"), F.col("l_extendedprice").alias("lap_ms"), F.col("l_returnflag").alias("status"),
    )


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each season, month and driver."""
    return results(spark, sf_dir).groupBy("season", F.month("o_orderdate").alias("round"), "driver").agg(F.sum("points").alias("points"), F.min("position").alias("best"))


_STANDINGS = f"WITH {_RACE}, s AS (SELECT season, cast(month(o_orderdate) AS INTEGER) AS round, driver, sum(points) AS points, min(position) AS best FROM r GROUP BY 1, 2, 3)"


@query("standings_gaps", _STANDINGS + """
    SELECT *, coalesce(lag(points) OVER (PARTITION BY season, driver ORDER BY round) - points, 0) AS change, max(points) OVER (PARTITION BY season, round) - points AS gap_to_leader,
           best - min(best) OVER (PARTITION BY season, round) AS gap_to_pole, coalesce(points = min(points) OVER (PARTITION BY season, driver), false) AS is_least FROM s
""")  # fmt: skip
def standings_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[W6, W7, W8, W9] Change to the round before, gaps to the leader and to pole, personal record."""
    df = change_from_previous(standings(spark, sf_dir), ["season", "driver"], [F.asc("round")], "points", "change")
    df = gap_to_best(df, ["season", "round"], "points", "gap_to_leader")
    df = gap_to_best(df, ["season", "round"], "best", "gap_to_pole", "min")
    return best_flag(df, ["season", "driver"], "points", "is_least")


@query("driver_championship", _STANDINGS + """,
    l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY season, driver ORDER BY round DESC) = 1),
    a AS (SELECT season, driver, count(*) FILTER (WHERE position <= 3) AS podiums, count(*) FILTER (WHERE status = 'R') AS dnfs, count(DISTINCT race) AS races FROM r GROUP BY 1, 2),
    b AS (SELECT season, driver, min(position) AS best_position FROM r GROUP BY 1, 2)
    SELECT l.season, l.driver, round AS latest_round, points, podiums, dnfs, races, best_position FROM l LEFT JOIN a USING (season, driver) LEFT JOIN b USING (season, driver)
""")  # fmt: skip
def driver_championship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A7, A8, A9, W4, J10] Latest standing of each driver with counts and best place."""
    podium, dnf = F.count_if(F.col("position") <= 3), F.count_if(F.col("status") == "R")
    # A race lies in one round, so that a driver's races add up over the rounds: one scan, aggregated step by step.
    entries = results(spark, sf_dir).groupBy("season", F.month("o_orderdate").alias("round"), "driver", "race").agg(F.sum("points").alias("points"), podium.alias("podiums"), dnf.alias("dnfs"), F.min("position").alias("best"))
    rounds = entries.groupBy("season", "driver", "round").agg(F.sum("points").alias("points"), *[F.sum(c).alias(c) for c in ("podiums", "dnfs")], F.count(F.lit(1)).alias("races"), F.min("best").alias("best"))
    return rounds.groupBy("season", "driver").agg(
        F.max("round").alias("latest_round"), F.max_by("points", "round").alias("points"), *[F.sum(c).alias(c) for c in ("podiums", "dnfs", "races")], F.min("best").alias("best_position")
    )


@query("constructor_championship", f"""
    WITH {_RACE}, t AS (SELECT season, cast(month(o_orderdate) AS INTEGER) AS round, s_nationkey AS team, points, position, race FROM r JOIN supplier ON s_suppkey = driver),
    g AS (SELECT season, round, team, sum(points) AS points FROM t GROUP BY 1, 2, 3),
    l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY season, team ORDER BY round DESC) = 1)
    SELECT l.season, l.team, round AS latest_round, l.points, podiums, wins FROM l LEFT JOIN (SELECT season, team, count(*) FILTER (WHERE position <= 3) AS podiums, count(*) FILTER (WHERE position = 1) AS wins FROM t GROUP BY 1, 2) a USING (season, team)
""")  # fmt: skip
def constructor_championship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A10]"""
    teams = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("driver"), F.col("s_nationkey").alias("team"))
    t = results(spark, sf_dir).join(teams, "driver").withColumn("round", F.month("o_orderdate"))
    rounds = t.groupBy("season", "round", "team").agg(F.sum("points").alias("points"), F.count_if(F.col("position") <= 3).alias("podiums"), F.count_if(F.col("position") == 1).alias("wins"))
    return rounds.groupBy("season", "team").agg(F.max("round").alias("latest_round"), F.max_by("points", "round").alias("points"), F.sum("podiums").alias("podiums"), F.sum("wins").alias("wins"))


@query("circuit_benchmarks", f"""
    WITH {_RACE}, c AS (SELECT r.*, driver % 20 AS circuit FROM r),
    lap AS (SELECT circuit, lap_ms AS record_ms, driver AS record_driver, season AS record_season FROM c QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY lap_ms, driver, race, position) = 1),
    win AS (SELECT circuit, driver AS last_winner FROM c WHERE position = 1 QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY o_orderdate DESC, race DESC, driver) = 1),
    n AS (SELECT circuit, count(DISTINCT race) AS races, min(lap_ms) AS best_ms FROM c GROUP BY 1)
    SELECT n.circuit, races, best_ms, record_ms, record_driver, record_season, last_winner FROM n LEFT JOIN lap USING (circuit) LEFT JOIN win USING (circuit)
""")  # fmt: skip
def circuit_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A11, W5] Records, who set them, and the last winner of each circuit."""
    c = results(spark, sf_dir).withColumn("circuit", F.col("driver") % 20)
    record = F.min(F.struct("lap_ms", "driver", "race", "position", "season"))
    won = F.when(F.col("position") == 1, F.struct("o_orderdate", "race", -F.col("driver")))
    # A task leaves one row a circuit; races are told apart on two narrow columns, and 20 rows meet 20.
    n = c.groupBy("circuit").agg(F.min("lap_ms").alias("best_ms"), record.alias("r"), F.max(F.when(won.isNotNull(), F.struct(won.alias("at"), "driver"))).alias("w"))
    races = c.select("circuit", "race").distinct().groupBy(F.col("circuit").alias("of")).agg(F.count("race").alias("races"))
    n = n.join(races, F.col("circuit").eqNullSafe(F.col("of")))
    return n.select("circuit", "races", "best_ms", F.col("r.lap_ms").alias("record_ms"), F.col("r.driver").alias("record_driver"), F.col("r.season").alias("record_season"), F.col("w.driver").alias("last_winner"))


@query("stint_pivot", """
    WITH laps AS (SELECT l_orderkey, l_suppkey % 3 + 1 AS stint, l_returnflag AS compound, count(*) AS laps FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_orderkey AS session, count(*) AS stints, cast(sum(laps) AS BIGINT) AS total_laps, max(CASE WHEN stint = 1 THEN compound END) AS compound_1, max(CASE WHEN stint = 2 THEN compound END) AS compound_2,
           max(CASE WHEN stint = 3 THEN compound END) AS compound_3, max(CASE WHEN stint = 1 THEN laps END) AS laps_1, max(CASE WHEN stint = 2 THEN laps END) AS laps_2, max(CASE WHEN stint = 3 THEN laps END) AS laps_3,
           string_agg(compound, ',' ORDER BY stint, compound) AS compounds
    FROM laps GROUP BY 1
""")  # fmt: skip
def stint_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A12, A13, A14, X19] Laps of each stint, then one row a session with up to three stints beside each other."""
    laps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session"), (F.col("l_suppkey") % 3 + 1).alias("stint"), F.col("l_returnflag").alias("compound")).agg(F.count(F.lit(1)).alias("laps"))
    pivot = [F.max(F.when(F.col("stint") == i, F.col(c))).alias(f"{c}_{i}") for c in ("compound", "laps") for i in (1, 2, 3)]
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("stint", "compound"))), lambda x: x["compound"])
    return laps.groupBy("session").agg(F.count(F.lit(1)).alias("stints"), F.sum("laps").alias("total_laps"), *pivot, F.array_join(in_order, ",").alias("compounds"))


@query("compound_usage", """
    WITH p AS (SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY l_linenumber) AS flags FROM lineitem GROUP BY 1)
    SELECT trim(f) AS compound, count(*) AS uses FROM (SELECT unnest(string_split(flags, ',')) AS f FROM p) GROUP BY 1
""")  # fmt: skip
def compound_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A25] Values of delimited lists, counted."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), ", ").alias("flags"))
    return lists.select(F.explode(F.split("flags", ",")).alias("f")).groupBy(F.trim("f").alias("compound")).agg(F.count(F.lit(1)).alias("uses"))


@query("laps_in_stints", """
    WITH s AS (SELECT user_id, event_id AS stint, ts AS starts_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - INTERVAL 1 MICROSECOND AS ends_at, value AS age_at_start FROM events WHERE event_type = 'signup'),
    p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'signup')
    SELECT p.event_id, p.user_id, p.ts, stint, starts_at, round(age_at_start + date_diff('day', starts_at, p.ts), 6) AS tyre_age
    FROM p LEFT JOIN s ON s.user_id = p.user_id AND p.ts >= starts_at AND p.ts <= coalesce(ends_at, TIMESTAMP '2024-12-31')
""")  # fmt: skip
def laps_in_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J6, J7, P7] Events within a user's interval, bins of a day added to the key; an age carried along."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.expr("INTERVAL 1 MICROSECOND")
    stints = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("stint"), F.col("ts").alias("starts_at"), F.coalesce(after, F.lit("2024-12-31").cast("timestamp_ntz")).alias("ends_at"), F.col("value").alias("age_at_start"))
    laps = events.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    joined = range_join(laps.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), stints.withColumn("a", F.unix_micros(F.col("starts_at").cast("timestamp"))).withColumn("b", F.unix_micros(F.col("ends_at").cast("timestamp"))), ["user_id"], "at", "a", "b", bin_width=86_400e6)
    age = F.when(F.col("age_at_start").isNotNull() & F.col("starts_at").isNotNull(), F.round(F.col("age_at_start") + F.datediff("ts", "starts_at"), 6))
    return joined.select("event_id", "user_id", "ts", "stint", "starts_at", age.alias("tyre_age"))


@query("session_races", """
    WITH d AS (SELECT user_id, min(substr(cast(ts AS VARCHAR), 1, 10)) AS session_date FROM events GROUP BY 1),
    s AS (SELECT strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') AS race_date, min(o_orderkey) AS race FROM orders GROUP BY 1)
    SELECT user_id, session_date, race FROM d LEFT JOIN s ON session_date = race_date
""")  # fmt: skip
def session_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A15, J8] Systems without a common key, joined by date."""
    dates = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.substring(F.col("ts").cast("string"), 1, 10)).alias("session_date"))
    races = table(spark, sf_dir, "orders").groupBy(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 28 YEAR"), "yyyy-MM-dd").alias("session_date")).agg(F.min("o_orderkey").alias("race"))
    return dates.join(races, "session_date", "left").select("user_id", "session_date", "race")


@query("results_with_schedule", """
    SELECT l_orderkey, l_linenumber, o_orderpriority, ps.p_brand FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT p_partkey, p_size, p_brand FROM part) ps ON l.l_partkey = ps.p_partkey AND cast(l.l_quantity AS INTEGER) = ps.p_size
""")  # fmt: skip
def results_with_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J2, J9] Left joins on several columns, clashing ones aliased away."""
    laps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("q"), "p_brand")
    return laps.join(orders, "l_orderkey", "left").join(parts, ["l_partkey", "q"], "left").select("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand")


@query("new_rounds", """
    SELECT season, round, driver, points FROM (SELECT cast(year(o_orderdate) AS INTEGER) AS season, cast(month(o_orderdate) AS INTEGER) AS round, l_suppkey AS driver, sum(l_quantity) AS points FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
    WHERE (season, round) IN (SELECT DISTINCT cast(year(o_orderdate) AS INTEGER), cast(month(o_orderdate) AS INTEGER) FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.98 FROM orders))
""")  # fmt: skip
def new_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P21] Rows of certain pairs: a semi join on the pair, not two separate filters."""
    orders = table(spark, sf_dir, "orders")
    most = orders.agg((F.max("o_totalprice") * 0.98).alias("most"))
    pairs = orders.join(F.broadcast(most), F.col("o_totalprice") > F.col("most")).select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round")).distinct()
    return standings(spark, sf_dir).join(pairs, ["season", "round"], "left_semi").select("season", "round", "driver", "points")


@query("qualifying_best", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS q3, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice + 1 END, o_totalprice + 2) AS best,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'Q3' WHEN o_orderkey % 3 <> 0 THEN 'Q2' ELSE 'Q1' END AS session_reached
    FROM orders
""")  # fmt: skip
def qualifying_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P6] The last session reached counts."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 != 0, p).alias("q3"), F.when(k % 3 != 0, p + 1).alias("q2"), (p + 2).alias("q1"))
    reached = F.when(F.col("q3").isNotNull(), "Q3").when(F.col("q2").isNotNull(), "Q2").otherwise("Q1")
    return q.select("o_orderkey", "q3", F.coalesce("q3", "q2", "q1").alias("best"), reached.alias("session_reached"))


@query("typed_results", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 60 END AS place, cast(floor(o_totalprice / 60) AS BIGINT) % 60 * 60 + cast(o_totalprice AS BIGINT) % 60 + 0.5 AS race_s,
           CASE WHEN o_orderkey % 4 = 0 THEN 0.0 WHEN o_orderkey % 4 = 1 THEN NULL ELSE (o_orderkey % 90) + 0.25 END AS gap_s,
           CASE o_orderkey % 6 WHEN 0 THEN 'FINISHED' WHEN 1 THEN 'FINISHED' WHEN 2 THEN 'DISQUALIFIED' WHEN 3 THEN 'RETIRED_MECHANICAL' WHEN 4 THEN 'RETIRED_ACCIDENT' ELSE 'DID_NOT_START' END AS status,
           o_orderkey % 7 <> 0 AS has_digits
    FROM orders
""")  # fmt: skip
def typed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P5, X1, X2, X3, X4, X5] Text as an interface gives it, read back to types."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    status = F.element_at(F.array(*[F.lit(x) for x in ("Finished", "+2 Laps", "Disqualified", "Power Unit failure", "Collision damage", "Did not qualify")]), (k % 6 + 1).cast("int"))
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, "None").otherwise((k % 60).cast("string")).alias("place"),
        F.concat((F.floor(price / 60) % 60).cast("string"), F.lit(":"), (F.bround(price, 0).cast("long") % 60).cast("string"), F.lit(".5")).alias("race"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "+1 Lap").otherwise(F.concat(F.lit("+"), (k % 90).cast("string"), F.lit(".25"))).alias("gap"), status.alias("status"),
    )
    return raw.select("o_orderkey", clean_number("place", "bigint").alias("place"), clock_seconds("race").alias("race_s"), gap_seconds("gap").alias("gap_s"), status_category("status").alias("status"), is_digits("place").alias("has_digits"))


#: Columns of typed race results, in order.
RESULT_COLUMNS = (
    "season", "round", "circuit_id", "race_name", "race_date", "driver_id", "driver_code", "driver_number", "constructor_id", "grid_position", "final_position", "is_classified",
    "status", "status_category", "points", "laps_completed", "race_time_seconds", "gap_to_winner_seconds", "fastest_lap_rank", "fastest_lap_seconds", "fastest_lap_speed_kph", "ingested_at", "source_name",
)


def typed_race_results(raw: DataFrame, schedule: DataFrame) -> DataFrame:
    """[P5, J2] Results as text, typed, with the circuit, name and date of their race; what can't be read is null."""
    # The whole numbers are read as one array: all parsers written out in one loop are a method too long for the JVM to compile.
    numbers = ("season", "round", "driver_number", "grid_position", "final_position", "laps_completed", "fastest_lap_rank")
    whole = {c: F.get("_whole", F.lit(i)).alias(c) for i, c in enumerate(numbers)}
    other = {
        "race_date": F.try_to_timestamp("race_date", F.lit("yyyy-MM-dd")).cast("date"), "is_classified": is_digits("position_text"), "status_category": status_category(F.coalesce("status", F.lit(""))), "points": F.col("points").try_cast("double"),
        "race_time_seconds": clock_seconds("race_time"), "gap_to_winner_seconds": gap_seconds("race_time"), "fastest_lap_seconds": clock_seconds("fastest_lap_time"), "fastest_lap_speed_kph": F.col("fastest_lap_speed").try_cast("double"),
    }
    read = F.transform(F.array(*[F.col(c).cast("string") for c in numbers]), lambda x: clean_number(x, "int"))
    joined = raw.join(schedule, ["season", "round"], "left").select(read.alias("_whole"), *[other[c].alias(c) if c in other else F.col(c) for c in RESULT_COLUMNS if c not in numbers])
    return joined.select(*[whole.get(c, F.col(c)) for c in RESULT_COLUMNS])


@query("typed_race_results", """
    WITH s AS (SELECT year(o_orderdate) AS season, month(o_orderdate) AS round, min(o_orderpriority) AS race_name, min(o_custkey) AS c, min(cast(o_orderdate AS DATE)) AS race_date FROM orders GROUP BY 1, 2)
    SELECT cast(s.season AS INTEGER) AS season, cast(s.round AS INTEGER) AS round, 'c' || c AS circuit_id, race_name, strftime(race_date, '%Y-%m-%d') AS race_date, 'd' || l_suppkey AS driver_id, 'D' || l_suppkey % 10 AS driver_code, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE cast(l_suppkey AS INTEGER) END AS driver_number,
        't' || l_suppkey % 10 AS constructor_id, cast(l_linenumber AS INTEGER) AS grid_position, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE cast(l_linenumber AS INTEGER) END AS final_position, l_orderkey % 7 <> 0 AS is_classified,
        CASE l_returnflag WHEN 'A' THEN '+1 Lap' WHEN 'R' THEN 'Gearbox' ELSE 'Retired' END AS status, CASE l_returnflag WHEN 'A' THEN 'FINISHED' WHEN 'R' THEN 'RETIRED_MECHANICAL' ELSE 'OTHER' END AS status_category, cast(l_quantity AS DOUBLE) AS points, cast(l_quantity AS INTEGER) AS laps_completed,
        CASE WHEN l_orderkey % 4 = 0 THEN 3600.0 + 60 * (l_partkey % 60) + 5.5 END AS race_time_seconds, CASE l_orderkey % 4 WHEN 2 THEN l_partkey % 90 + 0.25 WHEN 3 THEN 0.0 END AS gap_to_winner_seconds,
        CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE cast(l_linenumber AS INTEGER) END AS fastest_lap_rank, CASE WHEN l_orderkey % 3 <> 0 THEN 60.0 + l_partkey % 60 + 0.5 END AS fastest_lap_seconds, CASE WHEN l_orderkey % 3 = 1 THEN 200.0 + l_suppkey % 50 END AS fastest_lap_speed_kph, '2024-02-01' AS ingested_at, 'api' AS source_name
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN s ON s.season = year(o_orderdate) AND s.round = month(o_orderdate)
""")  # fmt: skip
def all_typed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P5] All 23 columns, from text as an interface gives it."""
    orders = table(spark, sf_dir, "orders").withColumns({"season": F.year("o_orderdate").cast("string"), "round": F.month("o_orderdate").cast("string")})
    schedule = orders.groupBy("season", "round").agg(F.concat(F.lit("c"), F.min("o_custkey").cast("string")).alias("circuit_id"), F.min("o_orderpriority").alias("race_name"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("race_date"))
    k, part, driver = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    line, laps = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    time = F.when(k % 4 == 0, text("1:", F.lpad((part % 60).cast("string"), 2, "0"), ":05.500")).when(k % 4 == 1, "+1 Lap").when(k % 4 == 2, text("+", part % 90, ".25")).otherwise("")
    raw = table(spark, sf_dir, "lineitem").join(orders, k == F.col("o_orderkey")).select(
        "season", "round", text("d", driver).alias("driver_id"), text("D", driver % 10).alias("driver_code"), F.when(driver % 11 == 0, "None").otherwise(text(driver)).alias("driver_number"), text("t", driver % 10).alias("constructor_id"),
        line.alias("grid_position"), F.when(k % 7 == 0, "").otherwise(line).alias("final_position"), F.when(k % 7 == 0, "R").otherwise(line).alias("position_text"), F.col("l_quantity").cast("string").alias("points"), laps.alias("laps_completed"),
        time.alias("race_time"), F.when(k % 3 == 0, "").otherwise(line).alias("fastest_lap_rank"), F.when(k % 3 == 0, "").otherwise(text("1:", F.lpad((part % 60).cast("string"), 2, "0"), ".500")).alias("fastest_lap_time"),
        F.when(k % 3 == 1, text(driver % 50 + 200, ".0")).otherwise("").alias("fastest_lap_speed"), F.when(F.col("l_returnflag") == "A", "+1 Lap").when(F.col("l_returnflag") == "R", "Gearbox").otherwise("Retired").alias("status"),
        F.lit("2024-02-01").alias("ingested_at"), F.lit("api").alias("source_name"),
    )
    # One row for each month of the calendar: as a broadcast it leaves the wide results where they are, which two short keys would gather in few tasks.
    return typed_race_results(raw, F.broadcast(schedule)).withColumn("race_date", F.col("race_date").cast("string"))


@query("top_drivers_rounds", _STANDINGS + ", t AS (SELECT driver FROM s GROUP BY 1 ORDER BY max(points) DESC NULLS LAST, driver LIMIT 5) SELECT season, round, driver, points FROM s WHERE driver IN (SELECT driver FROM t)")
def top_drivers_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A26] Rounds of the five best drivers."""
    return keep_top_entities(standings(spark, sf_dir), "driver", F.max("points"), 5).select("season", "round", "driver", "points")


@query("season_kpis", f"WITH {_RACE} SELECT max(points) AS most_points, count(DISTINCT driver) AS drivers, count(DISTINCT race) AS races, (SELECT driver FROM r GROUP BY driver ORDER BY sum(points) DESC, driver LIMIT 1) AS leader FROM r")
def season_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A22] One row; the leader is an aggregate of aggregates."""
    per_driver = results(spark, sf_dir).groupBy("driver").agg(F.sum("points").alias("p"), F.max("points").alias("most"))
    leader = per_driver.agg(F.max("most").alias("most_points"), F.count(F.lit(1)).alias("drivers"), F.max_by("driver", F.struct("p", -F.col("driver"))).alias("leader"))
    races = results(spark, sf_dir).agg(F.count_distinct("race").alias("races"))
    return leader.join(races).select("most_points", "drivers", "races", "leader")


@query("race_board", f"WITH {_RACE} SELECT race, driver, coalesce(nullif(position, 7), 99) AS place, round(points, 1) AS pts, CASE position WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE '' END AS colour FROM r WHERE lower(status) LIKE '%r%' ORDER BY place, race, driver")
def race_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P19, P20, T1, T2] A view for a board: rounded, coloured, found by text, nulls last."""
    place = F.coalesce(F.nullif(F.col("position"), F.lit(7)), F.lit(99))
    colour = F.when(F.col("position") == 1, "gold").when(F.col("position") == 2, "silver").when(F.col("position") == 3, "bronze").otherwise("")
    found = results(spark, sf_dir).filter(F.col("status").ilike("%R%"))
    return found.select("race", "driver", place.alias("place"), F.round("points", 1).alias("pts"), colour.alias("colour")).orderBy("place", "race", "driver")


@query("team_revenue", "SELECT s_nationkey AS team, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def team_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J5] Sums over an inner join, combined before the shuffle."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team"))
    return table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("team").agg(total("l_extendedprice").alias("revenue"))
