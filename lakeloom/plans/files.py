"""File sources and sinks over the tables: written to the shared work folder, read back, compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hour_parts, parsed_time
from ..operators import rules as R
from ..operators.history import upsert
from ..sources import files as S
from ..sources import sinks as K
from ..streaming import windows as W
from .base import query, table, total
from .streams import work_folder


@query("csv_dimension", """
    SELECT n_name AS zone, r_name AS borough, count(c_custkey) AS n_customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2
""")  # fmt: skip
def csv_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S6, S10] Dimensions from CSV files with headers, one with inferred and one with declared types, joined to a fact."""
    folder = work_folder(spark)
    for name in ("nation", "region"):
        table(spark, sf_dir, name).write.option("header", True).csv(f"{folder}/{name}")
    nations, regions = S.read_dimension(spark, f"{folder}/nation"), S.read_dimension(spark, f"{folder}/region", table(spark, sf_dir, "region").schema)
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n"))
    zones = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).join(customers, "n_nationkey", "left")
    return zones.select(F.col("n_name").alias("zone"), F.col("r_name").alias("borough"), F.coalesce("n", F.lit(0)).alias("n_customers"))


@query("csv_union", """
    SELECT cast(c_custkey AS VARCHAR) AS cust_key, c_name AS name, CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment END AS market_segment, CASE WHEN c_nationkey % 2 = 1 THEN 'odd.csv' ELSE 'even.csv' END AS source_file FROM customer
""")  # fmt: skip
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S12, S13, U3] CSV files of different headers, cleaned, tagged with the file and united by name."""
    folder, customers = work_folder(spark), table(spark, sf_dir, "customer")
    odd = F.col("c_nationkey") % 2 == 1
    files = {"odd.csv": customers.filter(odd).select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias(" NAME "), F.col("c_mktsegment").alias("Market-Segment")), "even.csv": customers.filter(~odd).select(F.col("c_name").alias("name"), F.col("c_custkey").alias("cust.key"))}
    for name, df in files.items():
        df.write.option("header", True).csv(f"{folder}/{name}")
    return S.read_csvs(spark, [f"{folder}/{name}" for name in files]).select("cust_key", "name", "market_segment", "source_file")


@query("read_modes", "SELECT 'batch' AS run_mode, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'stream', event_type, count(*) FROM events GROUP BY 2")
def read_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S1, S4, M6] One declared source as a batch and as a stream that ends when all files are read."""
    folder, schema = work_folder(spark), table(spark, sf_dir, "events").schema
    one = lambda streaming: S.read(spark, f"{sf_dir}/event[s].parquet", schema, "parquet", streaming).select("event_id", "event_type")
    W.start(one(True), "parquet", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    both = {"batch": one(False), "stream": spark.read.schema("event_id long, event_type string").parquet(f"{folder}/out")}
    counts = [df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("run_mode"), "event_type", "n") for mode, df in both.items()]
    return counts[0].unionByName(counts[1])


@query("appended_runs", """
    SELECT CASE WHEN o_orderstatus = 'F' THEN 'run-1' ELSE 'run-2' END AS run_id, o_orderpriority, count(*) AS n, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2
""")  # fmt: skip
def appended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C8, C12] Two runs appended to one table, a partition for each run id."""
    path, orders = f"{work_folder(spark)}/orders", table(spark, sf_dir, "orders")
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    for run, part in (("run-1", orders.filter(done)), ("run-2", orders.filter(~done))):
        K.append(part.withColumn("run_id", F.lit(run)), path, ["run_id"])
    stored = spark.read.schema(f"o_orderpriority string, o_totalprice {dict(orders.dtypes)['o_totalprice']}, run_id string").parquet(path)
    return stored.groupBy("run_id", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total"))


@query("hour_partitions", "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2, 3, 4")
def hour_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C17, A6] Rows appended to folders of their event hour, counted by folder."""
    path, events = f"{work_folder(spark)}/events", table(spark, sf_dir, "events")
    parts = hour_parts("ts")
    K.append(events.select("event_id", *[c.alias(n) for n, c in parts.items()]).hint("rebalance", *parts), path, list(parts))
    stored = spark.read.schema("event_id long, year string, month string, day string, hour string").parquet(path)
    return stored.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("overwritten_partitions", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'second' ELSE 'first' END AS run, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' OR event_type <> 'error' GROUP BY 1, 2
""")  # fmt: skip
def overwritten_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C10] A second run replaces only the days that it holds."""
    path, events = f"{work_folder(spark)}/events", table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    late = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    for run, part in (("first", events), ("second", events.filter(late & (F.col("event_type") != "error")))):
        K.overwrite_partitions(part.select("event_id", F.lit(run).alias("run"), "day"), path, ["day"])
    stored = spark.read.schema("event_id long, run string, day string").parquet(path)
    return stored.groupBy("day", "run").agg(F.count(F.lit(1)).alias("n"))


@query("clustered_orders", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def clustered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C18] Orders stored in ranges of the customer; a range of customers reads few files."""
    path, orders = f"{work_folder(spark)}/orders", table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    K.write_clustered(orders, path, ["o_custkey"], 8)
    return spark.read.schema(orders.schema).parquet(path).filter(F.col("o_custkey").between(10, 40))


@query("loaded_with_audit", """
    WITH s AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0)
    SELECT 'target' AS side, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 GROUP BY 2
    UNION ALL SELECT 'target', 'staged', count(*) FROM s UNION ALL SELECT 'audit:run-3:orders', 'loaded', count(*) FROM s
""")  # fmt: skip
def loaded_with_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C13] A staged table replaces its keys' rows in the target; a row tells the run, dataset and rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    staged = orders.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("staged"))
    target, audit = K.replace_by_key(orders.filter("o_orderkey % 2 = 0"), staged, ["o_orderkey"], "run-3", "orders")
    counts = target.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("target").alias("side"), "status", "n")
    return counts.unionByName(audit.select(F.concat(F.lit("audit:"), "run_id", F.lit(":"), "dataset").alias("side"), "status", F.col("rows").alias("n")))


@query("snapshot_pointer", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def snapshot_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C1] Each run writes a whole new snapshot; readers follow the path of the last."""
    folder, orders = f"{work_folder(spark)}/orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    first = K.swap_snapshot(orders, folder, 1)
    second = K.swap_snapshot(upsert(spark.read.schema(orders.schema).parquet(first), orders.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"]), folder, 2)
    return spark.read.schema(orders.schema).parquet(second)


@query("manifest_keys", "SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS path FROM events WHERE event_type IN ('click', 'view')")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S15] The manifest after a run: its keys and the done ones, once each."""
    paths = table(spark, sf_dir, "events").select("event_type", F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("path"))
    return S.merged_manifest(paths.filter("event_type = 'click'"), paths.filter("event_type IN ('click', 'view')"))


@query("dataset_policy", """
    SELECT 'orders' AS dataset, 'loaded' AS outcome, count(*) AS n_rows, 0::BIGINT AS failures, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS warned_rows FROM orders
    UNION ALL SELECT 'lineitem', CASE WHEN count(*) FILTER (WHERE NOT coalesce(l_quantity < 50, false)) > 0 THEN 'skipped' ELSE 'loaded' END, count(*), CASE WHEN count(*) FILTER (WHERE NOT coalesce(l_quantity < 50, false)) > 0 THEN 1 ELSE 0 END, 0 FROM lineitem
""")  # fmt: skip
def dataset_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C19, Q8] Each dataset is checked; one that fails is skipped and the others go on."""
    rules = {
        "orders": [R.Rule("has_key", F.col("o_orderkey").isNotNull(), "fail"), R.Rule("not_dear", F.col("o_totalprice") <= 400_000, "warn")],
        "lineitem": [R.Rule("few", F.col("l_quantity") < 50, "fail")],
    }
    results = {name: R.validate(table(spark, sf_dir, name), own) for name, own in rules.items()}
    outcome = R.run_datasets({name: (lambda r=r: r) for name, r in results.items()})
    warned = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").agg(F.count(F.lit(1)).alias("w"))
    lines = [(name, "loaded" if name in outcome["loaded"] else "skipped", r.row_count, len(r.failures)) for name, r in results.items()]
    out = spark.createDataFrame(lines, "dataset string, outcome string, n_rows long, failures long").join(warned)
    return out.select("dataset", "outcome", "n_rows", "failures", F.when(F.col("dataset") == "orders", F.col("w")).otherwise(0).alias("warned_rows"))


@query("ingest_chain", """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL)
    SELECT user_id, event_type, event_id, value, 'events' AS source_name, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS rows_first, (SELECT count(*) FROM events) AS rows_second FROM s WHERE n = 1
""")  # fmt: skip
def ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S5, S11, Q4, C1, Q16] Scan, metadata, soft check of the keys, keyed upsert, statistics; in two runs."""
    events, target, stats = table(spark, sf_dir, "events"), None, []
    for part in (events.filter("event_id % 2 = 0"), events):
        rows = S.tagged(part, source_name="events")
        R.validate(rows, [R.Rule("keys_present", F.col("user_id").isNotNull() & F.col("event_type").isNotNull(), "warn")])  # warns and goes on
        stats.append(R.table_stats(part, "events").select("rows"))
        target = upsert(target, rows.filter("user_id IS NOT NULL"), ["user_id", "event_type"], ["ts", "event_id"])
    out = target.select("user_id", "event_type", "event_id", "value", "source_name")
    return out.join(stats[0].withColumnRenamed("rows", "rows_first")).join(stats[1].withColumnRenamed("rows", "rows_second"))  # one row each


@query("parsed_times", """
    SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN date_trunc('second', ts) END AS at, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE 'not a time' END AS raw FROM events
""")  # fmt: skip
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X12] Times of two forms, and texts that are none."""
    form = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise("not a time")
    raw = table(spark, sf_dir, "events").select("event_id", form.alias("raw"))
    return raw.select("event_id", F.coalesce(parsed_time("raw", "yyyy-MM-dd HH:mm:ss"), parsed_time("raw", "dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz").alias("at"), "raw")
