"""Distinct counts that add up, curves, bucketed joins and drifting payloads."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators import distinct as D
from lakeloom.plans import registry
from lakeloom.sources import layout as L
from lakeloom.sources import sinks as K


def test_bitmaps_unite_to_exact_counts(spark):
    r = random.Random(1)
    data = [(h, r.choice([None, -5, 0, 1, 32768, 32769, 2**40, r.randrange(200)])) for h in range(6) for _ in range(60)]
    df = spark.createDataFrame(data, "h int, u long")
    stored = D.bitmaps(df, ["h"], "u")
    want = [(h, len({u for g, u in data if g == h and u is not None}), sum(g == h for g, _ in data)) for h in range(6)]
    assert rows(D.distinct_of(stored, ["h"])) == want
    halves = D.united_bitmaps(stored, [(F.col("h") < 3).alias("half")])
    of = lambda first: len({u for g, u in data if (g < 3) == first and u is not None})
    assert rows(D.distinct_of(halves, ["half"]), "half", "distinct_ids") == [(False, of(False)), (True, of(True))]
    assert D.distinct_of(D.bitmaps(df.limit(0), ["h"], "u"), ["h"]).count() == 0
    nulls = D.bitmaps(spark.createDataFrame([(1, None)], "h int, u long"), ["h"], "u")
    assert rows(D.distinct_of(nulls, ["h"])) == [(1, 0, 1)]


def test_sketches_unite_like_one_over_all_rows(spark):
    df = spark.createDataFrame([(i % 24, i % 3000, None if i % 2 else str(i % 700)) for i in range(12_000)], "h int, a int, b string")
    stored = df.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[m.alias(c) for c, m in D.sketches({"a": "a", "b": "b"}).items()])
    one, whole = D.united(stored, [F.lit(1).alias("k")], ["a", "b"], ["n"]).head(), df.agg(*[F.hll_sketch_estimate(m).alias(c) for c, m in D.sketches({"a": "a", "b": "b"}).items()]).head()
    assert one["n"] == 12_000 and abs(one["a"] - whole["a"]) <= 0.02 * whole["a"] and abs(one["b"] - whole["b"]) <= 0.02 * whole["b"]
    ok = spark.range(1).select(D.within(F.lit(one["a"]), F.lit(3000)), D.within(F.lit(one["b"]), F.lit(350)), D.within(F.lit(4000), F.lit(3000))).head()
    assert tuple(ok) == (True, True, False)


def groups_read(path: Path, column: str, lo, hi) -> int:
    """Row groups that a reader can't skip by their statistics."""
    n = 0
    for f in path.glob("part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            n += not (s.max < lo or s.min > hi)
    return n


def test_a_curve_skips_on_every_column(spark, tmp_path):
    r = random.Random(2)
    data = [(r.randrange(1000) ** 2, datetime(2024, 1, 1) + timedelta(minutes=r.randrange(500_000)), r.choice("abcdefgh") * 3) for _ in range(20_000)]
    df = spark.createDataFrame(data, "a int, b timestamp_ntz, c string").repartition(4)
    K.write_clustered(df, str(tmp_path / "one"), ["a"], 16)
    L.write_interleaved(df, str(tmp_path / "two"), ["a", "b"], 16)
    assert rows(spark.read.parquet(str(tmp_path / "two"))) == rows(df)
    a, b = (250_000, 260_000), (datetime(2024, 6, 1), datetime(2024, 6, 5))
    one = groups_read(tmp_path / "one", "a", *a), groups_read(tmp_path / "one", "b", *b)
    two = groups_read(tmp_path / "two", "a", *a), groups_read(tmp_path / "two", "b", *b)
    assert one[0] <= 2 and one[1] == 16  # one column alone: no help for the other
    assert max(two) <= 8 and sum(two) < sum(one)
    three = df.withColumn("k", L.interleaved(df, ["a", "b", "c"], bits=3))
    assert three.select("k").distinct().count() > 50 and three.agg(F.max("k")).head()[0] < 2**9
    with pytest.raises(ValueError):
        L.interleaved(df, ["a", "b"], bits=40)
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, "")], "a int, c string")
    assert odd.withColumn("k", L.interleaved(odd, ["a", "c"])).filter("k is null").count() == 0
    L.write_interleaved(odd.limit(0), str(tmp_path / "none"), ["a"], 2)


def test_clustered_orders_read_few_files(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey")
    K.write_clustered(orders, str(tmp_path / "c"), ["o_custkey"], 8)
    orders.repartition(8).write.parquet(str(tmp_path / "plain"))
    assert groups_read(tmp_path / "plain", "o_custkey", 10, 40) == 8 and groups_read(tmp_path / "c", "o_custkey", 10, 40) <= 3


def test_bucketed_tables_join_without_a_shuffle(spark, sf):
    df = registry.QUERIES["bucketed_fulfilment"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_drifting_payloads(spark):
    texts = ['{"a": 1, "b": {"c": "x", "d": null}}', '{"a": 2.5, "e": [1, 2]}', '{"a": "three", "b": {"c": "y", "f": true}}', "no json", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string")
    got = [r.asDict() for r in L.drifting(df, "p", ["i"]).orderBy("i").collect()]
    assert set(got[0]) == {"i", "a", "b_c", "b_d", "b_f", "e"}
    assert [g["a"] for g in got] == ["1", "2.5", '"three"', None, None, None]  # unlike types: JSON text
    assert [g["b_c"] for g in got] == ["x", None, "y", None, None, None] and got[2]["b_f"] is True and json.loads(got[1]["e"]) == [1, 2]
    assert L.drifting(df.filter("i > 2"), "p", ["i"]).columns == ["i"] and L.drifting(df.limit(0), "p", ["i"]).count() == 0
    later = L.drifting(spark.createDataFrame([(9, '{"a": 7, "new": 1}')], "i int, p string"), "p", ["i"], L.found_schema(df, "p"))
    assert later.columns == L.drifting(df, "p", ["i"]).columns  # a stored schema holds
