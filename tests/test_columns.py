import base64
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import columns as C


def one(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(f"y{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def test_clock_and_gap(spark):
    got = one(spark, ["1:31.234", "1:32:05.123", "", "abc", None, "12.5"], "string", C.clock_seconds("x"))
    assert [g[0] and round(g[0], 3) for g in got] == [91.234, 5525.123, None, None, None, None]
    got = one(spark, ["+5.123", "+1 Lap", "", "1:32:05.1", None, "x"], "string", C.gap_seconds("x"))
    assert [g[0] for g in got] == [5.123, None, 0.0, None, 0.0, None]


def test_clean_number_and_digits(spark):
    got = one(spark, ["12", "", "None", "1.5", "x", None], "string", C.clean_number("x"), C.clean_number("x", "int"), C.is_digits("x"))
    assert [g[0] for g in got] == [12.0, None, None, 1.5, None, None]
    assert [g[1] for g in got] == [12, None, None, 1, None, None]
    assert [g[2] for g in got] == [True, False, False, False, False, False]


def test_status_and_sentiment(spark):
    texts = ["Finished", "+2 Laps", "Engine", "Collision", "Disqualified", "Did not qualify", "Illness", None, "Power Unit failure"]
    got = one(spark, texts, "string", C.status_category("x"))
    assert [g[0] for g in got] == ["FINISHED", "FINISHED", "RETIRED_MECHANICAL", "RETIRED_ACCIDENT", "DISQUALIFIED", "DID_NOT_START", "OTHER", "OTHER", "RETIRED_MECHANICAL"]
    assert [g[0] for g in one(spark, [5, 4, 3, 2, None], "int", C.sentiment("x"))] == ["positive", "positive", "neutral", "negative", None]


def test_day_part_and_division(spark):
    got = one(spark, [5, 6, 9, 10, 15, 16, 19, 20, 22, 23], "int", C.day_part("x"))
    assert [g[0] for g in got] == ["overnight", "morning_rush", "morning_rush", "midday", "midday", "evening_rush", "evening_rush", "evening", "evening", "overnight"]
    got = one(spark, [0, 2, None], "int", C.safe_divide(F.lit(1), "x"), C.safe_divide(F.lit(1), "x", None), C.clip("x", 1, 10))
    assert got == [(0.0, None, 1), (0.5, 0.5, 2), (0.0, None, None)]


def test_minutes_count_boundaries(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:59", "2024-01-01 00:01:01")], "a string, b string").select(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert df.select(C.minute_boundaries("a", "b")).head()[0] == 1


def test_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "a string, b string")
    keys = [r[0] for r in df.select(C.event_key("a", "b")).collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 64
    surrogate = [r[0] for r in df.select(C.surrogate_key("a", "b")).collect()]
    assert surrogate[0] != surrogate[1]


def test_payloads(spark):
    good, bad = json.dumps({"user_id": "u1", "track_id": ""}), "{not json"
    df = spark.createDataFrame([(0, bytearray(good.encode())), (1, bytearray(bad.encode())), (2, None)], "i int, x binary")
    got = df.select("i", C.decode_json("x", "user_id string, track_id string").alias("r")).withColumn("m", C.missing_fields("r", ["user_id", "track_id"])).orderBy("i").collect()
    assert got[0]["r"]["user_id"] == "u1" and got[0]["m"] == ["track_id"]
    assert got[1]["r"] is None and got[2]["r"] is None
    coded = spark.createDataFrame([(base64.b64encode(good.encode()).decode(),), ("***",)], "x string")
    assert [r[0] and r[0]["user_id"] for r in coded.select(C.decode_base64_json("x", "user_id string")).collect()] == ["u1", None]


def test_hour_of_a_path(spark):
    got = one(spark, ["a/year=2024/month=05/day=25/hour=14/x.json", "a/b"], "string", C.hour_from_path("x").cast("string"))
    assert got == [("2024-05-25 14:00:00",), (None,)]


@pytest.mark.parametrize(("text", "found"), [("What SALARY?", True), ("hello", False), (None, False)])
def test_contains_any(spark, text, found):
    assert one(spark, [text], "string", C.contains_any("x", ["salary", "ctc"])) == [(found,)]
