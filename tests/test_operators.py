import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import history as H
from lakeloom.operators import joins as J
from lakeloom.operators import retrieval as V
from lakeloom.operators import rows as W
from lakeloom.operators import rules as R
from lakeloom.plans.rides import completed, hourly_routes, top_routes


def t(hour, minute=0, day=25):
    return datetime(2024, 5, day, hour, minute)


def test_hourly_routes_and_top(spark):
    trips = spark.createDataFrame(
        [(1, 7, "a", t(14, 5), 40.0), (1, 7, "a", t(14, 6), 45.0), (2, 7, "a", t(14, 42), 20.5), (3, 7, "error", t(14, 15), 100.0), (4, 8, "b", t(15, 1), 9.0)],
        "event_id long, user_id long, event_type string, ts timestamp_ntz, value double",
    )
    assert completed(trips).count() == 3
    got = rows(hourly_routes(trips), "event_type", "user_id", "trip_count", "fare_sum", "year", "month", "day", "hour")
    assert got == [("a", 7, 2, 65.5, "2024", "05", "25", "14"), ("b", 8, 1, 9.0, "2024", "05", "25", "15")]
    assert rows(top_routes(trips, 1), "route_rank", "avg_fare") == [(1, 32.75), (1, 9.0)]
    assert top_routes(trips, 0).count() == 0


def test_latest_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, s int, v string")
    assert rows(W.latest_by(df, ["k"], ["s"])) == [(1, 2, "b"), (2, 1, None)]
    assert rows(W.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert rows(W.duplicate_flag(df, ["k"], [F.asc("s")]), "k", "is_duplicate") == [(1, False), (1, True), (2, False)]
    assert rows(W.difference(df.select("k"), spark.createDataFrame([(1,)], "k int"), ["k"])) == [(2,)]


def test_window_measures(spark):
    df = spark.createDataFrame([("d", 1, 10, 3), ("d", 2, 25, 1), ("e", 1, 5, None)], "who string, round int, points int, pos int")
    got = rows(W.change_from_previous(df, ["who"], [F.asc("round")], "pos", "c"), "who", "round", "c")
    assert got == [("d", 1, 0), ("d", 2, 2), ("e", 1, 0)]
    assert rows(W.gap_to_best(df, ["round"], "points", "g"), "who", "round", "g") == [("d", 1, 0), ("d", 2, 0), ("e", 1, 5)]
    assert rows(W.best_flag(df, ["who"], "pos", "b"), "who", "round", "b") == [("d", 1, False), ("d", 2, True), ("e", 1, False)]
    assert W.keep_top_entities(df, "who", F.sum("points"), 1).select("who").distinct().collect()[0][0] == "d"


@pytest.mark.parametrize("bin_width", [None, 3.0])
def test_range_join(spark, bin_width):
    p = spark.createDataFrame([("k", 1), ("k", 5), ("k", 20), ("z", 1)], "k string, x int")
    r = spark.createDataFrame([("k", 1, 5, "a"), ("k", 6, 19, "b")], "k string, lo int, hi int, n string")
    got = rows(J.range_join(p, r, ["k"], "x", "lo", "hi", bin_width=bin_width), "k", "x", "n")
    assert got == [("k", 1, "a"), ("k", 20, None), ("k", 5, "a"), ("z", 1, None)]


def test_lifecycle(spark):
    s = spark.createDataFrame([("a", t(1)), ("b", t(9))], "k string, at timestamp")
    e = spark.createDataFrame([("a", t(5)), ("b", t(5)), ("c", t(5))], "k string, at timestamp")
    got = rows(J.lifecycle(s.select("k"), e.select("k"), "k"), "k", "data_quality", "record_source")
    assert got == [("a", "ok", "trip_end_update"), ("b", "ok", "trip_end_update"), ("c", "missing_start", "trip_end_upsert")]
    assert rows(J.lifecycle(s, e, "k", received="at"), "k", "data_quality") == [("a", "ok"), ("b", "missing_start"), ("c", "missing_start")]


def test_orphans_and_overlaps(spark):
    f = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    assert rows(J.orphans(f, spark.createDataFrame([(1,), (None,)], "k int"), "k")) == [(9,)]
    h = spark.createDataFrame([("a", 1, t(1), t(3)), ("a", 2, t(2), t(4)), ("a", 3, t(4), None), ("a", 4, t(6), None)], "k string, id int, s timestamp, e timestamp")
    assert rows(J.overlaps(h, "k", "s", "e", "id")) == [("a", 1, 2), ("a", 3, 4)]


SCHEMA = "k int, ts timestamp, n int, v string, w int"


def test_scd2_cases(spark):
    df = spark.createDataFrame([(1, t(1), 1, "x", 1), (1, t(2), 2, "x", 2), (1, t(3), 3, None, 3), (1, t(4), 4, None, 4), (1, t(4), 5, "x", 5)], SCHEMA)
    got = [tuple(r) for r in H.scd2(df, ["k"], ["ts", "n"], ["v"]).select("v", "w", "valid_from", "valid_to").orderBy("w").collect()]
    assert got == [("x", 2, t(1), t(3)), (None, 4, t(3), t(4)), ("x", 5, t(4), None)]
    assert H.as_of(H.scd2(df, ["k"], ["ts", "n"], ["v"]), F.lit("2024-05-25 03:30:00").cast("timestamp")).count() == 1


def test_scd2_in_batches_equals_all_at_once(spark):
    r = random.Random(3)
    data = [(r.randrange(4), t(0) + timedelta(minutes=i), i, r.choice("abc"), i) for i in range(60)]
    whole = rows(H.scd2(spark.createDataFrame(data, SCHEMA), ["k"], ["ts", "n"], ["v"]))
    history = None
    for at in (0, 20, 40):
        batch = spark.createDataFrame(r.sample(data[at : at + 20], 20), SCHEMA)
        history = H.scd2(batch, ["k"], ["ts", "n"], ["v"]) if history is None else H.scd2_merge(history, batch, ["k"], ["ts", "n"], ["v"])
    assert rows(history) == whole
    again = H.scd2_merge(history, spark.createDataFrame(data[40:], SCHEMA), ["k"], ["ts", "n"], ["v"])
    assert rows(again) == whole  # a repeated batch changes nothing


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, w double")
    source = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, s int")
    got = rows(H.upsert(target, source, ["k"], ["s"]), "k", "v", "w")
    assert got == [(1, "a", 1.0), (2, "y", 2.0), (3, "z", None)]
    once = H.upsert(target, target, ["k"])
    assert rows(H.upsert(once, target, ["k"])) == rows(target)
    assert H.upsert(None, source, ["k"], ["s"]).count() == 2


def test_snapshot_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, v string")
    at = lambda s: F.lit(s).cast("timestamp")
    h = H.snapshot(b, H.snapshot(a, None, "k", ["v"], at("2024-01-01")), "k", ["v"], at("2024-02-01"))
    assert rows(h.select("k", "v", F.col("valid_to").isNull())) == [(1, "x", False), (1, "y", True), (2, None, True), (3, "z", True)]
    assert rows(H.diff(a, b, ["k"])) == [(1, "y", "update_postimage"), (3, "z", "insert")]
    assert rows(H.diff(b, a, ["k"], deletes=True)) == [(1, "x", "update_postimage"), (3, "z", "delete")]
    assert H.incremental_or_full(b, a, ["k"], 2, 2).count() == 0
    assert H.incremental_or_full(b, None, ["k"], 2, None).count() == 3


def test_schema_drift_and_contract(spark):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert H.aligned_text(df, ["c"], ["run"]).columns == ["a", "b", "c", "run"]
    assert rows(H.aligned_text(df, ["c"])) == [(None, "1", None)]
    with pytest.raises(ValueError, match="contract"):
        H.enforce(df, T.StructType([T.StructField("b", T.LongType())]))
    assert H.enforce(df, df.schema) is df


def test_rules(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    rule = R.Rule("small", F.col("x") < 3, "drop")
    assert rows(R.expect(df, [rule])) == [(1,)]
    assert R.expect(df, [R.Rule("small", F.col("x") < 3)]).count() == 3
    with pytest.raises(Exception, match="expectation failed: small"):
        R.expect(df, [R.Rule("small", F.col("x") < 3, "fail")]).collect()
    result = R.validate(df, [R.Rule("some", F.col("x").isNotNull(), "fail", 0.5), R.Rule("warned", F.col("x") < 3)], unique=["x"])
    assert result.passed and result.row_count == 3 and len(result.warnings) == 1
    empty = R.validate(df.limit(0), [rule], empty_is_error=True)
    assert not empty.passed
    with pytest.raises(ValueError, match="no rows"):
        empty.require()
    assert R.run_datasets({"a": lambda: result, "b": lambda: empty}) == {"loaded": ["a"], "skipped": ["b"]}
    with pytest.raises(ValueError, match="no rows"):
        R.run_datasets({"b": lambda: empty}, "fail-fast")


def test_splitter_rules():
    text = "# One\n\n" + "word " * 300 + "\n\n## Two\n\n" + "x" * 1200
    pieces = V.split_text(text, 500, 50)
    assert all(len(p) <= 500 and p in text for p in pieces) and pieces[0].startswith("# One")
    assert "".join("".join(pieces).split()).count("x") >= 1200
    assert V.split_text("") == [] and V.split_text("  a ") == ["a"]
    assert V.sections_at(text, [text[:3], "xxx"]) == ["Introduction", "Two"]


def test_chunks_and_history(spark):
    docs = spark.createDataFrame([(1, "# A\n\nhello there", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert rows(V.chunks(docs), "doc_id", "chunk_id", "section") == [(1, "s_1_chunk_0", "Introduction")]
    talk = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(10)], "conv_id long, turn long, role string, text string")
    got = V.history(talk).collect()[0]
    assert got["context"].split("\n") == ["Assistant: m5", "User: m6", "Assistant: m7", "User: m8", "Assistant: m9"] and got["n_messages"] == 5


def test_chunks_are_handed_on_in_small_batches(spark, monkeypatch):
    """Of one batch of many texts only some chunks are held at a time."""
    import pyarrow as pa

    docs, held = spark.createDataFrame([], "doc_id long, text string, source string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: held.append(run) or df.withColumnRenamed("_source", "source"))
    V.chunks(docs)
    batch = pa.record_batch({"_id": [None, *range(99)], "_source": ["s"] * 100, "_text": ["word " * 20_000] * 100})
    got = list(held[0](iter([batch])))
    sizes = [sum(map(len, g.column("text").to_pylist())) for g in got]
    assert max(sizes) < sum(sizes) / 5 and sum(g.num_rows for g in got) == 100 * len(V.split_text("word " * 20_000))
    assert got[0].column("_id")[0].as_py() is None and got[-1].column("_id").type == pa.int64()


def test_top_k_and_confidence(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, [-1.0, -1.0])], "query_id long, embedding array<double>")
    got = rows(V.cosine_top_k(v, q, 2).select("query_id", "rank", "vec_id", F.round("score", 4)))
    assert got == [(8, 1, 1, -0.7071), (8, 2, 2, -0.7071), (9, 1, 1, 1.0), (9, 2, 4, 0.7071)]
    low = rows(V.low_confidence(V.cosine_top_k(v, q, 2), q, threshold=0.2), "query_id", "low_confidence")
    assert low == [(8, True), (9, False)]
    assert rows(V.low_confidence(V.cosine_top_k(v, q, 2).limit(0), q), "low_confidence") == [(True,), (True,)]


def test_top_k_in_steps_equals_a_sort():
    import numpy as np

    r = np.random.default_rng(5)
    x, near = r.normal(size=(500, 6)), r.normal(size=(40, 6))
    x[100:300] = near[0] * 2  # more copies than k of one query's own vector
    frame = lambda v: pd.DataFrame({"_i": np.arange(len(v))[::-1], "_v": list(v)})
    (ids, unit), (own, asked) = V._units(frame(x))[6], V._units(frame(near))[6]
    ((_, kept),) = V._scan(iter([frame(x).iloc[:210], frame(x).iloc[210:]]), {6: (own, asked)}, 5, step=16)
    for q in range(40):
        score = np.einsum("j,ij->i", asked[q], unit)
        want = ids[np.lexsort((ids, -score.round(12)))][:5]
        assert kept[kept["q"] == q]["i"].tolist() == want.tolist()


def test_top_k_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [1e200, 1e200]), (4, [1.0, 0.0]), (5, [])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0]), ("c", None)], "query_id string, embedding array<double>")
    assert rows(V.cosine_top_k(v, q, 3), "query_id", "rank", "vec_id", F.round("score", 4)) == [("a", 1, 3, 1.0), ("a", 2, 4, 0.7071)]
    assert rows(V.cosine_top_k(v.limit(0), q)) == [] and rows(V.cosine_top_k(v, q.limit(0))) == []


def test_null_keys_are_keys(spark):
    """An upsert or snapshot that is run again changes nothing, null keys included."""
    schema = "k int, a int, b int"
    old, new = spark.createDataFrame([(1, 1, 1), (None, 2, 2)], schema), spark.createDataFrame([(None, 3, 3), (2, 4, 4)], schema)
    once = H.upsert(old, new, ["k"])
    assert rows(once) == rows(H.upsert(once, new, ["k"])) == sorted([(1, 1, 1), (None, 3, 3), (2, 4, 4)], key=repr)
    some = H.upsert(old, new.select("k", "a"), ["k"])
    assert rows(some, "k", "a", "b") == rows(H.upsert(some, new.select("k", "a"), ["k"]), "k", "a", "b") == sorted([(1, 1, 1), (None, 3, 2), (2, 4, None)], key=repr)
    now = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    first = H.snapshot(old, None, "k", ["a"], now(1))
    again = H.snapshot(old, first, "k", ["a"], now(2))
    assert rows(again) == rows(first)
    changed = H.snapshot(spark.createDataFrame([(1, 1, 1), (None, 9, 2)], schema), again, "k", ["a"], now(3))
    assert rows(changed.filter("valid_to is null"), "k", "a") == sorted([(1, 1), (None, 9)], key=repr) and changed.count() == 3


def test_validators_pass_empty_frames(spark):
    from lakeloom.operators import validators as K

    laps = spark.createDataFrame([(1, 1, None, 20.0, False, "SLICK"), (1, 1, 2, 20.0, True, None), (1, 1, 3, None, None, "")], "session_key int, driver_number int, lap_number int, lap_duration_seconds double, is_pit_out_lap boolean, compound string")
    result = R.validate(laps, K.lap_rules(laps))
    assert not result.passed and result.row_count == 3 and len(result.failures) == 1 and len(result.warnings) == 2
    for df, rules in ((laps, K.lap_rules(laps)), (laps.withColumn("current_position", F.lit(40)), K.standings_rules(laps.withColumn("current_position", F.lit(40))))):
        assert R.validate(df.limit(0), rules).passed
    with pytest.raises(ValueError, match="lap_number present"):
        result.require()
    keys = spark.createDataFrame([("", 1), (None, 2), ("x", 3)], "driver_id string, season int")
    checked = R.validate(keys, K.key_rules(keys, ["driver_id", "season", "absent"]))
    assert checked.passed and checked.warnings == ["driver_id given: 2 of 3 rows"]


def plain_sections(text, pieces):
    """Headings and places looked up for each piece on its own."""
    import re

    out, at = [], 0
    first = {}
    for piece in pieces:
        first.setdefault(piece, text.find(piece, at))
        at = max(at, first[piece])
        headings = re.findall(r"^#{1,2} .+", text[: first[piece]], re.M)
        out.append(headings[-1].lstrip("#").strip() if headings else "Introduction")
    return out


def test_chunks_against_a_plain_version(spark):
    """Chunks cover the text, keep their size, and have the section that a plain search gives; ids are unique over documents."""
    r = random.Random(3)
    texts = []
    for _ in range(12):
        blocks = [r.choice(["# Title {}", "## Part {}", "### Deep {}", "text {} " * 30, "word{} " * 150, "same block", "x" * 700]).replace("{}", str(k)) for k in range(30)]
        texts.append(r.choice(["\n\n", "\n"]).join(blocks))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, "", None])], "doc_id long, text string, source string")
    got = V.chunks(df, size=200, overlap=30).collect()
    assert len({g["chunk_id"] for g in got}) == len(got)
    for i, text in enumerate(texts):
        own = [g for g in sorted(got, key=lambda g: g["chunk_index"]) if g["doc_id"] == i]
        assert [g["text"] for g in own] == V.split_text(text, 200, 30) and all(len(g["text"]) <= 200 and g["text"] in text for g in own)
        assert [g["section"] for g in own] == plain_sections(text, [g["text"] for g in own])
        assert set("".join(text.split())) <= set("".join(g["text"] for g in own)) and all(w in " ".join(g["text"] for g in own) for w in text.split() if len(w) < 100)


def test_cosine_in_blocks_equals_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5)).round(1)
    x[50:60] = x[0]
    x[7] = 0
    df = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0])], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = rows(V.cosine_top_k(df, asked, k=4, round_bytes=100), "query_id", "rank", "vec_id")
    assert got == rows(V.cosine_top_k(df.repartition(7), asked, k=4), "query_id", "rank", "vec_id")
    want, norms = [], np.sqrt((x * x).sum(axis=1))
    for q in range(0, 300, 50):
        score = np.round((x @ x[q]) / np.where(norms > 0, norms * norms[q], 1), 12)
        order = [i for i in np.lexsort((np.arange(300), -score)) if norms[i] > 0][:4]
        want += [(q, k + 1, int(i)) for k, i in enumerate(order)]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=repr)]
    score = lambda q, i: round(float(x[i] @ x[q] / (norms[i] * norms[q])), 9)
    assert [score(q, i) for q, _, i in got if i < 900] == [score(q, i) for q, _, i in sorted(want, key=repr)]
