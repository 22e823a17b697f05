"""Keyed state, counted expectations, late rows, late changes, bucket merges and payload queues, piece by piece."""

import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import history as H
from lakeloom.operators import rules as R
from lakeloom.sources import queue as Q
from lakeloom.sources.buckets import BucketTable, changed_rows, checksum_tree, differing_buckets
from lakeloom.streaming import ingest as G
from lakeloom.streaming import state as P
from lakeloom.streaming import windows as W


def t(hour, minute=0, day=1):
    return datetime(2024, 5, day, hour, minute)


# --- keyed state ------------------------------------------------------------

TRIPS = "trip string, ts timestamp, is_end boolean, start_id int, end_id int"


def run_trips(spark, tmp_path, batches, wait=3600, keep=7200, delay="10 minutes"):
    """Each batch is a run of the query of its own; the rows it puts out, and the number of state rows left."""
    source = spark.readStream.schema(TRIPS).parquet(str(tmp_path / "i[n]")).withWatermark("ts", delay)
    out = P.paired(source, "trip", "ts", "is_end", ["start_id"], ["end_id"], wait, keep)
    got, left = [], None
    with P.state_store(spark):
        for batch in batches:
            spark.createDataFrame(batch, TRIPS).write.mode("append").parquet(str(tmp_path / "in"))
            q = W.start(out, "parquet", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
            q.awaitTermination()
            got.append(rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out")), "trip", "start_id", "end_id", "data_quality", "record_source"))
            left = q.lastProgress.stateOperators[0].numRowsTotal
    return got, left


def test_either_event_may_come_first_and_timers_clear_the_state(spark, tmp_path):
    start = lambda k, at, i: (k, at, False, i, None)
    end = lambda k, at, i: (k, at, True, None, i)
    ok = lambda k, s, e: (k, s, e, "ok", "trip_end_update")
    batches = [
        [start("a", t(1), 1), end("b", t(1, 5), 12), end("c", t(1, 5), 13)],
        [end("a", t(1, 10), 11), start("b", t(1, 2), 2)],  # the start of b comes after its end
        [start("z", t(3), 9)],  # the watermark passes the waiting end of c
        [end("z", t(3, 1), 19), end("z", t(3, 2), 20), end("a", t(4, 50), 21)],  # two ends of a trip; a's start is too old by now
        [start("y", t(20), 8)],  # everything is over
        [start("x", t(23), 7)],
    ]
    got, left = run_trips(spark, tmp_path, batches)
    assert got[0] == [] and got[1] == [ok("a", 1, 11), ok("b", 2, 12)]
    assert got[2] == [*got[1], ("c", None, 13, "missing_start", "trip_end_upsert")]
    assert set(got[3]) - set(got[2]) == {ok("z", 9, 19), ok("z", 9, 20)}
    assert set(got[4]) - set(got[3]) == {("a", None, 21, "missing_start", "trip_end_upsert")}
    assert got[5] == got[4] and left <= 4  # the last start, its timer, and what the store counts for them


def test_pairs_in_any_order_equal_a_join(spark, tmp_path):
    r = random.Random(5)
    events = []
    for i in range(60):
        at = t(0) + timedelta(minutes=4 * i)
        events += [(str(i), at, False, i, None)] * (i % 5 != 0) + [(str(i), at + timedelta(minutes=2), True, None, i)] * (i % 7 != 0)
    slices = [[], [], []]
    for e in events:
        slices[min(2, (e[1] - t(0)) // timedelta(minutes=80) + (r.random() < 0.05))].append(e)
    batches = [r.sample(s, len(s)) for s in slices] + [[("end", t(23), False, 999, None)], [("end2", t(23, 50), False, 998, None)]]
    got, _ = run_trips(spark, tmp_path, [b for b in batches if b], wait=6 * 3600, delay="4 hours")
    ends = {e[4] for e in events if e[2]}
    assert [g[:4] for g in got[-1]] == sorted(((str(i), i if i % 5 else None, i, "ok" if i % 5 else "missing_start") for i in ends), key=repr)


def test_state_is_held_by_buckets_of_keys(spark, tmp_path):
    """Python is called, and state kept, for each bucket of keys and not for each key; null is a key."""
    source = spark.readStream.schema(TRIPS).parquet(str(tmp_path / "i[n]")).withWatermark("ts", "1 day")
    out = P.paired(source, "trip", "ts", "is_end", ["start_id"], ["end_id"], 3600, 7200, buckets=2)
    keys = [None, *[str(i) for i in range(300)]]
    with P.state_store(spark):
        for batch in ([(k, t(1), i % 2 == 1, i, i) for i, k in enumerate(keys)], [(k, t(1, 5), i % 2 == 0, i, i) for i, k in enumerate(keys)]):
            spark.createDataFrame(batch, TRIPS).write.mode("append").parquet(str(tmp_path / "in"))
            q = W.start(out, "parquet", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
            q.awaitTermination()
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 2 * 4
    assert rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out")), "trip", "start_id", "end_id") == sorted(((k, i, i) for i, k in enumerate(keys)), key=repr)


# --- counted expectations ---------------------------------------------------


def test_expectations_of_a_batch_and_a_stream(spark, tmp_path):
    from pyspark.sql import Observation

    rules = [R.Rule("read", F.col(G.CORRUPT).isNull()), R.Rule("given", F.col("a").isNotNull(), "drop")]
    (tmp_path / "in").mkdir()
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    log = G.CountLog(spark, "counted", str(tmp_path / "counts"))
    df = R.expect(G.json_stream(spark, str(tmp_path / "in"), schema), rules, observation="counted")
    spark.streams.addListener(log)
    for i, lines in enumerate([['{"a": 1}', '{"a": nul'], ['{"a": null}', '{"b": 2}', '{"a": 3}']]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        q = W.start(df, "parquet", str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        log.wait(q)
    spark.streams.removeListener(log)
    assert rows(log.counts(), "rule", "rows", "broken") == [("given", 5, 3), ("read", 5, 1)]
    assert rows(spark.read.parquet(str(tmp_path / "out")), "a") == [(1,), (3,)]
    progress = type("E", (), {"progress": type("P", (), {"observedMetrics": {"counted": spark.createDataFrame([(2, 1, 1)], "rows long, read long, given long").head()}, "id": q.id, "batchId": 0})})
    log.onQueryProgress(progress)  # batch 0 again: its counts are replaced, not added
    assert rows(log.counts(), "rule", "rows", "broken") == [("given", 5, 3), ("read", 5, 1)]
    seen = Observation()
    assert R.expect(spark.createDataFrame([(1,), (None,)], "a int"), [rules[1]], seen).count() == 1 and seen.get == {"rows": 2, "given": 1}


# --- late rows --------------------------------------------------------------


def test_late_rows_are_put_aside_and_replays_agree(spark, tmp_path):
    split = G.LateSplit(str(tmp_path / "s"), "ts", timedelta(hours=1))
    frame = lambda data: spark.createDataFrame(data, "i int, ts timestamp")
    batches = [[(1, t(5)), (2, t(1))], [(3, t(3, 59)), (4, t(4)), (5, t(9)), (6, None)], [], [(7, t(7, 59)), (8, t(8))]]
    for n, data in enumerate(batches):
        split(frame(data), n)
    want = [(1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (7, True), (8, False)]
    assert rows(split.rows(spark, frame([]).schema), "i", "late") == want
    for n in (1, 3):  # replayed after later batches
        split(frame(batches[n]), n)
    assert rows(split.rows(spark, frame([]).schema), "i", "late") == want
    marks = spark.read.json(str(tmp_path / "s/marks/*"))
    assert marks.agg(F.sum("rows"), F.sum("late")).head()[:] == (8, 2)


# --- late changes of type 2 tables --------------------------------------------

CHANGES = "k string, ts timestamp, n int, v string, w int"
SPEC = (["k"], ["ts", "n"], ["v"])


def merged(spark, parts, deletes):
    schema = spark.createDataFrame([], CHANGES).schema
    log = spark.createDataFrame([], schema)
    history = H.scd2(log, *SPEC, deletes=deletes)
    for part in parts:
        history, fresh = H.scd2_split(history, log, spark.createDataFrame(part, schema), *SPEC, deletes=deletes)
        log, history = spark.createDataFrame(log.unionByName(fresh).collect(), schema), spark.createDataFrame(history.collect(), history.schema)
    return history


def test_a_late_row_splits_its_interval(spark):
    a = [("k", t(1), 1, "a", 1), ("k", t(3), 3, "a", 3), ("k", t(5), 5, "a", 5), ("k", t(9), 9, "b", 9)]
    got = merged(spark, [a, [("k", t(2), 2, "z", 2)]], None)
    assert rows(got, "v", "w", "valid_from", "valid_to") == sorted([("a", 1, t(1), t(2)), ("z", 2, t(2), t(3)), ("a", 5, t(3), t(9)), ("b", 9, t(9), None)], key=repr)
    gone = F.col("v") == "gone"
    got = merged(spark, [a, [("k", t(4), 4, "gone", 4)], [("k", t(4), 4, "gone", 4)]], gone)
    assert rows(got, "v", "w", "valid_from", "valid_to") == sorted([("a", 3, t(1), t(4)), ("a", 5, t(5), t(9)), ("b", 9, t(9), None)], key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_batches_equals_all_rows_at_once(spark, seed):
    r = random.Random(seed)
    data = [(r.choice(["a", "b", None]), t(0) + timedelta(minutes=r.randrange(25)), i, r.choice(["x", "y", None, "gone"]), i) for i in range(80)]  # many equal times
    gone = F.col("v") == "gone"
    order = r.sample(data, len(data)) if seed % 2 else sorted(data, key=lambda d: d[1], reverse=seed % 4 == 0)
    parts = [order[i : i + 27] for i in range(0, 80, 27)]
    whole = rows(H.scd2(spark.createDataFrame(data, CHANGES), *SPEC, deletes=gone))
    assert rows(merged(spark, [*parts, parts[1]], gone)) == whole


def test_only_touched_intervals_are_made_again(spark):
    data = [("k", t(i), i, "xyz"[i % 3], i) for i in range(20)]
    df = spark.createDataFrame(data, CHANGES)
    history, (late, _) = H.scd2(df, *SPEC), [("k", t(10, 30), 99, "q", 99)] * 2
    marked = history.withColumn("w", F.lit(-1))
    got, fresh = H.scd2_split(marked, df, spark.createDataFrame([late], CHANGES), *SPEC)
    again = sorted(r["valid_from"].hour for r in got.filter("w <> -1").collect())
    assert again == [10, 10, 11] and fresh.count() == 1  # the interval around the row, the new one, the next one


def test_a_split_reads_each_side_once(spark, tmp_path):
    data = [("k", t(i), i, "xyz"[i % 3], i) for i in range(10)]
    df = spark.createDataFrame(data, CHANGES)
    sides = {"history": H.scd2(df, *SPEC), "log": df, "batch": df.limit(1)}
    for name, side in sides.items():
        side.write.parquet(str(tmp_path / name))
    read = {name: spark.read.parquet(str(tmp_path / name)) for name in sides}
    got, _ = H.scd2_split(read["history"], read["log"], read["batch"], *SPEC)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation") == 4  # the log twice: new rows are told by it
    assert rows(got) == rows(sides["history"])


def test_rows_of_earlier_batches_come_again_in_later_ones(spark, tmp_path):
    r, gone = random.Random(11), F.col("v") == "gone"
    data = [(r.choice(["a", "b", None]), t(0) + timedelta(minutes=r.randrange(30)), i, r.choice(["x", None, "gone"]), i) for i in range(90)]
    held = W.HistoryTable(str(tmp_path / "h"), *SPEC, spark.createDataFrame([], CHANGES).schema, gone, n=4)
    for n, part in enumerate((data[:50], data[40:], data[10:20], data[:1])):
        held.merge(spark.createDataFrame(part, CHANGES), n)
    assert rows(held.read(spark)) == rows(H.scd2(spark.createDataFrame(data, CHANGES), *SPEC, deletes=gone))
    log = spark.read.parquet(str(tmp_path / "h/log"))
    assert log.count() == 90 and {x.name for x in (tmp_path / "h/log").iterdir()} >= {f"batch={n}" for n in range(4)}
    assert {r[0]: r[1] for r in log.groupBy("batch").count().collect()} == {0: 50, 1: 40}


# --- buckets ----------------------------------------------------------------


def files(path):
    return {p.relative_to(path).as_posix() for p in path.rglob("part-*") if "crc" not in p.name}


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    held = BucketTable(str(tmp_path / "t"), ("k",), schema, 16)
    df = spark.createDataFrame([(i, "a") for i in range(200)] + [(None, "n")], schema)
    assert len(held.merge(df, 0)) == 16
    before = files(tmp_path / "t/rows")
    touched = held.merge(spark.createDataFrame([(7, "b"), (None, "m")], schema), 1)
    after = files(tmp_path / "t/rows")
    bucket = lambda f: int(f.split("/")[0].split("=")[1])
    assert 1 <= len(touched) <= 2 and {bucket(f) for f in before ^ after} == set(touched)
    want = [(i, "b" if i == 7 else "a") for i in range(200)] + [(None, "m")]
    assert rows(held.read(spark)) == sorted(want, key=repr)
    assert held.merge(spark.createDataFrame([(8, "c")], schema), 1) == [] and files(tmp_path / "t/rows") == after  # the batch is done
    held.merge(spark.createDataFrame([(7, "b"), (None, "m")], schema))  # without a mark: again, with the same result
    assert rows(held.read(spark)) == sorted(want, key=repr)
    assert held.merge(df.limit(0), 2) == []
    plan = held.read(spark, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(_bucket#" in plan


def test_checksums_find_the_buckets_that_differ(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string, w int").schema
    a, b = (BucketTable(str(tmp_path / n), ("k",), schema, 32) for n in "ab")
    data = [(i, None if i % 3 else "x", i) for i in range(300)]
    a.merge(spark.createDataFrame(data, schema))
    b.merge(spark.createDataFrame(random.Random(1).sample(data, 300), schema))
    assert differing_buckets(a, b, spark) == [] and changed_rows(a, b, spark).count() == 0
    b.merge(spark.createDataFrame([(5, "y", 5), (900, None, 1)], schema))
    buckets = differing_buckets(a, b, spark)
    assert 1 <= len(buckets) <= 2
    assert rows(changed_rows(a, b, spark), "k", "v", "_change_type") == [(5, "y", "update_postimage"), (900, None, "insert")]
    assert rows(changed_rows(b, a, spark, deletes=True), "k", "_change_type") == [(5, "update_postimage"), (900, "delete")]
    # Folders of equal buckets are not read: without them the result is the same.
    import shutil

    for f in (tmp_path / "a/rows").iterdir():
        if f.name.startswith("_bucket=") and int(f.name.split("=")[1]) not in buckets:
            shutil.move(f, tmp_path / f"gone-{f.name}")
    assert rows(changed_rows(a, b, spark), "k") == [(5,), (900,)]
    # Equal rows in another column order of values, nulls against empty text: told apart.
    x = spark.createDataFrame([(1, None, 2)], schema)
    assert rows(a.checksums(x)) != rows(a.checksums(spark.createDataFrame([(1, "", 2)], schema)))
    tree = checksum_tree(a.stored_checksums(spark), 16, 2)
    assert {r["level"]: r["s"] for r in tree.groupBy("level").agg(F.sum("rows").alias("s")).collect()} == {0: 300, 1: 300, 2: 300}
    assert tree.filter("level = 2").count() == 1


def test_late_rows_do_not_win_in_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, s int, v string").schema
    held = BucketTable(str(tmp_path / "t"), ("k",), schema, 4)
    sink = W.bucket_sink(held, ["s"])
    sink(spark.createDataFrame([(1, 5, "new"), (2, 1, "old"), (1, 4, "x")], schema), 0)
    sink(spark.createDataFrame([(1, 3, "late"), (2, 2, "newer"), (3, 1, "first")], schema), 1)
    assert rows(held.read(spark)) == [(1, 5, "new"), (2, 2, "newer"), (3, 1, "first")]


def test_history_tables_replace_touched_buckets_and_take_batches_again(spark, tmp_path):
    r, gone = random.Random(9), F.col("v") == "gone"
    data = [(r.choice("abcdefgh"), t(0) + timedelta(minutes=r.randrange(40)), i, r.choice(["x", "y", "gone"]), i) for i in range(120)]
    schema = spark.createDataFrame([], CHANGES).schema
    held = W.HistoryTable(str(tmp_path / "h"), *SPEC, schema, gone, n=16)
    frame = lambda part: spark.createDataFrame(part, schema)
    order = r.sample(data, len(data))
    for n in range(2):
        held.merge(frame(order[60 * n : 60 * n + 60]), n)
    whole = rows(H.scd2(frame(data), *SPEC, deletes=gone))
    assert rows(held.read(spark)) == whole and held.merge(frame(order[:60]), 0) == []
    import shutil

    shutil.rmtree(tmp_path / "h/done/1")  # as if the last batch had failed after its writes
    assert len(held.merge(frame(order[60:]), 1)) > 1 and rows(held.read(spark)) == whole
    before = files(tmp_path / "h/history")
    late = [("a", t(0, 20), 500, "z", 500)]
    (bucket,) = held.merge(frame(late), 2)
    assert {f.split("/")[0] for f in before ^ files(tmp_path / "h/history")} == {f"_bucket={bucket}"}
    assert rows(held.read(spark)) == rows(H.scd2(frame(data + late), *SPEC, deletes=gone))
    assert held.merge(frame([]), 3) == []


# --- payloads ----------------------------------------------------------------


def test_queue_reads_committed_segments_once(spark, tmp_path):
    spark.dataSource.register(Q.PayloadQueue)
    path = str(tmp_path / "q")
    frame = lambda texts: spark.createDataFrame([(bytearray(x),) for x in texts], "payload binary").repartition(2)
    data = [json.dumps({"a": i, "b": "é" * 100}).encode() for i in range(50)] + [b"", b"\x00\n\xff", b"not json"]
    Q.append_segment(frame(data), path, 0)
    Q.append_segment(frame([b"two"]), path, 2)  # one is missing before it
    read = lambda: spark.read.format("payload_queue").load(path)
    assert sorted(bytes(r[0]) for r in read().select("payload").collect()) == sorted(data)
    assert read().select("segment", "file", "position").distinct().count() == len(data)
    out, seen = str(tmp_path / "out"), lambda: spark.read.parquet(out).groupBy("segment").count().collect()

    def run():
        source = spark.readStream.format("payload_queue").load(path)
        source.writeStream.foreachBatch(G.replay_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert {r[0]: r[1] for r in seen()} == {0: len(data)}
    Q.append_segment(frame([b"one"]), path, 1)
    (tmp_path / "q/segment=000000002/_SUCCESS").unlink()  # not committed
    run()
    run()
    assert {r[0]: r[1] for r in seen()} == {0: len(data), 1: 1}
    (tmp_path / "q/segment=000000002/_SUCCESS").touch()
    run()
    assert {r[0]: r[1] for r in seen()} == {0: len(data), 1: 1, 2: 1}


def test_outcomes_of_payloads(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    texts = ['{"a": 1, "b": "x"}', '{"a": 1, "b": ""}', "{}", '{"a": 1', None, ""]
    df = spark.createDataFrame([(None if x is None else bytearray(x.encode()),) for x in texts], "payload binary")
    got = [(r["outcome"], r["reason"]) for r in G.outcomes(df, schema, ["a", "b"]).collect()]
    assert got == [("good", None), ("dead", "missing b"), ("dead", "missing a,b"), ("dead", "malformed"), ("dead", "malformed"), ("dead", "malformed")]
