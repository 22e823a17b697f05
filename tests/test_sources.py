import gzip
import json
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from lakeloom.functions.columns import hour_parts
from lakeloom.sources import files as S
from lakeloom.sources import sinks as K
from lakeloom.streaming import windows as M


def test_names_and_header(spark):
    assert S.clean_name("Order Amount($)") == "order_amount" and S.clean_name(" customer-id ") == "customer_id"
    assert S.clean_header(spark.createDataFrame([(1, 2)], ["A b", "a-b"])).columns == ["a_b", "a_b_2"]


def test_csv_drift(spark, tmp_path):
    (tmp_path / "songs.csv").write_text("Track ID,Name\n1,a\n")
    (tmp_path / "songs2.csv").write_text("Track ID,Genre\n2,g\n")
    df = S.read_csvs(spark, [str(tmp_path / "songs.csv"), str(tmp_path / "songs2.csv")])
    assert rows(df, "track_id", "name", "genre", "source_file") == [("1", "a", None, "songs.csv"), ("2", None, "g", "songs2.csv")]
    listed = S.listing(spark, str(tmp_path), "*.csv")
    assert listed.count() == 2 and S.pending(listed, listed.limit(1)).count() == 1
    routed = listed.select(S.dataset_of("path", {"songs": "songs", "users": "users"})).collect()
    assert [r[0] for r in routed] == ["songs", "songs"]


def test_marks_and_hours(spark):
    t = lambda m: datetime(2024, 5, 25, 14, m)
    df = spark.createDataFrame([("a", t(1)), ("b", t(1)), ("c", t(2))], "key string, m timestamp")
    assert rows(S.after_mark(df, "m", "key", (t(1), "a")), "key") == [("b",), ("c",)]
    assert S.after_mark(df, "m", "key", None).count() == 3
    assert tuple(S.next_mark(df, "m", "key").head()) == (t(2), "c", 3)
    hours = lambda at, cap: spark.range(1).select(S.closed_hours(F.lit(at).cast("timestamp"), cap)).head()[0]
    assert hours("2024-05-25 15:30:00", 60) == [datetime(2024, 5, 25, 14), datetime(2024, 5, 25, 13)]
    assert hours("2024-05-25 01:00:00", 60) == [datetime(2024, 5, 25, 0), datetime(2024, 5, 24, 23)]
    paths = spark.createDataFrame([(f"x/year=2024/month=05/day=25/hour={h}/f.json",) for h in ("14", "12")], "path string")
    got = rows(S.affected_hours(paths, "path", F.lit("2024-05-25 15:30:00").cast("timestamp"), 60), "in_time")
    assert got == [(False,), (True,)]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, datetime(2024, 5, 25, 14)), (2, datetime(2024, 5, 25, 15))], "x int, ts timestamp").withColumns(hour_parts("ts"))
    K.overwrite_partitions(df, path, ["year", "month", "day", "hour"])
    K.overwrite_partitions(df.filter("x = 2").withColumn("x", F.lit(9)), path, ["year", "month", "day", "hour"])
    assert rows(spark.read.parquet(path), "x") == [(1,), (9,)]
    K.append(df.select("x"), str(tmp_path / "log"))
    K.append(df.select("x"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    K.write_clustered(df, str(tmp_path / "sorted"), ["x"], 2)
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 2


def test_read_hours_prunes(spark, tmp_path):
    for h in ("13", "14"):
        folder = tmp_path / f"year=2024/month=05/day=25/hour={h}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(json.dumps({"x": int(h)}) + "\n")
    ts = F.lit("2024-05-25 14:00:00").cast("timestamp")
    assert rows(S.read_hours(spark, str(tmp_path), "x int", ts, ts), "x") == [(14,)]


def test_flatten(spark):
    df = spark.createDataFrame([(1, [{"a": "x", "b": None}])], "i int, items array<struct<a:string,b:string>>")
    assert rows(S.flatten(df, "items", {"a": "a", "b": "b"}, ["i"])) == [(1, "x", "")]


def _stream(spark, tmp_path, batches):
    src = tmp_path / "in"
    src.mkdir()
    for i, batch in enumerate(batches):
        (src / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in batch))
    return S.read(spark, str(src), "k string, ts timestamp, v int", "json", streaming=True, maxFilesPerTrigger=1)


def test_closed_windows_equal_the_batch(spark, tmp_path):
    events = [{"k": "a", "ts": f"2024-01-01T00:{m:02d}:00Z", "v": m} for m in (0, 1, 3, 5, 9)]
    df = _stream(spark, tmp_path, [events[:3], events[3:]])
    measures = {"n": F.count(F.lit(1)), "last": F.max("ts")}
    M.start(M.tumbling(df, "ts", "2 minutes", ["k"], measures, "30 seconds"), "parquet", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "window_start", "n")
    batch = S.read(spark, str(tmp_path / "in"), "k string, ts timestamp, v int")
    want = rows(M.tumbling(batch, "ts", "2 minutes", ["k"], measures).filter("window_end <= '2024-01-01 00:08:30'"), "window_start", "n")
    assert got == want and len(got) == 3


def test_changes_merge_into_a_table(spark, tmp_path):
    df = _stream(spark, tmp_path, [[{"k": "a", "ts": "2024-01-01T00:00:00Z", "v": 1}], [{"k": "a", "ts": "2024-01-01T00:05:00Z", "v": 2}, {"k": "b", "ts": "2024-01-01T00:01:00Z", "v": 1}]])
    held = {}
    sink = M.change_sink(lambda: held.get("t"), lambda t: held.update(t=spark.createDataFrame(t.collect(), t.schema)), ["k"], ["ts"], ["v"], kind=2)
    df.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(held["t"].select("k", "v", F.col("valid_to").isNull())) == [("a", 1, False), ("a", 2, True), ("b", 1, True)]


def test_microbatch_sink_skips_empty(spark, tmp_path):
    write = K.write_microbatch(str(tmp_path / "o"))
    write(spark.range(0), 0)
    assert not (tmp_path / "o").exists()
    write(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_documents_manifest_queue_and_sinks(spark, tmp_path):
    (tmp_path / "docs/projects").mkdir(parents=True)
    (tmp_path / "docs/projects/a.md").write_text("# A\nbody\n")
    (tmp_path / "docs/b.txt").write_text("b")
    found = rows(S.load_documents(spark, str(tmp_path / "docs"), {"projects": "project"}), "text", "source", "type")
    assert found == [("# A\nbody\n", "a", "project"), ("b", "b", "general")]
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert rows(S.merged_manifest(keys, keys.filter("path = 'b'"))) == [("a",), ("b",)] and rows(S.merged_manifest(keys, keys, cap=1)) == [("b",)]
    assert S.queue_options("h:1", "t")["failOnDataLoss"] == "true" and S.queue_options("h:1", "t", 5, False)["maxOffsetsPerTrigger"] == "5"
    target, audit = K.replace_by_key(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string"), ["k"], "r", "d")
    assert rows(target) == [(1, "x"), (2, "z")] and rows(audit) == [("r", "d", 1, "loaded")]
    path = K.swap_snapshot(target, str(tmp_path / "t"), 1)
    held = [spark.read.parquet(path)]
    M.upsert_sink(lambda: held[-1], held.append, ["k"])(spark.createDataFrame([(3, "n")], "k int, v string"), 0)
    assert rows(held[-1]) == [(1, "x"), (2, "z"), (3, "n")]


def test_written_documents_load_again(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.md", "one\ntwo"), ("b/c/y.txt", "é"), ("z.md", None)], "path string, text string")
    assert K.write_documents(docs, str(tmp_path / "d")) == 3
    assert K.write_documents(docs.filter("path = 'z.md'").withColumn("text", F.lit("new")), f"file://{tmp_path}/d") == 1
    found = rows(S.load_documents(spark, str(tmp_path / "d"), {"/a/": "first", "/c/": "second"}), "source", "type", "text")
    assert found == [("x", "first", "one\ntwo"), ("y", "second", "é"), ("z", "general", "new")]
    assert K.write_documents(docs.limit(0), str(tmp_path / "d")) == 0


def test_small_documents_share_tasks(spark, tmp_path):
    docs = spark.range(400).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("text").alias("text"))
    K.write_documents(docs, str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    loaded = S.load_documents(spark, str(tmp_path / "d"), {})
    assert loaded.rdd.getNumPartitions() <= 6 and loaded.count() == 400 and spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_documents_are_listed_in_tasks(spark, tmp_path):
    """No file is known to the plan, and the rows are those of Spark's own reader: nothing for empty and hidden files, bytes as they are, compressed files read; names as they are called."""
    texts = {"top.md": b"top", "a/b/c/d/e.tar.md": b"five", "a/empty.md": b"", "a/_x.md": b"no", "a/.y.md": b"no", "_h/z.md": b"no", "a/q._COPYING_": b"no", "_k=v/p.md": b"part", "a/my doc+100%.md": b"\xff\x00", "en/g.md.gz": gzip.compress(b"zipped")}
    for name, text in texts.items():
        (tmp_path / "my docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "my docs" / name).write_bytes(text)
    (tmp_path / "my docs/void").mkdir()
    want = [("e.tar", "general", b"five"), ("g.md", "en", b"zipped"), ("my doc+100%", "general", b"\xff\x00"), ("p", "general", b"part"), ("top", "general", b"top")]
    bytes_of = F.col("text").cast("binary").alias("text")
    found = lambda path: sorted((s, k, bytes(t)) for s, k, t in S.load_documents(spark, path, {"/en/": "en"}).select("source", "type", bytes_of).collect())
    assert S.load_documents(spark, str(tmp_path / "my docs"), {}).inputFiles() == []
    assert found(str(tmp_path / "my docs")) == found(f"file://{tmp_path}/my docs") == want
    assert found(f"{tmp_path}/my*") == want  # a pattern: by Spark's reader
    assert found(str(tmp_path / "my docs/top.md")) == want[-1:] and found(str(tmp_path / "my docs/void")) == []
