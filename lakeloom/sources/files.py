"""File sources: declared, inferred and drifting schemas, batch or stream."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hour_from_path
from ..operators.rows import union_by_name


def read(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "json", streaming: bool = False, **options) -> DataFrame:
    """[S1, S4, S7] A declared schema over a folder, as a batch or as a stream that sees new files only (its checkpoint remembers them)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(format).options(**options).load(path)


def queue_options(servers: str, topic: str, per_trigger: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """[S7] Options of ``readStream.format('kafka')``, from the earliest record on. Lost records stop the query unless ``fail_on_data_loss`` is false."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": str(fail_on_data_loss).lower()}
    return out | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def bronze(df: DataFrame, at: Column | None = None, file_name: bool = True) -> DataFrame:
    """[S2] Ingest time and the file a row came from."""
    extra = {"_ingested_at": at if at is not None else F.current_timestamp()}
    if file_name:
        extra["_source_file"] = F.col("_metadata.file_path")
    return df.withColumns(extra)


def status_views(df: DataFrame, column: str, values: Sequence[str]) -> dict[str, DataFrame]:
    """[S3] A filtered frame for each value; nothing is stored."""
    return {v: df.filter(F.col(column) == v) for v in values}


def tagged(df: DataFrame, **values: object) -> DataFrame:
    """[S11] Constant metadata columns, or expressions."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def read_dimension(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """[S6, S10] A CSV with a header: declared types, or inferred ones."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_hours(spark: SparkSession, base: str, schema: T.StructType | str, first: Column, last: Column) -> DataFrame:
    """[S8] JSON lines under year=/month=/day=/hour= folders, only hours from ``first`` to ``last``; Spark prunes the rest."""
    df = spark.read.schema(schema).option("basePath", base).json(base)
    number = lambda ts: F.year(ts) * 1_000_000 + F.month(ts) * 10_000 + F.dayofmonth(ts) * 100 + F.hour(ts)
    own = F.col("year").cast("int") * 1_000_000 + F.col("month").cast("int") * 10_000 + F.col("day").cast("int") * 100 + F.col("hour").cast("int")
    return df.filter(own.between(number(first), number(last)))


def known_columns(df: DataFrame, names: Mapping[str, str], month: str, at: Column | None = None) -> DataFrame:
    """[S9] Only the columns of ``names`` that exist, renamed, with load time and month."""
    kept = [F.col(old).alias(new) for old, new in names.items() if old in df.columns]
    return df.select(*kept).withColumns({"_loaded_at": at if at is not None else F.current_timestamp(), "_source_month": F.lit(month)})


def clean_name(name: str) -> str:
    """[S13] Lower case; other signs than letters and digits become single underscores, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def clean_header(df: DataFrame) -> DataFrame:
    """[S13] Names cleaned; repeated ones are numbered."""
    names: list[str] = []
    for c in df.columns:
        base = clean_name(c) or "column"
        name, k = base, 1
        while name in names:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    return df.toDF(*names)


def read_csvs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """[S12] CSV files of possibly different headers, as text, united by clean name, each row with its file."""
    one = lambda p: clean_header(spark.read.option("header", True).csv(p)).withColumn("source_file", F.lit(p.rsplit("/", 1)[-1]))
    return union_by_name(*[one(p) for p in paths])


def flatten(df: DataFrame, array: str, fields: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """[S19] One row for each element of an array column: {name: path in the element}, as text, missing values ''."""
    rows = df.select(*keep, F.explode(array).alias("_x"))
    value = lambda path: F.coalesce(F.col(f"_x.{path}").cast("string"), F.lit(""))
    return rows.select(*keep, *[value(path).alias(name) for name, path in fields.items()])


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """[S15] (path, modified, bytes) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def dataset_of(file_name: Column | str, prefixes: Mapping[str, str]) -> Column:
    """[S14] The dataset whose prefix a file's name begins with; null for none. The first match counts."""
    name = F.lower(F.element_at(F.split(F.col(file_name) if isinstance(file_name, str) else file_name, "/"), -1))
    out = F.lit(None).cast("string")
    for prefix, dataset in reversed(list(prefixes.items())):
        out = F.when(name.startswith(prefix), dataset).otherwise(out)
    return out


def pending(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """[S15] Files that the manifest lacks."""
    return files.join(manifest.select(key).distinct(), key, "left_anti")


def merged_manifest(manifest: DataFrame, done: DataFrame, key: str = "path", cap: int | None = None) -> DataFrame:
    """[S15] Keys of both, once each. With a ``cap`` only the last ones in order stay: files of forgotten keys are pending again."""
    keys = manifest.select(key).union(done.select(key)).distinct()
    return keys if cap is None else keys.orderBy(F.desc(key)).limit(cap)


def after_mark(files: DataFrame, modified: str, key: str, mark: tuple[object, str] | None) -> DataFrame:
    """[S16] Files after the (time, key) high-water mark; equal times are parted by key."""
    if mark is None:
        return files
    t, k = F.lit(mark[0]).cast("timestamp"), F.lit(mark[1])
    return files.filter((F.col(modified) > t) | ((F.col(modified) == t) & (F.col(key) > k)))


def next_mark(files: DataFrame, modified: str, key: str) -> DataFrame:
    """[S16] One row: the new mark and how many files it covers; nulls without files."""
    top = F.max(F.struct(modified, key))
    return files.agg(top[modified].alias("last_modified"), top[key].alias("last_key"), F.count(F.lit(1)).alias("processed"))


def closed_hours(now: Column, cap_minutes: int) -> Column:
    """[S17] The closed hours to list: cap // 60 + 1 of them, the latest first; the open hour is not among them."""
    hour = F.date_trunc("hour", now)
    return F.transform(F.sequence(F.lit(1), F.lit(cap_minutes // 60 + 1)), lambda i: hour - F.make_dt_interval(hours=i))


def closed_window(now: Column, cap_minutes: int) -> tuple[Column, Column]:
    """[S17] The same hours as a range: from the first one's begin to the open hour's, excluded. Constants, if ``now`` is one, so that a scan skips by them."""
    end = F.date_trunc("hour", now)
    return end - F.make_dt_interval(hours=F.lit(cap_minutes // 60 + 1)), end


def affected_hours(files: DataFrame, path: str, now: Column, cap_minutes: int | None) -> DataFrame:
    """[S18, M8] (hour, files, in_time): hours of the paths; in time while the age from the hour's end is at most the cap."""
    hour = files.select(hour_from_path(path).alias("hour")).filter("hour IS NOT NULL").groupBy("hour").agg(F.count(F.lit(1)).alias("files"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("hour") - 3600) / 60.0
    return hour.withColumn("in_time", F.lit(True) if cap_minutes is None else age <= cap_minutes)


def arrow_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's filesystem for a path as Spark writes it, and the path in it."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _resolved(spark: SparkSession, path: str) -> str:
    """The path in the store where it lies: with its scheme, past mount points; as it is if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (store.resolvePath(at) if store.exists(at) else at).toString()


def _kind_in_arrow(uri: str) -> arrow_fs.FileType:
    """What Arrow finds at a path; NotFound if it doesn't know the store."""
    try:
        fs, root = arrow_store(uri)
        return fs.get_file_info(root).type
    except (pa.ArrowInvalid, OSError):
        return arrow_fs.FileType.NotFound


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


_LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_())])
#: Paths that a listing task hands on together, and bytes of texts that a reading one does.
_LISTED_ROWS, _LOADED_BYTES = 10_000, 4 << 20


def _below(uri: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (path, folder): files stay, folders become what is in them, or with ``deep`` all files below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = arrow_store(uri)
        for batch in batches:
            yield batch.filter(pc.invert(batch.column("folder"))).cast(_LISTED)
            todo = batch.filter(batch.column("folder")).column("path").to_pylist()
            out: list[dict] = []
            while todo:
                for x in fs.get_file_info(arrow_fs.FileSelector(todo.pop())):
                    folder = x.type == arrow_fs.FileType.Directory
                    if _hidden(x.base_name) or not (folder or x.type == arrow_fs.FileType.File and x.size != 0):
                        continue
                    if folder and deep:
                        todo.append(x.path)
                        continue
                    out.append({"path": x.path, "folder": folder})
                    if len(out) >= _LISTED_ROWS:
                        yield pa.RecordBatch.from_pylist(out, _LISTED)
                        out = []
            yield pa.RecordBatch.from_pylist(out, _LISTED)

    return run


def _contents(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over paths: (path, value) with the bytes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = arrow_store(uri)
        paths, values, held = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(path) as file:
                    values.append(file.read())
                paths.append(path)
                held += len(values[-1])
                if held >= _LOADED_BYTES:
                    yield pa.record_batch([pa.array(paths, pa.string()), pa.array(values, pa.binary())], names=["path", "value"])
                    paths, values, held = [], [], 0
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(values, pa.binary())], names=["path", "value"])

    return run


def load_documents(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """[R1] (text, source, type) of the text files below a folder; type by a part of the path, else 'general'.

    Folders are listed and files read in tasks, so the driver holds the name of no file; a task holds those of one folder. As with Spark's readers, empty files are no rows, and
    names that begin with ``_`` or ``.`` are left out. Only for patterns and stores that Arrow doesn't know does Spark's reader take over, whose index has all files on the driver.
    """
    uri = _resolved(spark, path)
    kind_of_root = _kind_in_arrow(uri)
    if kind_of_root == arrow_fs.FileType.NotFound:
        loaded = _read_by_index(spark, path)
    else:
        cores = spark.sparkContext.defaultParallelism
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
        listed = spark.range(0, 1, 1, 1).select(F.lit(arrow_store(uri)[1]).alias("path"), F.lit(kind_of_root == arrow_fs.FileType.Directory).alias("folder"))
        for deep, dealt in ((False, cores), (False, cores), (True, tasks)):  # after two levels there are folders enough for all cores
            listed = listed.mapInArrow(_below(uri, deep), "path string, folder boolean").repartition(dealt, "path")
        loaded = listed.select("path").mapInArrow(_contents(uri), "path string, value binary").withColumn("value", F.col("value").cast("string"))
    kind = F.lit("general")
    for part, name in reversed(list(kinds.items())):
        kind = F.when(F.col("path").contains(part), name).otherwise(kind)
    return loaded.select(F.col("value").alias("text"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("source"), kind.alias("type"))


def _read_by_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) by Spark's reader. Files are small, so a session beside the given one reads them at a low cost of opening: else a task gets only a few, however small they are."""
    reader = spark.newSession()
    reader.conf.set("spark.sql.files.openCostInBytes", "64k")
    df = reader.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), "value")
