"""Sinks. Rows are dealt by the partition columns before a write, so that a partition is few files and none is written by one task for all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import upsert
from .files import arrow_store


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append(df: DataFrame, path: str, partitions: Sequence[str] = (), format: str = "parquet") -> None:
    """[C8, C12, C17]"""
    df.write.mode("append").partitionBy(*partitions).format(format).save(path)


def overwrite_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """[C10] Only the partitions in ``df`` are replaced."""
    dealt = df.hint("rebalance", *partitions)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int, mode: str = "overwrite") -> None:
    """[C18] Ranges of ``columns`` lie together, so that readers skip by the files' statistics."""
    df.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode(mode).parquet(path)


def write_microbatch(path: str, partitions: Sequence[str] = (), row_bytes: int = 200, file_bytes: int = 5_000_000):
    """[C11] For ``foreachBatch``: nothing for an empty batch, else as many files as its rows need."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        rows = df.count()
        if rows:
            files = max(1, -(-rows * row_bytes // file_bytes))
            df.repartition(files).write.mode("append").partitionBy(*partitions).parquet(path)
        df.unpersist()

    return write


def write_documents(docs: DataFrame, folder: str) -> int:
    """[R1] One text file for each (``path``, ``text``) below a folder that all executors reach; returns their number. A file that is written again is replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = arrow_store(folder)
        made: set[str] = set()
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                at = f"{root}/{path}"
                if (parent := at.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(at) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return docs.select("path", "text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def replace_by_key(target: DataFrame | None, staged: DataFrame, keys: Sequence[str], run: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """[C13] The target after delete by key and insert, and one audit row (run, dataset, rows, status)."""
    audit = staged.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run_id"), F.lit(dataset).alias("dataset"), "rows", F.lit("loaded").alias("status"))
    return upsert(target, staged, keys), audit


def swap_snapshot(df: DataFrame, base: str, number: int) -> str:
    """[C1] A full new snapshot in a folder of its own; the caller moves its pointer to the path returned."""
    path = f"{base}/snapshot={number}"
    df.write.mode("errorifexists").parquet(path)
    return path
