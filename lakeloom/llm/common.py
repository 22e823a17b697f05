"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in the corpus contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's checkpoint folder, its lineage cut.

    The folder is the one in ``spark.checkpoint.dir``; only where that is
    unset on one machine (a local master, as in tests) a temporary folder is used; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def clean_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def own_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only ``names`` of ``df``, so that further columns can't clash."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def whole_row(df: DataFrame) -> Column:
    """All columns as one, ``_row``: beside it no name can clash; ``_row.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def id_text(id_col: str) -> Column:
    """An id as text, for Python batches: pandas would make numbers with nulls floats."""
    return F.col(id_col).cast("string").alias("_id")


def id_back(docs: DataFrame, id_col: str) -> Column:
    """The id of a Python batch in the type that it has in ``docs``: any that Spark casts to text and back."""
    return F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col)
