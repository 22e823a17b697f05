"""Exact dedup: 128-bit content hash, byte comparison inside the groups.

The documents are grouped by (MD5 of the text, text): the shuffle is dealt by
the hash, the aggregation compares whole texts, so two texts whose hashes
collide stay apart. Copies within a task collapse before the shuffle
(map-side combine), so one text that makes up a third of all rows reaches the
reducer as one row a task. Verdicts go back to the rows by MD5 and SHA-256;
that join moves three short columns and Spark splits its hot keys (AQE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` ("min" or "max") says which id of equal texts stays. A null text
    equals the empty text. Null ids never win over others; a class of null ids
    only has a null ``keep_id`` and keeps all its rows. Rows that repeat an id
    with the same text share its verdict. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), clean_text(text_col).alias("_text"))
    classes = (
        rows.groupBy(F.md5("_text").alias("_md5"), "_text")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_md5", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    keyed = rows.select("_id", F.md5("_text").alias("_md5"), F.sha2("_text", 256).alias("text_sha256"))
    found = keyed.join(classes, (keyed["_md5"] == classes["_md5"]) & (keyed["text_sha256"] == classes["_sha"]))
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each text, with all its columns: the one with the smallest ("min") or largest ("max") id.

    The row is chosen in the aggregation, so neither repeated ids nor null ids bring a copy back. Null ids
    never win over others; rows that share text and id differ at most in other columns, one of them stays.
    """
    best = {"min": F.min_by, "max": F.max_by}[keep]
    none = F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    order = F.struct(none, F.col(id_col), F.xxhash64(*others, *[c.isNull() for c in others], F.col(text_col).isNull()))
    row = F.struct(F.col(text_col).isNull().alias("_null"), *others)
    classes = docs.groupBy(F.md5(clean_text(text_col)).alias("_md5"), clean_text(text_col).alias("_text")).agg(best(row, order).alias("_row"))
    text = F.when(~F.col("_row")["_null"], F.col("_text")).alias(text_col)
    return classes.select(*[text if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
