"""Layouts that save work later: clustering on several columns, bucketed tables for joins without a shuffle, payloads of drifting shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: the number itself, micro seconds, or the first seven bytes of a text."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = 6) -> Column:
    """[C18] A key along a space-filling curve: the bits of each column's range rank in turn, the highest first.

    Ranks come from the columns' approximate quantiles (one aggregation of bounded size), so ranges hold equally many rows, whatever the
    values; ``bits`` times the number of columns is 62 at most. Nulls have rank 0.
    """
    if bits * len(columns) > 62:
        raise ValueError("too many bits for a key")
    shares = [i / 2**bits for i in range(1, 2**bits)]
    bounds = df.agg(*[F.percentile_approx(_number(df, c), shares, 10_000).alias(f"b{j}") for j, c in enumerate(columns)]).head()
    key = F.lit(0).cast("long")
    for j, c in enumerate(columns):
        x = _number(df, c)
        rank = F.lit(0)
        for b in sorted(set(bounds[j] or [])):
            rank = rank + F.when(x > F.lit(b), 1).otherwise(0)
        # Repeated bounds are one; ranks are spread over the whole range again, so that every column counts alike.
        steps = max(1, len(set(bounds[j] or [])))
        rank = F.floor(rank * (2**bits - 1) / steps).cast("long")
        for i in range(bits):
            key = key + F.shiftleft(F.shiftright(rank, i).bitwiseAND(1), i * len(columns) + len(columns) - 1 - j)
    return key


def write_interleaved(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = 6, mode: str = "overwrite", row_group_bytes: int | None = None) -> None:
    """[C18] Rows near in all of ``columns`` lie together: a filter on any of them skips files and row groups by their statistics."""
    keyed = df.withColumn("_curve", interleaved(df, columns, bits))
    writer = keyed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve").write.mode(mode)
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """[J10] An external table whose files are dealt by a hash of ``keys`` and sorted by them.

    Tables with equal ``buckets`` join on their keys, and group by them, without a shuffle: see :func:`join_bucketed`.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def join_bucketed(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """[J10] ``base`` left-joined with one-row-a-key parts, all of tables bucketed on ``keys``: sort-merge joins where the rows lie."""
    for part in parts:
        base = base.join(part.hint("merge"), list(keys), "left")
    return base


def found_schema(df: DataFrame, payload: str) -> T.StructType:
    """[S19, C14] The schema of all JSON payloads of a column, found by one aggregation; a field of unlike types stays VARIANT, one that is always null is text."""
    text = df.agg(F.schema_of_variant_agg(F.try_parse_json(payload)).alias("s")).head()["s"]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType([])
    kind = T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))
    assert isinstance(kind, T.StructType)
    return kind


def drifting(df: DataFrame, payload: str, keep: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """[S19, C14] Columns for every field that any payload has, nested ones as ``outer_inner``; arrays and fields of unlike types as JSON text.

    Payloads are JSON of whatever shapes; a field that a payload lacks is null, as are all of a payload that is no JSON. ``schema`` is :func:`found_schema`'s unless given.
    """
    schema = found_schema(df, payload) if schema is None else schema
    rows = df.select(*keep, F.try_parse_json(payload).alias("_v"))
    out: list[Column] = []

    def walk(fields: T.StructType, path: str, name: str) -> None:
        for f in fields.fields:
            at, own = f"{path}['{f.name}']", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                walk(f.dataType, at, f"{own}_")
            elif isinstance(f.dataType, (T.ArrayType, T.VariantType, T.StructType)):
                out.append(F.to_json(F.variant_get("_v", at, "variant")).alias(own))
            else:
                out.append(F.try_variant_get("_v", at, f.dataType.simpleString()).alias(own))

    walk(schema, "$", "")
    return rows.select(*keep, *out)

