"""Keyed state over two types of events in any order of arrival, held by buckets of keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which arbitrary state needs and which doesn't hold it in the heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


_HELD = pa.schema([("key", pa.string()), ("at_ms", pa.int64()), ("is_end", pa.bool_()), ("record", pa.string())])


class _Pairs(StatefulProcessor):
    """Of all keys of a bucket the starts, one each, and the ends that wait for them, as one Arrow table beside its next timer; times in milliseconds."""

    def __init__(self, wait: int, keep: int) -> None:
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", T.StructType([T.StructField("timer", T.LongType()), T.StructField("rows", T.BinaryType())]))

    def _held(self) -> tuple[int | None, pd.DataFrame]:
        if not self.open.exists():
            return None, _HELD.empty_table().to_pandas()
        timer, data = self.open.get()
        return timer, pa.ipc.open_stream(bytes(data)).read_all().to_pandas()

    def _over(self, rows: pd.DataFrame) -> pd.Series:
        """When the rows are given up."""
        return rows["at_ms"] + np.where(rows["is_end"].astype(bool), self.wait, self.keep)

    def _store(self, rows: pd.DataFrame, timer: int | None) -> None:
        """Replaces what is held; ``timer`` is the one that is still set."""
        due = int(self._over(rows).min()) if len(rows) else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.open.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _HELD) as w:
            w.write_table(pa.Table.from_pandas(rows, _HELD, preserve_index=False))
        self.open.update((due, out.getvalue().to_pybytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        timer, held = self._held()
        # A key's held start comes first, then the earliest of the batch; ends that met a start before don't fit it now.
        fresh = pd.concat([pdf[_HELD.names] for pdf in rows], ignore_index=True).sort_values(["at_ms", "record"])
        both = pd.concat([held, fresh], ignore_index=True).astype({"is_end": bool}) if len(held) else fresh.astype({"is_end": bool})
        starts, ends = both[~both["is_end"]].drop_duplicates("key"), both[both["is_end"]]
        met = ends[["key", "at_ms", "record"]].merge(starts[["key", "at_ms", "record"]], "left", "key", suffixes=("", "_start"))
        fits = ((met["at_ms"] - self.keep <= met["at_ms_start"]) & (met["at_ms_start"] <= met["at_ms"] + self.wait)).to_numpy()
        self._store(pd.concat([starts, ends[~fits]]), timer)
        if fits.any():
            done = met[fits]
            yield pd.DataFrame({"key": done["key"], "end": done["record"], "start": done["record_start"]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        timer, held = self._held()
        over = self._over(held) <= now
        if over.any():
            self._store(held[~over], None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        lost = held[over & held["is_end"].astype(bool)]
        if len(lost):
            yield pd.DataFrame({"key": lost["key"], "end": lost["record"], "start": pd.Series([None] * len(lost), dtype=object, index=lost.index)})


def paired(events: DataFrame, key: str, at: str, is_end: str, start_columns: Sequence[str], end_columns: Sequence[str], wait_seconds: int, keep_seconds: int, buckets: int = 256) -> DataFrame:
    """[M9, J12] One row for each end of a stream of starts and ends: the key, ``end_columns``, ``start_columns``, ``data_quality`` and ``record_source``.

    ``events`` has a watermark on ``at``; ``is_end`` tells ends from starts; the two lists share no name. An end that knows its start, which may be ``keep_seconds``
    older or ``wait_seconds`` younger, comes out at once as 'ok'. One without is held until the watermark has passed it by ``wait_seconds`` and comes
    out as 'missing_start' then. A key has one start: of several in a batch the earliest, later ones are left out.
    Its state goes by timers, so it is as large as what is open. Python is called once for each of the ``buckets`` of keys and batch, not for each key: choose them so
    that a bucket's rows of a batch and what it has open are some ten thousand rows; a checkpoint keeps its number. Keys are of a type that Spark casts to text
    and back. Start the query inside :func:`state_store`.
    """
    record = lambda columns: F.to_json(F.struct(*columns), _TIMES)
    rows = events.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).cast("string").alias("key"), F.col(at), F.unix_millis(at).alias("at_ms"), F.col(is_end).alias("is_end"), F.when(F.col(is_end), record(end_columns)).otherwise(record(start_columns)).alias("record")
    )
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("end", T.StringType()), T.StructField("start", T.StringType())])
    pairs = rows.groupBy("bucket").transformWithStateInPandas(_Pairs(wait_seconds * 1000, keep_seconds * 1000), outputStructType=out, outputMode="Append", timeMode="EventTime")
    shape = lambda columns: T.StructType([events.schema[c] for c in columns])
    ok = F.col("start").isNotNull()
    return pairs.select(
        F.col("key").cast(kind).alias(key), F.from_json("end", shape(end_columns), _TIMES).alias("_end"), F.from_json("start", shape(start_columns), _TIMES).alias("_start"),
        F.when(ok, "ok").otherwise("missing_start").alias("data_quality"), F.when(ok, "trip_end_update").otherwise("trip_end_upsert").alias("record_source"),
    ).select(key, "_end.*", "_start.*", "data_quality", "record_source")
