"""A queue of payload bytes in a shared folder, read as a stream or as a batch.

A producer appends numbered segments: folders ``segment=000000007`` of text files, one Base64 payload a line. A segment
counts once its job has committed (``_SUCCESS``) and all before it have, so offsets are numbers that only grow, and
a restarted query goes on behind the last one that its checkpoint holds. A file is one task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "segment long, file string, position long, payload binary"
_ARROW = pa.schema([("segment", pa.int64()), ("file", pa.string()), ("position", pa.int64()), ("payload", pa.binary())])
_ROWS = 10_000  # of an Arrow batch


def append_segment(payloads: DataFrame, path: str, number: int, payload: str | Column = "payload") -> None:
    """[S7] The producer's side. A segment that did not commit may be written again."""
    text = F.base64(F.col(payload) if isinstance(payload, str) else payload)
    payloads.select(F.regexp_replace(text, r"\s", "").alias("value")).write.mode("overwrite").text(f"{path}/segment={number:09d}")


class _File(InputPartition):
    def __init__(self, segment: int, path: str) -> None:
        super().__init__(path)
        self.segment, self.path = segment, path


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _read(part: _File, path: str) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(path)
    name = part.path.rsplit("/", 1)[-1]
    rows: list[bytes] = []
    at = 0
    with pa.PythonFile(fs.open_input_stream(part.path), mode="r") as stream:
        rest = b""
        while True:
            block = stream.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            rows += [base64.b64decode(x) for x in lines if x or block]
            while len(rows) >= _ROWS or rows and not block:
                out, rows = rows[:_ROWS], rows[_ROWS:]
                n = len(out)
                yield pa.record_batch([pa.array([part.segment] * n, pa.int64()), pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), pa.array(out, pa.binary())], schema=_ARROW)
                at += n
            if not block:
                return


class _Folder:
    def __init__(self, path: str) -> None:
        self.path = path

    def _committed(self) -> int:
        """The last segment of the unbroken row of committed ones; -1 for none."""
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == arrow_fs.FileType.NotFound:
            return -1
        numbers = {int(m[1]) for info in fs.get_file_info(arrow_fs.FileSelector(root)) if (m := re.fullmatch(r"segment=(\d+)", info.base_name))}
        last = -1
        while last + 1 in numbers and fs.get_file_info(f"{root}/segment={last + 1:09d}/_SUCCESS").type == arrow_fs.FileType.File:
            last += 1
        return last

    def _files(self, after: int, to: int) -> list[_File]:
        fs, root = _open(self.path)
        out = []
        for n in range(after + 1, to + 1):
            found = fs.get_file_info(arrow_fs.FileSelector(f"{root}/segment={n:09d}"))
            out += [_File(n, info.path) for info in sorted(found, key=lambda i: i.path) if info.base_name.startswith("part-") and info.size]
        return out


class _Stream(DataSourceStreamReader, _Folder):
    def initialOffset(self) -> dict:
        return {"segment": -1}

    def latestOffset(self) -> dict:
        return {"segment": self._committed()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self._files(start["segment"], end["segment"])

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.path)

    def commit(self, end: dict) -> None: ...


class _Batch(DataSourceReader, _Folder):
    def partitions(self) -> Sequence[InputPartition]:
        return self._files(-1, self._committed())

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.path)


class PayloadQueue(DataSource):
    """[S7] ``spark.dataSource.register(PayloadQueue)``, then ``readStream.format("payload_queue").load(folder)``, from the earliest segment on."""

    @classmethod
    def name(cls) -> str:
        return "payload_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])
