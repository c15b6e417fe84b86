"""A streaming source of numbered updates with a monotone offset.

Updates lie in a folder as append-only Parquet segments, ``<first id>-<last id>.parquet``; none is changed once it has its name. The offset is the next id to be
read: a reader asks for what comes from there on, at most so many at a time, and never for what is before. Spark keeps the offsets of batches, so a query that stopped within one
reads the same ids again, and the tasks that read them open the segments themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_SEGMENT = re.compile(r"(\d+)-(\d+)\.parquet")


def _place(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def append_segment(path: str, rows: pa.Table) -> str:
    """Adds updates, in order of ``update_id`` and after all that are there, as a segment that readers see whole or not at all."""
    fs, folder = _place(path)
    fs.create_dir(folder)
    name = f"{rows['update_id'][0].as_py():019d}-{rows['update_id'][-1].as_py():019d}.parquet"
    pq.write_table(rows, f"{folder}/.{name}", filesystem=fs)
    fs.move(f"{folder}/.{name}", f"{folder}/{name}")
    return name


@dataclass
class Segment(InputPartition):
    """Updates of one segment, from the first id up to but without the last one."""

    file: str
    first: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.start, self.most = options["path"], int(options.get("offset", 0)), int(options.get("most", 100))
        self.note = options["progress"]
        self.columns = schema.names
        self.planned: int | None = None

    def _segments(self) -> list[tuple[int, int, str]]:
        fs, folder = _place(self.path)
        found = fs.get_file_info(pf.FileSelector(folder, allow_not_found=True))
        return sorted((int(m[1]), int(m[2]), f.base_name) for f in found if (m := _SEGMENT.fullmatch(f.base_name)))

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        """At most ``most`` ids after the batch planned last."""
        if self.planned is None:
            self.planned = self._noted()
        left, end = self.most, self.planned
        for first, last, name in self._segments():
            if last < self.planned or not left:
                continue
            ids = self._ids(name).filter(pc.greater_equal(self._ids(name), self.planned)) if first < self.planned or last - first >= left else None
            if ids is None:
                end, left = last + 1, left - (last - first + 1)
            elif len(ids):
                end, left = ids[min(left, len(ids)) - 1].as_py() + 1, left - min(left, len(ids))
        return {"next": end}

    def _noted(self) -> int:
        """Where the batch planned last has ended: a query that begins again plans the batches it has noted first, and each plan is noted."""
        fs, name = _place(self.note)
        if fs.get_file_info(name).type == pf.FileType.NotFound:
            return self.start
        with fs.open_input_stream(name) as f:
            return int(f.read())

    def _ids(self, name: str) -> pa.ChunkedArray:
        fs, folder = _place(self.path)
        return pq.read_table(f"{folder}/{name}", columns=["update_id"], filesystem=fs)["update_id"]

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.planned = max(self.planned or 0, end["next"])
        fs, name = _place(self.note)
        with fs.open_output_stream(f"{name}.next") as f:
            f.write(str(self.planned).encode())
        fs.move(f"{name}.next", name)
        return [Segment(name, max(first, start["next"]), min(last + 1, end["next"])) for first, last, name in self._segments() if last >= start["next"] and first < end["next"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(self.path)
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.columns):
                ids = batch.column("update_id")
                yield batch.filter(pc.and_(pc.greater_equal(ids, partition.first), pc.less(ids, partition.end))).select(self.columns)


class Updates(DataSource):
    """``spark.readStream.format("updates")`` after ``spark.dataSource.register(Updates)``.

    Options: ``path`` of the segments; ``progress``, a file of the query's own beside its checkpoint; ``most``, ids in a batch, 100 by default; ``offset``, the first id of a new query. The schema has ``update_id`` as
    a bigint and any other columns of the segments.
    """

    @classmethod
    def name(cls) -> str:
        return "updates"

    def schema(self) -> str:
        return "update_id bigint, chat_id bigint, body string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(schema, self.options)
