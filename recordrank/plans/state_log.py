"""Keyed state as an append-only log of commits: no writer's changes are lost, and a batch counts once however often it is written.

A commit is a folder of changed rows and a small file named by its version. The file is put in place by a rename that fails if the version is taken; then the writer
looks at what came between and takes the next one. It carries the last batch of each writer, so a replayed batch is known by the newest file alone, and the last snapshot, so
readers fold what came after it and no more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """A key that a commit changes was changed after the version that the commit was based on."""


class StateLog:
    """State of ``key`` to ``value`` under ``path``, in a file system with a rename that does not overwrite."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", value: str = "value", snapshot_every: int = 32):
        self.spark, self.path, self.key, self.value, self.every = spark, path.rstrip("/"), key, value, snapshot_every
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._at(f"{self.path}/commits"))

    def head(self) -> dict:
        """The newest commit; version 0 is the empty state."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/commits"))]
        versions = sorted(n for n in names if n.endswith(".json"))
        return self._read(int(versions[-1][:-5])) if versions else {"version": 0, "writers": {}, "snapshot": 0, "data": None, "kind": "snapshot"}

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/commits/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, commit: dict) -> bool:
        """Puts a commit in its place; false if another one is there already."""
        jvm = self.spark._jvm
        new, place = self._at(f"{self.path}/commits/.{uuid.uuid4().hex}"), self._at(f"{self.path}/commits/{commit['version']:012d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(new, place, options)
            return True
        except Exception as e:  # noqa: BLE001  any other failure than a taken version is the caller's
            self._fs.delete(new, False)
            if self._fs.exists(place):
                return False
            raise e

    def _data(self, commits: list[dict]) -> DataFrame:
        """Rows of commits with their version."""
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/c={c['data']}" for c in commits])
        versions = self.spark.createDataFrame([(c["data"], c["version"]) for c in commits], "c string, version long")
        return rows.join(versions, "c").drop("c")

    def _since(self, after: int, upto: int) -> list[dict]:
        return [c for c in (self._read(v) for v in range(after + 1, upto + 1)) if c["kind"] == "changes"]

    def commit(self, changes: DataFrame, writer: str, batch: int, based_on: int | None = None) -> int:
        """Adds a batch of ``changes(key, value, seq)`` and gives its version; a null value deletes, and of a key's changes the one of the largest ``seq`` counts.

        Batches of a writer come in order; one that is in the log already is left out. With ``based_on``, the version that the changes were made from, a change of the same
        keys since is a ``Conflict`` and nothing is added; without it, what is committed last stands.
        """
        if batch <= self.head()["writers"].get(writer, -1):
            return self.head()["version"]
        name = uuid.uuid4().hex
        place = f"{self.path}/data/c={name}"
        changes.groupBy(self.key).agg(F.max_by(F.struct(self.value), "seq").alias("_v")).select(self.key, f"_v.{self.value}").write.parquet(place)
        seen = based_on
        while True:
            head = self.head()
            if batch <= head["writers"].get(writer, -1):
                self._fs.delete(self._at(place), True)
                return head["version"]
            if seen is not None and (between := self._since(seen, head["version"])):
                mine = self.spark.read.parquet(place).select(self.key)
                if not self._data(between).join(mine, self.key, "left_semi").isEmpty():
                    self._fs.delete(self._at(place), True)
                    raise Conflict(f"keys of batch {batch} of {writer} have changed since version {based_on}")
                seen = head["version"]
            if self._publish({"version": head["version"] + 1, "kind": "changes", "writers": {**head["writers"], writer: batch}, "snapshot": head["snapshot"], "data": name}):
                return head["version"] + 1

    def state(self, version: int | None = None) -> DataFrame:
        """``(key, value)`` as of a version, by default the newest one."""
        head = self.head() if version is None else self._read(version) if version else {"version": 0, "snapshot": 0}
        commits = self._since(head["snapshot"], head["version"])
        if head["snapshot"]:
            commits.insert(0, self._read(head["snapshot"]))
        if not commits:
            return self.spark.createDataFrame([], f"`{self.key}` string, `{self.value}` string")
        last = self._data(commits).groupBy(self.key).agg(F.max_by(F.struct(self.value), "version").alias("_v"))
        return last.select(self.key, f"_v.{self.value}").where(F.col(self.value).isNotNull())

    def compact(self) -> int:
        """A snapshot of the newest state as a commit of its own, from which later reads begin."""
        while True:
            head = self.head()
            if head["kind"] == "snapshot":
                return head["version"]
            name = uuid.uuid4().hex
            self.state(head["version"]).write.parquet(f"{self.path}/data/c={name}")
            now = head["version"] + 1
            if self._publish({"version": now, "kind": "snapshot", "writers": head["writers"], "snapshot": now, "data": name}):
                return now
            self._fs.delete(self._at(f"{self.path}/data/c={name}"), True)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch is a commit, and a snapshot is made now and then."""

        def write(rows: DataFrame, batch: int) -> None:
            version = self.commit(rows, writer, batch)
            if version - self.head()["snapshot"] >= self.every:
                self.compact()

        return write
