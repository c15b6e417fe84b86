"""Streaming twins of the state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted_stream(log: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Times accepted at least ``hours`` after the one accepted before; the state of a key is one timestamp.

    ``log`` has the key and ``ts`` as a timestamp; the rows of a batch are taken in order of time.
    """
    gap = pd.Timedelta(hours=hours)
    kind = dict(log.dtypes)[key]

    def take(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for t in sorted(t for f in frames for t in f["ts"]):
            if last is None or t >= last + gap:
                out.append(t)
                last = t
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pd.DataFrame({key: [k[0]] * len(out), "accepted_at": out})

    return log.groupBy(key).applyInPandasWithState(take, f"{key} {kind}, accepted_at timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)


def latest_stream(events: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the last event of each key, for the update or complete mode."""
    return events.groupBy(key).agg(F.max_by(value, "ts").alias(value), F.max("ts").alias("ts"))


def health_stream(log: DataFrame, key: str) -> DataFrame:
    """State of each source after each batch, for the update mode; ``failed`` is a boolean.

    Counts run on, and the decision has hysteresis as in ``boards.health``: a batch is a run, and an open decision keeps the one before.
    """
    kind = dict(log.dtypes)[key]

    def add(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, errors, blocked = state.get if state.exists else (0, 0, False)
        for f in frames:
            total, errors = total + len(f), errors + int(f["failed"].sum())
        if total >= 3 and errors / total > 0.8:
            blocked = True
        elif total >= 3 and errors / total < 0.3:
            blocked = False
        state.update((total, errors, blocked))
        yield pd.DataFrame({key: [k[0]], "total": [total], "errors": [errors], "blocked": [blocked]})

    return log.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, total bigint, errors bigint, blocked boolean", "total bigint, errors bigint, blocked boolean", "update", GroupStateTimeout.NoTimeout)


def new_runs(spark: SparkSession, path: str, schema: str = "run_id string, finished_at timestamp", every: str | None = None, again: str = "7 days") -> tuple[DataFrame, dict]:
    """Summaries of runs as they are published under a folder, and the trigger to read them with: at an interval, or all that is there once.

    A run published again within ``again`` of the latest one is left out; ids older than that are forgotten, so the state stays as large as that span.
    """
    runs = spark.readStream.schema(schema).json(path).withWatermark("finished_at", again)
    return runs.dropDuplicatesWithinWatermark(["run_id"]), {"processingTime": every} if every else {"availableNow": True}
