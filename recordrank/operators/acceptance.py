"""Acceptance over time: per key, the times that lie a gap or more after the time accepted before.

The log is cut into ranges of (key, time), each sorted, and a range is folded as it streams by: the state of a key is one time. A key that is spread over
ranges enters each of them with the state that the ranges before have left. A range that lies inside a key is a function from the state on entry to the
state on exit: a step function, of steps for the times of its first gap only. These functions are composed in pairs, level by level, and states go down the levels again,
so a key with any share of the log is folded by all tasks and its times are never in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import root, written

_END = np.iinfo(np.int64).max
_TABLE = "chain int, pos int, times array<bigint>, exits array<bigint>"


def _next(times: np.ndarray, forced: np.ndarray, gap: int) -> np.ndarray:
    """For each time, where the one accepted after it is, or the length."""
    after = np.searchsorted(times, times + gap)
    where = np.append(np.flatnonzero(forced), len(times))
    return np.minimum(after, where[np.searchsorted(where, np.arange(len(times)), "right")])


def _accepted(times: np.ndarray, forced: np.ndarray, state: int | None, gap: int) -> np.ndarray:
    """Places of the accepted times, from the last accepted time before them."""
    must = np.append(np.flatnonzero(forced), len(times))
    at = 0 if state is None else min(int(np.searchsorted(times, state + gap)), int(must[0]))
    out = []
    while at < len(times):
        out.append(at)
        at = min(int(np.searchsorted(times, times[at] + gap)), int(must[np.searchsorted(must, at, "right")]))
    return np.array(out, np.int64)


def step_function(times: np.ndarray, forced: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """A range's steps: where the first time no less than ``state + gap`` is among the former, the exit is among the latter; a later state stays."""
    to = np.append(_next(times, forced, gap), len(times))
    last = np.where(to < len(times), to, np.arange(len(to)))
    while (last != last[last]).any():
        last = last[last]
    # no state on entry is later than the first time, so it leads to a time within the first gap or the one after
    steps = int(np.searchsorted(times, times[0] + gap)) + 1
    first = int(np.argmax(forced)) if forced.any() else len(times)
    upto = min(steps, first + 1, len(times))
    bounds = times[:upto].copy()
    if first < upto:
        bounds[-1] = _END
    return bounds, times[last[:upto]]


def enter(times: np.ndarray, exits: np.ndarray, states: np.ndarray, gap: int) -> np.ndarray:
    """The states on exit from a range."""
    at = np.searchsorted(times, states + gap)
    return np.where(at < len(times), exits[np.minimum(at, len(exits) - 1)], states)


def compose(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of a range and the one after it as one."""
    more = g[0] > f[0][-1] if f[0][-1] < _END else np.zeros(len(g[0]), bool)
    return np.concatenate([f[0], g[0][more]]), np.concatenate([enter(*g, f[1], gap), g[1][more]])


def _runs(batch: pa.RecordBatch) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bounds of a sorted batch's keys, its times in microseconds, and which are forced."""
    keys = batch.column(0)
    change = np.zeros(0, bool)
    if len(keys) > 1:
        a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
        same = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
        change = ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]
    return bounds, batch.column(1).cast(pa.int64()).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)


def _outline(key_type: str, gap: int):
    """What a range tells of itself: its first and last key, the state of the last one where nothing came before, and its steps if it has one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tail, whole, kind = None, [], True, None
        last: Any = None
        for batch in batches:
            if not len(batch):
                continue
            bounds, times, forced = _runs(batch)
            keys = batch.column(0)
            if kind is None:
                kind, first = keys.type, keys[0].as_py()
            elif last != keys[0].as_py():
                whole, tail = False, []
            if len(bounds) > 2:
                whole, tail = False, []
            last = keys[len(keys) - 1].as_py()
            tail.append((times[bounds[-2] :], forced[bounds[-2] :]))
        if kind is None:
            return
        times, forced = (np.concatenate(x) for x in zip(*tail))
        steps = step_function(times, forced, gap) if whole else (None, None)
        exit_ = int(times[_accepted(times, forced, None, gap)[-1]])
        columns = {"piece": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], kind), "last": pa.array([last], kind), "whole": pa.array([whole]), "left": pa.array([exit_], pa.int64()), "times": pa.array([steps[0]], pa.list_(pa.int64())), "exits": pa.array([steps[1]], pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(columns)

    return run, f"piece int, first {key_type}, last {key_type}, whole boolean, left bigint, times array<bigint>, exits array<bigint>"


def _pair(gap: int):
    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["pos"])
        tables = [(np.array(r["times"], np.int64), np.array(r["exits"], np.int64)) for r in rows]
        times, exits = compose(*tables, gap) if len(tables) > 1 else tables[0]
        return pa.table({"chain": pa.array([rows[0]["chain"]], pa.int32()), "pos": pa.array([rows[0]["pos"] // 2], pa.int32()), "times": pa.array([times], pa.list_(pa.int64())), "exits": pa.array([exits], pa.list_(pa.int64()))})

    return run


def _leave(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int(enter(np.array(t, np.int64), np.array(e, np.int64), np.array([s]), gap)[0]) for t, e, s in zip(*(batch.column(c).to_pylist() for c in ("times", "exits", "state")))]
            yield pa.RecordBatch.from_arrays([batch.column("chain"), batch.column("pos"), pa.array(out, pa.int64())], names=["chain", "pos", "state"])

    return run


def _states(nodes: DataFrame, start: dict[int, int], length: dict[int, int], gap: int) -> dict[tuple[int, int], int]:
    """States before each range of the chains and after the last one. ``nodes`` has their steps by place in the chain."""
    spark = nodes.sparkSession
    levels = [nodes]
    sizes = [dict(length)]
    while max(sizes[-1].values()) > 1:
        levels.append(written(levels[-1].groupBy("chain", F.floor(F.col("pos") / 2)).applyInArrow(_pair(gap), _TABLE), "acceptance"))
        sizes.append({c: -(-n // 2) for c, n in sizes[-1].items()})

    def after(level: int, states: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        asked = spark.createDataFrame([(c, p, s) for (c, p), s in states.items()], "chain int, pos int, state bigint")
        rows = levels[level].join(asked, ["chain", "pos"]).mapInArrow(_leave(gap), "chain int, pos int, state bigint")
        return {(r.chain, r.pos): r.state for r in rows.collect()}

    states = {(c, 0): s for c, s in start.items()}
    for level in range(len(levels) - 2, -1, -1):
        left = {(c, 2 * p): s for (c, p), s in states.items()}
        pairs = {(c, p): s for (c, p), s in left.items() if p + 1 < sizes[level][c]}
        states = left | {(c, p + 1): s for (c, p), s in (after(level, pairs) if pairs else {}).items()}
    ends = after(0, {(c, n - 1): states[c, n - 1] for c, n in length.items()})
    return states | {(c, p + 1): s for (c, p), s in ends.items()}


def accepted(log: DataFrame, key: str, gap: str = "interval 24 hours", forced: Column | None = None) -> DataFrame:
    """``(key, accepted_at)``: times of ``log(key, ts)`` at least ``gap`` after the key's time accepted before; the first one is accepted.

    Where ``forced`` holds, a time is accepted whatever came before, and counts for those after it. Equal times of a key are one, forced if any of them is. A null
    key is a key; a null time is never accepted. The driver gets the first and last key of each range and a state for it, not more.
    """
    spark = log.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = log.schema[key].dataType.simpleString()
    micros = int(spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(gap))).first()[0])
    rows = log.where(F.col("ts").isNotNull()).groupBy(key, "ts").agg(F.max(F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)).alias("_f"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root(spark))
    # ranges are kept as they are: both passes must see the same ones
    ranges = rows.repartitionByRange(pieces, key, "ts").sortWithinPartitions(key, "ts").checkpoint()
    run, schema = _outline(kind, micros)
    outline = written(ranges.mapInArrow(run, schema), "acceptance")
    known = sorted(outline.drop("times", "exits").collect(), key=lambda r: r.piece)
    # the state on entry is known after a range in which the key begins; ranges inside a key form chains of a first state, ranges, and the one after them
    entry: dict[int, int] = {}
    chains: list[tuple[int, list[int], list[int]]] = []
    for before, now in zip(known, known[1:]):
        if before.last != now.first:
            continue
        if before.whole and chains and chains[-1][2] == [before.piece]:
            chains[-1][1].append(before.piece)
            chains[-1][2][:] = [now.piece]
        elif before.whole and before.piece in entry:
            chains.append((entry[before.piece], [before.piece], [now.piece]))
        else:
            entry[now.piece] = before.left
    if chains:
        place = spark.createDataFrame([(p, c, i) for c, (_, ps, _) in enumerate(chains) for i, p in enumerate(ps)], "piece int, chain int, pos int")
        found = _states(outline.join(place, "piece").select("chain", "pos", "times", "exits"), {c: s for c, (s, *_) in enumerate(chains)}, {c: len(ps) for c, (_, ps, _) in enumerate(chains)}, micros)
        for (c, i), state in found.items():
            _, ps, last = chains[c]
            entry[(ps + last)[i]] = state
    states = spark.sparkContext.broadcast(entry)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = states.value.get(TaskContext.get().partitionId()), None, False
        for batch in batches:
            if not len(batch):
                continue
            bounds, times, must = _runs(batch)
            keys, taken = batch.column(0), []
            for i, j in zip(bounds, bounds[1:]):
                if begun and (i or keys[0].as_py() != last):
                    state = None
                begun = True
                hits = _accepted(times[i:j], must[i:j], state, micros)
                if len(hits):
                    state = int(times[i + hits[-1]])
                    taken.append(hits + i)
            last = keys[len(keys) - 1].as_py()
            where = pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([keys.take(where), batch.column(1).take(where)], names=[key, "accepted_at"])

    return ranges.mapInArrow(fold, f"`{key}` {kind}, accepted_at {log.schema['ts'].dataType.simpleString()}")
