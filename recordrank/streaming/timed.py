"""Streams that act on time: reminders that fire when due, and progress messages with a pause between them.

Both take the rows of a key in order of event time, whatever order they come in: rows are held until the watermark has passed them, and a timer wakes the key
for the next row or the next due time. So a stream gives what a fold over the sorted log gives, over restarts as well, and a key's state is its fold's state and the rows within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that streams with timers need; set it as ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Folds each key's rows in order of their first two columns, microseconds and a number that breaks ties.

    A subclass has the schemas of rows, state and what it emits, a rule, ``step(state, row)``, ``due(state)`` and ``fire(state, at)``; the first and last give the new state and what they emit.
    """

    rows: str
    state: str
    emits: str
    empty: tuple

    def __init__(self, key: str, rule: Any):
        self.key, self.rule = key, rule

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """Microseconds at which the state acts by itself."""
        return None

    def fire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.rows)
        self.kept = handle.getValueState("state", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        width = len(self.rows.split(","))
        return self._advance(key, [*map(tuple, self.held.get()), *(tuple(r)[-width:] for r in rows)], timerValues)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, list(map(tuple, self.held.get())), timerValues)

    def _advance(self, key: Any, rows: list[tuple], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.kept.get()
        state, out = tuple(kept) if kept is not None else self.empty, []
        rows.sort(key=lambda r: r[:2])
        at = 0
        while True:
            row = rows[at] if at < len(rows) and rows[at][0] <= mark else None
            due = self.due(state)
            if due is not None and due <= (row[0] if row else mark):
                state, more = self.fire(state, due)
            elif row:
                state, more = self.step(state, row)
                at += 1
            else:
                break
            out += more
        if at < len(rows):
            self.held.put(rows[at:])
        elif self.held.exists():
            self.held.clear()
        if state != self.empty:
            self.kept.update(state)
        elif kept is not None:
            self.kept.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wake = [t for t in (rows[at][0] if at < len(rows) else None, due) if t is not None]
        if wake:
            # in milliseconds, rounded up
            self.handle.registerTimer(-(-min(wake) // 1000))
        names = [self.key, *(c.split()[0] for c in self.emits.split(", "))]
        for r in out:
            yield Row(**dict(zip(names, (*key, *r))))

    def close(self) -> None:
        pass


class _Reminders(OrderedFold):
    rows = "at bigint, seq bigint, remind boolean, due bigint, status string"
    state = "due bigint, status string, open boolean"
    emits = "due bigint, fired bigint, status string"
    empty = (None, None, False)

    def step(self, state, row):
        due, status, open_ = state
        at, _, remind, new_due, new_status = row
        if remind:
            due, open_ = new_due, new_due is not None
        else:
            status = new_status
        state = (due if open_ else None, status, open_)
        return self.fire(state, at) if open_ and self._active(status) and due <= at else (state, [])

    def _active(self, status):
        return status is not None and status != self.rule

    def due(self, state):
        return state[0] if state[2] and self._active(state[1]) else None

    def fire(self, state, at):
        return (None, state[1], False), [(state[0], at, state[1])]


def reminders(events: DataFrame, key: str, late: str = "10 minutes", last: str = "result") -> DataFrame:
    """``(key, remind_at, fired_at, status)`` for each reminder that falls due while its key has a status other than ``last``; in append mode.

    ``events`` has ``ts``, ``seq`` and ``kind``: a ``remind`` sets the key's reminder to ``remind_at``, null deletes it; a ``status`` sets its ``status``, null takes it off the board.
    A reminder fires once: when it is due, or, if its time is past when it is set or when the key becomes active, at that event. A changed or deleted one does not. An event at the very time of
    a reminder comes after it.
    """
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("bigint").alias("seq"), (F.col("kind") == "remind").alias("remind"), F.unix_micros("remind_at").alias("due"), "status")
    fired = rows.groupBy(key).transformWithState(_Reminders(key, last), f"`{key}` {kind}, {_Reminders.emits}", "append", "eventTime")
    return fired.select(key, F.timestamp_micros("due").alias("remind_at"), F.timestamp_micros("fired").alias("fired_at"), "status")


def reminders_until(events: DataFrame, key: str, until: Column, last: str = "result") -> DataFrame:
    """What ``reminders`` has given once all events up to ``until`` are in and their times past: the same over a table."""
    events = events.where(F.col("ts") <= until)
    before = Window.partitionBy(key).orderBy("ts", "seq")
    sets, status = F.col("kind") == "remind", F.last(F.when(F.col("kind") == "status", F.struct("status")), ignorenulls=True).over(before)["status"]
    # between an event and the next one, the reminder set last and the status set last hold
    held = events.withColumn("_set", F.last(F.when(sets, F.struct(F.col("seq").alias("set"), F.col("remind_at").alias("due"))), ignorenulls=True).over(before)).withColumn("_status", status).withColumn("_next", F.coalesce(F.lead("ts").over(before), until))
    fires = held.where(F.col("_set.due").isNotNull() & F.col("_status").isNotNull() & (F.col("_status") != last) & (F.col("_set.due") <= F.col("_next")))
    once = fires.groupBy(key, "_set").agg(F.min_by(F.struct(F.greatest("_set.due", "ts").alias("fired_at"), F.col("_status").alias("status")), F.struct("ts", "seq")).alias("f"))
    return once.select(key, F.col("_set.due").alias("remind_at"), "f.fired_at", "f.status")


# Cue words of the log's lines, in the order in which they are looked for.
DISCOVERY, LINKS, DETAIL, PAGE = "Discovering:", ("Page", "links"), "[DETAIL MODE]", "Parsing detail:"


def progress_lines(lines: DataFrame) -> DataFrame:
    """Log lines as ``phase, source, links, step, total``; the phase is null for lines that say nothing of progress."""
    has = lambda word: F.contains("line", F.lit(word))
    line = F.trim("line")
    number = lambda pattern, group=1: F.regexp_extract(line, pattern, group).try_cast("int")
    phase = F.when(has(DISCOVERY), "discovery").when(has(LINKS[0]) & has(LINKS[1]), "links").when(has(DETAIL), "detail").when(has(PAGE), "pages")
    source = F.when(phase == "discovery", F.left(F.trim(F.element_at(F.split(line, DISCOVERY), -1)), F.lit(40)))
    links = F.when(phase == "links", number(r"total (\d+)")).when(phase == "detail", number(r"(\d+) new links"))
    place = r"\[(\d+)/(\d+)\]"
    return lines.withColumns({"phase": phase, "source": source, "links": links, "step": F.when(phase == "pages", number(place)), "total": F.when(phase == "pages", number(place, 2))})


class _Progress(OrderedFold):
    rows = "at bigint, seq bigint, phase string, source string, links int, step int, total int"
    state = "links int, detail boolean, sent bigint"
    emits = "at bigint, phase string, source string, links int, step int, total int, percent int"
    empty = (None, None, None)

    def step(self, state, row):
        at, _, phase, source, links, step, total = row
        # a job's clock starts with its first line
        found, detail, sent = state if state[2] is not None else (0, False, at)
        found = links if links is not None else found
        free = at - sent >= self.rule
        out = []
        if phase == "discovery" and free:
            out = [(at, phase, source, found, None, None, None)]
        elif phase == "detail":
            detail, out = True, [(at, phase, None, found, None, None, None)]
        elif phase == "pages" and detail and free and step is not None:
            out = [(at, phase, None, found, step, total, int(step / total * 100) if total > 0 else 0)]
        return (found, detail, at if out else sent), out


def progress(lines: DataFrame, key: str, late: str = "1 minute", pause: float = 8.0) -> DataFrame:
    """Progress messages of jobs, ``pause`` seconds or more after the last one sent: ``(key, ts, phase, source, links, step, total, percent)``; in append mode.

    ``lines`` has the job's ``key``, ``ts``, ``seq`` and ``line``. Messages on discovery and on pages wait for the pause, and are left out within it; the one that opens the pages goes at once. Links found
    are carried on. Messages on pages need that opening. Lines without progress count for nothing but a job's first moment.
    """
    kind = dict(lines.dtypes)[key]
    rows = progress_lines(lines.withWatermark("ts", late)).where(F.trim("line") != "").select(key, "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("bigint").alias("seq"), "phase", "source", "links", "step", "total")
    sent = rows.groupBy(key).transformWithState(_Progress(key, round(pause * 1e6)), f"`{key}` {kind}, {_Progress.emits}", "append", "eventTime")
    return sent.select(key, F.timestamp_micros("at").alias("ts"), "phase", "source", "links", "step", "total", "percent")
