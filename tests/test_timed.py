"""Reminders and progress as streams, over restarts and out of order, against folds over the whole log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recordrank.streaming.timed import STATE_STORE, progress, reminders, reminders_until

BEGIN = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
at = lambda s: BEGIN + dt.timedelta(seconds=s)


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, batches, schema, make):
    """Batches written one by one; the query is stopped and started again after each."""
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        make(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def fold_reminders(rows, until):
    """``rows`` are (id, second, seq, kind, due, status)."""
    out = []
    for k in {r[0] for r in rows}:
        due = status = None
        for _, s, _, kind, d, st in [*sorted((r for r in rows if r[0] == k and r[1] <= until), key=lambda r: r[1:3]), (k, until, 0, None, None, None)]:
            active = status is not None and status != "result"
            if due is not None and active and due <= s:
                out.append((k, due, due, status))
                due = None
            if kind == "remind":
                due = d
            elif kind == "status":
                status = st
            if kind and due is not None and status is not None and status != "result" and due <= s:
                out.append((k, due, s, status))
                due = None
    return sorted(out)


def test_reminders(store, tmp_path):
    spark, rng = store, random.Random(4)
    rows = []
    for i in range(260):
        s = i * 7 + rng.randint(0, 6)
        kind = rng.choice(["remind", "status"])
        rows.append((rng.randint(0, 9), s, i, kind, rng.choice([None, *[s + rng.randint(-60, 300)] * 5]) if kind == "remind" else None, rng.choice(["applied", "interview", "result", None]) if kind == "status" else None))
    rows += [(3, 500, 900, "status", None, "applied"), (3, 500, 901, "remind", 520, None), (3, 520, 902, "remind", None, None)]
    rows.sort(key=lambda r: r[1] + random.Random(r[2]).randint(0, 50))
    rows.append((77, 4000, 999, "status", None, None))
    schema = "id long, ts timestamp, seq long, kind string, remind_at timestamp, status string"
    typed = [(k, at(s), n, kind, None if d is None else at(d), st) for k, s, n, kind, d, st in rows]
    cut = [0, 60, 61, 150, len(typed) - 1, len(typed)]
    out = run(spark, tmp_path, [typed[a:b] for a, b in zip(cut, cut[1:])], schema, lambda s: reminders(s, "id", "60 seconds"))
    got = sorted((r.id, int(r.remind_at.timestamp()), int(r.fired_at.timestamp()), r.status) for r in out.collect())
    begin = int(BEGIN.timestamp())
    want = [(k, d + begin, f + begin, s) for k, d, f, s in fold_reminders(rows, 3940)]
    assert got == want and len(want) > 20
    table = spark.createDataFrame(typed, schema)
    for until in (3940, 1000, 523, 520):
        batch = reminders_until(table, "id", F.lit(at(until)))
        assert sorted((r.id, int(r.remind_at.timestamp()) - begin, int(r.fired_at.timestamp()) - begin, r.status) for r in batch.collect()) == fold_reminders(rows, until)


def fold_progress(rows, pause=8):
    out, jobs = [], {}
    for job, s, _, line in sorted(rows, key=lambda r: (r[1], r[2])):
        if not line.strip():
            continue
        j = jobs.setdefault(job, {"n": 0, "detail": False, "last": s})
        free = s - j["last"] >= pause
        sent = None
        if "Discovering:" in line:
            if free:
                sent = ("discovery", line.split("Discovering:")[-1].strip()[:40], j["n"], None)
        elif "Page" in line and "links" in line:
            if "total " in line:
                j["n"] = int(line.split("total ")[1].split()[0])
        elif "[DETAIL MODE]" in line:
            j["n"] = int(line.split(" new links")[0].split()[-1]) if " new links" in line else j["n"]
            j["detail"], sent = True, ("detail", None, j["n"], None)
        elif j["detail"] and "Parsing detail:" in line and free and "/" in line:
            a, b = map(int, line.split("[")[1].split("]")[0].split("/"))
            sent = ("pages", None, j["n"], int(a / b * 100) if b else 0)
        if sent:
            out.append((job, s, *sent))
            j["last"] = s
    return sorted(out, key=str)


def test_progress_of_interleaved_jobs(store, tmp_path):
    spark, rng = store, random.Random(8)
    rows, n = [], 0
    for job in "abc":
        s = rng.randint(0, 5)
        for i in range(120):
            s += rng.choice([0, 1, 1, 2, 5])
            line = rng.choice(["noise", "", f"Discovering: Board {i}", f"Page {i}: 3 links, total {i * 3}", "Page without number of links", f"  Parsing detail: [{i}/{rng.choice([0, 50, 100, 119])}] x", "Parsing detail: x"])
            if i in (40, 90):
                line = f"[DETAIL MODE] {i} new links" if i == 40 else "[DETAIL MODE] again"
            rows.append((job, s, n, line))
            n += 1
    rows.sort(key=lambda r: r[1] + random.Random(r[2]).randint(0, 9))
    rows.append(("z", 5000, n, "end"))
    typed = [(j, at(s), i, line) for j, s, i, line in rows]
    cut = [0, 40, 200, 210, len(typed) - 1, len(typed)]
    out = run(spark, tmp_path, [typed[a:b] for a, b in zip(cut, cut[1:])], "job string, ts timestamp, seq long, line string", lambda s: progress(s, "job", "10 seconds"))
    begin = int(BEGIN.timestamp())
    got = sorted(((r.job, int(r.ts.timestamp()) - begin, r.phase, r.source, r.links, r.percent) for r in out.collect()), key=str)
    want = fold_progress(rows)
    assert got == want and len({r[2] for r in want}) == 3
