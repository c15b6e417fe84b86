"""The source of numbered updates over restarts, and model scores with a cache, against plain Python."""

import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordrank.plans.model_scores import answers, model_scores
from recordrank.streaming.updates import Updates, append_segment


def add(path, ids):
    append_segment(str(path), pa.table({"update_id": pa.array(ids, pa.int64()), "chat_id": pa.array([i % 3 for i in ids], pa.int64()), "body": [f"/cmd {i}" for i in ids]}))


def test_neither_lost_nor_repeated(spark, tmp_path):
    spark.dataSource.register(Updates)
    seen, failing = [], {"at": None}

    def take(rows, batch):
        got = sorted(r.update_id for r in rows.collect())
        if failing["at"] is not None and failing["at"] in got:
            failing["at"] = None
            raise RuntimeError("stopped within a batch")
        seen.append((batch, got))

    def run():
        source = spark.readStream.format("updates").option("path", str(tmp_path / "log")).option("progress", str(tmp_path / "next")).option("most", "7").option("offset", "5").load()
        q = source.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    add(tmp_path / "log", [1, 3, 5, 6])
    add(tmp_path / "log", [10, 11, 20, 21, 22, 23, 24, 25, 26])
    run()
    failing["at"] = 42
    add(tmp_path / "log", list(range(40, 60, 2)))
    with pytest.raises(Exception, match="stopped within"):
        run()
    add(tmp_path / "log", [70])
    run()
    run()
    ids = [i for _, got in seen for i in got]
    assert ids == [5, 6, 10, 11, 20, 21, 22, 23, 24, 25, 26, *range(40, 60, 2), 70]
    assert all(len(got) <= 7 for _, got in seen) and len({b for b, _ in seen}) == len(seen)


def test_model_is_asked_for_misses_only(spark, tmp_path):
    now = dt.datetime(2026, 5, 24)
    rows = [(i, f"http://x/{i}" if i % 5 else None, f"t{i}", None, "d", None, float(50 + i), 70, "2026-05-01", ["a", "b"]) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, job_url string, job_title string, company string, job_description_summary string, requirements string, match_score double, data_confidence int, date_posted string, why_match array<string>")
    cache = spark.createDataFrame([("http://x/39", 10.0, "old", "", now - dt.timedelta(days=8)), ("http://x/38", 20.0, "kept", "Rp1", now - dt.timedelta(days=2)), ("http://x/38", 30.0, "older", "", now - dt.timedelta(days=3))], "job_url string, semantic_score double, reasoning string, salary string, ts timestamp")
    log = tmp_path / "asked"
    log.mkdir()

    def model(some):
        out = []
        for r in some:
            i = r["seq"]
            with open(log / f"{i}", "a") as f:
                f.write("x")
            out.append("not json" if i == 37 else "```json" + json.dumps({"semantic_score": None if i == 36 else i, "reasoning": f"r{i}", "estimated_salary_min": 5 if i == 35 else 0, "estimated_salary_max": None}) + "```")
        return out

    out, fresh = model_scores(df, cache, model, F.lit(now))
    got = {r.seq: r for r in out.collect()}
    fresh = spark.createDataFrame(fresh.collect(), cache.schema)
    assert {p.name: p.read_text() for p in log.iterdir()} == {str(i): "x" for i in range(20, 40) if i != 38}
    assert float(got[38].match_score) == round(88 * 0.4 + 20 * 0.6, 1) and got[38].why_match == "[AI·cached] kept | a; b" and got[38].salary_ai_extracted == "Rp1"
    assert float(got[37].match_score) == 87 and got[37].why_match == "a; b" and float(got[36].match_score) == 86 and got[36].why_match == "[AI] r36 | a; b"
    assert got[35].salary_ai_extracted == "Rp5 - RpNone" and got[34].salary_ai_extracted is None and float(got[19].match_score) == 69
    assert {r.job_url for r in fresh.collect()} == {f"http://x/{i}" for i in range(20, 40) if i % 5 and i not in (37, 38)}
    for p in log.iterdir():
        p.unlink()
    again, none = model_scores(df, cache.unionByName(fresh), model, F.lit(now))
    assert {r.seq: float(r.match_score) for r in again.collect()} == {i: float(r.match_score) for i, r in got.items()}
    assert {int(p.name) for p in log.iterdir()} == {20, 25, 30, 35, 37} and {r.job_url for r in none.collect()} == set()


def test_a_failing_model_is_asked_again(spark, tmp_path):
    df = spark.createDataFrame([(i, None, None, None, None) for i in range(6)], "seq long, job_title string, company string, job_description_summary string, requirements string").coalesce(1)
    tries = tmp_path / "tries"

    def model(some):
        with open(tries, "a") as f:
            f.write(f"{some[0]['seq']} ")
        if some[0]["seq"] == 2 or tries.read_text().count("0") < 3 and some[0]["seq"] == 0:
            raise OSError("busy")
        return ["{}"] * (1 if some[0]["seq"] == 4 else len(some))

    assert {r.seq: r.answer for r in answers(df, model, batch=2).collect()} == {0: "{}", 1: "{}", 2: None, 3: None, 4: None, 5: None}
    assert tries.read_text().split() == ["0", "0", "0", "2", "2", "2", "4"]
