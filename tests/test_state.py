"""State logs, kept joins and robots rules against plain Python."""

import random
import re
import urllib.robotparser
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from recordrank.plans.memo import fingerprint, memoised
from recordrank.plans.state_log import Conflict, StateLog
from recordrank.sources import robots


def changes(spark, rows):
    return spark.createDataFrame(rows, "id string, value string, seq long")


def test_writers_and_replays(spark, tmp_path):
    rng, want = random.Random(2), {}
    log, other = (StateLog(spark, str(tmp_path / "log"), snapshot_every=4) for _ in range(2))
    sinks = {"a": log.sink("a"), "b": other.sink("b")}
    assert log.state().count() == 0
    done = []
    for step in range(6):
        for w in "ab":
            rows = [(rng.choice([None, *"uvwxyz"]), rng.choice([None, f"{w}{step}{i}"]), i) for i in range(6)]
            sinks[w](changes(spark, rows), step)
            done.append((w, step, rows))
            for k, v, _ in rows:
                want[k] = v
            # what is written again changes nothing, whether it is the last batch or an older one
            again = rng.choice(done)
            sinks[again[0]](changes(spark, again[2]), again[1])
    assert {(r.id, r.value) for r in other.state().collect()} == {(k, v) for k, v in want.items() if v is not None}
    assert log.head()["snapshot"] > 0 and log.head()["writers"] == {"a": 5, "b": 5}


def test_commits_at_the_same_time_are_all_kept(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: StateLog(spark, str(tmp_path / "log")).commit(changes(spark, [(f"k{i}", str(i), 0)]), f"w{i}", 0), range(8)))
    assert sorted(versions) == list(range(1, 9))
    assert {(r.id, r.value) for r in log.state().collect()} == {(f"k{i}", str(i)) for i in range(8)}
    assert log.state(3).count() == 3


def test_compare_and_set(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"))
    base = log.commit(changes(spark, [("a", "1", 0), ("b", "1", 0)]), "w", 0)
    log.commit(changes(spark, [("a", "2", 0)]), "x", 0, based_on=base)
    log.commit(changes(spark, [("b", "2", 0)]), "y", 0, based_on=base)
    with pytest.raises(Conflict):
        log.commit(changes(spark, [("a", "3", 0)]), "z", 0, based_on=base)
    log.compact()
    with pytest.raises(Conflict):
        log.commit(changes(spark, [("b", "3", 0)]), "z", 0, based_on=base)
    assert {(r.id, r.value) for r in log.state().collect()} == {("a", "2"), ("b", "2")}


def test_state_from_a_stream(spark, tmp_path):
    rows = [(f"k{i % 3}", str(i), i) for i in range(9)]
    log = StateLog(spark, str(tmp_path / "log"))
    for i in range(3):
        changes(spark, rows[3 * i : 3 * i + 3]).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema("id string, value string, seq long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(log.sink("s")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.value) for r in log.state().collect()} == {("k0", "6"), ("k1", "7"), ("k2", "8")} and log.head()["version"] == 3


def test_kept_join_builds_changed_keys_only(spark, tmp_path):
    history = spark.createDataFrame([(i % 7, i) for i in range(50)], "k long, n long")
    asked = []

    def build(keys):
        asked.append(sorted((r.k for r in keys.collect()), key=str))
        return keys.join(history, "k").groupBy("k").agg(F.sum("n").alias("n"))

    total = {k: sum(i for i in range(50) if i % 7 == k) for k in range(7)}
    for keys, built, version in ([1, 2, 3], [1, 2, 3], ""), ([3, 2, 1, 1], None, ""), ([2, 3, 5, 99, None], ["5", "99", "None"], ""), ([2, 99, None, 5], [], ""), ([2, 99], [2, 99], "v2"), ([2, 99], None, "v2"):
        before = len(asked)
        rows = memoised(str(tmp_path / "m"), spark.createDataFrame([(k,) for k in keys], "k long"), "k", build, version)
        assert {(r.k, r.n) for r in rows.collect()} == {(k, total[k]) for k in keys if k in total}
        assert [list(map(str, x)) for x in asked[before:]] == ([] if built is None else [list(map(str, built))])
    a, b = ([(1,), (2,), (2,)], [(2,), (1,)])
    assert fingerprint(spark.createDataFrame(a, "k long"), "k") == fingerprint(spark.createDataFrame(b, "k long"), "k") != fingerprint(spark.createDataFrame(b[:1], "k long"), "k")


PATHS = ["/", "/a", "/a/b", "/a/b?q=1", "/A", "/caf%C3%A9", "/a%2Fb", "", "/x y", "/a/b#top", "*", "/a+b", "/%zz"]


def some_file(rng):
    lines = []
    for _ in range(rng.randint(0, 14)):
        path = rng.choice(PATHS)
        lines.append(rng.choice(["", "", "# note", "junk", "Sitemap: http://x/y", "User-agent: *", "User-agent: Bot", "user-agent: other # x", "User-Agent: recordrank", f"Disallow: {path}", f"Disallow: {path}", f"Allow: {path}", f"ALLOW:{path}", f"Crawl-delay: {rng.choice(['5', '0', 'x', '12'])}", "   "]))
    return "\n".join(lines)


def test_first_match_is_the_standard_library(spark):
    rng = random.Random(11)
    files = [(f"h{i}.example", some_file(rng)) for i in range(150)] + [("none.example", None), ("bot.example", "User-agent: Bot\nDisallow: /\n\nUser-agent: *\nAllow: /")]
    urls = [(f"http://{h}{p if p != '*' else '/z'}",) for h, _ in files for p in PATHS]
    got = robots.allowed(spark.createDataFrame(urls, "url string"), spark.createDataFrame(files, "host string, body string"), "RecordRank-Bot/2.1").collect()
    assert len(got) == len(urls)
    for r in got:
        rp = urllib.robotparser.RobotFileParser()
        rp.parse((dict(files)[r.url.split("/")[2].split("?")[0]] or "").splitlines())
        assert r.allowed == rp.can_fetch("RecordRank-Bot/2.1", r.url), (r.url, dict(files)[r.url.split("/")[2]])
        assert r.crawl_delay == (rp.crawl_delay("RecordRank-Bot/2.1") or 3)


def test_longest_match(spark):
    rng = random.Random(12)
    pool = ["/", "/a", "/a/b", "/*b", "/a*c", "/a$", "/*.pdf$", "/a/b/c", "/a.b", ""]
    picked = [[(rng.random() < 0.5, rng.choice(pool)) for _ in range(4)] for _ in range(60)]
    files = [(f"h{i}.example", "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rs)) for i, rs in enumerate(picked)]
    paths = ["/", "/a", "/a/b", "/a/b/c", "/ab", "/x.pdf", "/x.pdf?z", "/axb", "/a.b", "/a#b", "?q"]
    got = robots.allowed(spark.createDataFrame([(f"http://h{i}.example{p}",) for i in range(60) for p in paths], "url string"), spark.createDataFrame(files, "host string, body string"), "x", match="longest").collect()
    for r in got:
        i, where = int(re.match(r"http://h(\d+)", r.url)[1]), r.url.split(".example")[1].split("#")[0]
        where = where if where.startswith("/") else "/" + where
        hits = [(len(p), a or p == "") for a, p in picked[i] if re.match(re.escape(p).replace(r"\*", ".*").replace(r"\$", "$") if not p.endswith("$") else re.escape(p[:-1]).replace(r"\*", ".*") + "$", where)]
        assert r.allowed == (max(hits)[1] if hits else True), r.url
    odd = robots.allowed(spark.createDataFrame([(None,), ("no address",)], "url string"), spark.createDataFrame(files, "host string, body string"), "x")
    assert [(r.allowed, r.crawl_delay) for r in odd.collect()] == [(True, 3)] * 2
