"""Queries against their SQL, and streams against batches."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordrank import catalog, catalog_files, catalog_state
from recordrank.operators.acceptance import accepted
from recordrank.streaming.state import accepted_stream, health_stream, latest_stream, new_runs

SF = "/root/testdata/sf0.001"
STATE, FILES = ([n for n, f in catalog.QUERIES.items() if f.__module__ == m.__name__] for m in (catalog_state, catalog_files))
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in [*TABLES, "pages"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    cell = lambda v: None if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if not isinstance(v, str) else v
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["score_rank_top20", "deadline_bands", "apply_reason", "audit_adjust", "dedup_merge", "url_domain_health", "ttl_accept", "either_key_join", "html_links", "jsonld_extract", "deadline_ranks", "stage_countdown", *STATE, *FILES])
def test_query(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


ODD_HEADINGS = [
    (1, '<h1>token = &quot;0b96&quot; &lt;b&gt; &amp;lt; R&amp;D&#39;s &nbsp;x&apos;</h1>'), (2, "<h1> &nbsp; </h1>"), (3, "<h1>A &quot;b&quot;</h1><h1>C</h1>"), (4, "<p>none</p>"), (5, None),
    (6, None), (7, "<H1 class='x'>\n <i>T</i> &amp; U\n</H1>"), (8, "<h1></h1>"), (9, "<h1>never closed"), (10, "<h1>never closed"), (None, "<h1>&quot;q&quot;</h1>"), (11, "<h1> &lt; </h1>"), (-3, "<h1>y</h1>"),
]


@pytest.mark.parametrize("name", ["page_headings", "page_titles"])
def test_odd_headings(spark, tmp_path, name):
    """References that the SQL leaves as they are, and pages without a heading."""
    spark.createDataFrame(ODD_HEADINGS, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


def test_streams_agree_with_batches(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("acc", accepted_stream(stream, "user_id"), "append"), ("last", latest_stream(stream, "user_id", "event_type"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    batch = accepted(log.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "user_id")
    assert spark.table("acc").count() == batch.count()
    assert spark.table("last").count() == log.select("user_id").distinct().count()


@pytest.mark.parametrize("name", ["heatmap_84d", "dense_labels", "either_key_join"])
def test_whole_tables(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


def test_health_and_run_streams(spark, tmp_path):
    log = spark.createDataFrame([("a", i < 9) for i in range(10)] + [("b", False)] * 5 + [("c", True)] * 2, "d string, failed boolean")
    log.write.parquet(str(tmp_path / "log"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    for name, df, mode in (("health", health_stream(read("log"), "d"), "update"),):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"at_{name}")).start().awaitTermination()
    assert {(r.d, r.total, r.errors, r.blocked) for r in spark.table("health").collect()} == {("a", 10, 9, True), ("b", 5, 0, False), ("c", 2, 2, False)}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"run_id": "r1", "finished_at": "2026-01-01T00:00:00Z"}\n{"run_id": "r1", "finished_at": "2026-01-01T00:00:00Z"}')
    found, trigger = new_runs(spark, str(tmp_path / "runs"))
    found.writeStream.format("memory").queryName("runs").trigger(**trigger).option("checkpointLocation", str(tmp_path / "at_runs")).start().awaitTermination()
    assert [r.run_id for r in spark.table("runs").collect()] == ["r1"]
