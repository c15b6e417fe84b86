"""Readers, page structure and writers on small files."""

import datetime as dt

from pyspark.sql import functions as F

from recordrank import catalog
from recordrank.plans import runs as R
from recordrank.plans import sinks as P
from recordrank.sources import dom
from recordrank.sources import pages as G
from recordrank.sources import readers as S


def test_files_with_different_headers(spark, tmp_path):
    run = lambda name: (tmp_path / name).mkdir(parents=True) or tmp_path / name
    (run("2026-05-01") / "jobs_ranked.csv").write_text('\ufeff"Rank","Score","Job Title","Company","Gaps / Concerns"\n"1","90","A ""x""\nline two","Acme","none"\n"2","bad","B","Tidak tercantum",""\n', encoding="utf-8")
    (run("2026-05-02") / "more.csv").write_text("Company,Job Title,Score,Url,Extra Column\nBeta,C,75.5,http://x,7\n")
    (run("2026-05-02/latest") / "x.csv").write_text("Company\nSkipped\n")
    (run("2026-05-03") / "old.csv").write_text("Rank,Score,Job Title,Company,Gaps / Concerns\n1,60,D,Delta,g\n")
    (tmp_path / "2026-05-03" / "empty.csv").write_text("")
    df = S.read_ranked(spark, str(tmp_path), ["salary"])
    got = df.orderBy("seq").select("job_title", "company", "match_score", "job_url", "gaps", "extra_column", "salary").collect()
    assert [tuple(r) for r in got] == [('A "x"\nline two', "Acme", 90.0, None, "none", None, None), ("B", None, 0.0, None, None, None, None), ("C", "Beta", 75.5, "http://x", None, "7", None), ("D", "Delta", 60.0, None, "g", None, None)]
    assert df.select("seq").distinct().count() == 4 and S.read_ranked(spark, str(tmp_path), only="05-02").count() == 1
    assert S.read_ranked(spark, str(tmp_path / "none"), ["company"]).count() == 0


def test_what_is_written_is_read(spark, tmp_path):
    full = catalog._full(spark, "/root/testdata/sf0.001")
    df = full.withColumn("rank", F.col("seq"))
    P.publish(df, str(tmp_path / "run"), str(tmp_path / "now"), P.AUDIT)
    P.publish(df.where("seq < 9"), str(tmp_path / "run2"), str(tmp_path / "now"), P.AUDIT)
    part = next((tmp_path / "run").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf") or part.startswith(b'"\xef\xbb\xbfRank"')
    back = S.read_ranked(spark, str(tmp_path / "run"))
    assert back.count() == df.count() and {(int(r["rank"]), int(r.match_score), r.company) for r in back.collect()} == {(r["rank"], r.match_score, r.company) for r in df.collect()}
    assert S.read_ranked(spark, str(tmp_path / "now")).count() == 9 and not (tmp_path / "now.old").exists()
    assert len(P.RANKED) == 21 and len(P.AUDIT) == 27 and len(P.WIDE) == 35 == len(P.wide(df).columns)
    for kind in ("normal", "powerful", "audit", "audit_gaps"):
        text = P.report(spark, kind, P.report_sections(df, kind))
        assert text.startswith(f"# {kind}") and text.count("## ") >= 4


def test_all_kinds_of_sources(spark):
    kinds = [("curated_job_board", "x"), ("graduate_job_board", "x"), ("large_job_board", "jobstreet"), ("large_job_board", "indeed"), ("large_job_board", "glints"), ("large_job_board", "kalibrr"), ("large_job_board", "x"), ("job_board", "x"), ("aggregator", "x"), ("glints", "x"), ("kalibrr", "x"), ("rss_feed", "indeed"), ("?", "indeed")]
    got = [r.p for r in spark.createDataFrame(kinds, "t string, u string").coalesce(1).select(G.parser_of(F.col("t"), F.col("u")).alias("p")).collect()]
    assert got == ["curated", "graduate", "board_a", "board_b", "board_d", "board_e", None, "board_c", "aggregator", "board_d", "board_e", "rss", None]


def test_page_structure(spark):
    html = """<div class="Blog-POST"><p><a>no</a><a href="/rel">rel</a></p></div><article class="entry"><a href="http://a/1"> One <b>x</b></a><a href="http://a/2">Two</a></article><h2><a href="http://a/3">h</a></h2>"""
    assert dom.curated_links(dom.tree(html)) == [("http://a/1", "Onex")]
    assert dom.curated_links(dom.tree("<h2><a href='http://a/3'>h</a></h2><h3>none</h3>")) == [("http://a/3", "h")]
    assert dom.graduate_links(dom.tree("<section role='button'><div><a href='/j/1'>J</a></div></section><a href='/jobs-internships/2'>K</a><a href='/x'>no</a>")) == [("/j/1", "J"), ("/jobs-internships/2", "K")]
    pages = spark.createDataFrame([(1, "<h1> T &amp; x</h1><div id='main-1'>PT Maju Jaya adalah firma.</div><ul><li>Kualifikasi: S1</li></ul><script>var a='Requirements'</script>"), (2, None), (3, "<p>broken <b>" * 3000)], "page_id int, html string")
    got = {r.page_id: r for r in dom.page_fields(pages).collect()}
    assert (got[1].heading, got[1].body, got[1].requirements) == ("T & x", "PT Maju Jaya adalah firma.", "Kualifikasi: S1") and got[2].heading is None and got[3].full_text.startswith("broken broken")
    from recordrank.functions.text import company_of_body

    names = ["PT Maju Jaya adalah firma.", "Di PT Biro, lalu Bank Sentosa membuka", "none"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "b string").coalesce(1).select(company_of_body(F.col("b"))).collect()] == ["PT Maju Jaya", "Bank Sentosa", None]


def test_feeds_caches_and_states(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Trainee &amp;amp; co - PT Satu - site</title><link>http://x/1</link><description>&lt;p&gt;Hi &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>")
    r = S.read_feed(spark, str(tmp_path / "feed.xml"), "feed", 5).collect()
    assert [(x.job_title, x.company, x.description_preview) for x in r] == [("Trainee & co", "PT Satu", "Hi you")]
    (tmp_path / "c.json").write_text('{"http://x/1": {"data": {"company_type": "Swasta", "industry": "Retail"}, "timestamp": "2026-05-01T10:00:00"}}')
    c = S.read_cache(spark, str(tmp_path / "c.json"), "enrichment").select("key", "value.data.industry", "value.timestamp").first()
    assert (c.key, c.industry, c.timestamp) == ("http://x/1", "Retail", dt.datetime(2026, 5, 1, 10))
    (tmp_path / "bad.json").write_text("{ broken")
    assert S.read_cache(spark, str(tmp_path / "bad.json"), "urls").count() == 0 and S.read_cache(spark, str(tmp_path / "none.json"), "urls").count() == 0
    P.write_document(spark.createDataFrame([("a", "applied")], "id string, status string"), str(tmp_path / "doc"), "id", "status")
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"a":"applied"}'
    bodies = spark.createDataFrame([(1, ['{"x": 1}', "no json"])], "page_id int, api_data array<string>")
    assert S.read_bodies(bodies).selectExpr("page_id", "variant_get(body, '$.x', 'int') as x").collect()[0].x == 1
    out = tmp_path / "latest"
    out.mkdir()
    (out / "jobs_ranked.csv").write_text("Rank,Score,Job Title,Company,Location\n1,80,MT,Acme,Jakarta\n")
    (out / "run_summary.json").write_text('{"run_id": "r9", "total_exported": 1}')
    summary, ranked, insights = S.read_artifacts(spark, str(out))
    assert summary.first().run_id == "r9" and ranked.first().id == "acmemtjakarta" and insights.count() == 0


def test_answers_of_models(spark):
    row = spark.createDataFrame([("```json\n{\"a\": 1}\n```",)], "t string").select(R.unfenced(F.col("t")).alias("t")).first()
    assert row.t == '{"a": 1}'
