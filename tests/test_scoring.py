"""Boundary values of the rules, on small literal tables."""

import pytest
from pyspark.sql import functions as F

from recordrank.functions import scoring as S
from recordrank.functions import text as T
from recordrank.operators import dedup as D
from recordrank.operators import summaries as A


def test_categories(spark):
    want = {44: "Not Recommended", 45: "Weak Match", 59: "Weak Match", 60: "Possible Match", 74: "Possible Match", 75: "Good Match", 84: "Good Match", 85: "Strong Match"}
    df = spark.createDataFrame([(k,) for k in want], "s int").select("s", S.category(F.col("s")).alias("c"), S.recommendation(F.col("s"), F.lit(49)).alias("low"))
    rows = df.collect()
    assert {r.s: r.c for r in rows} == want and {r.low for r in rows} == {"Review Manually"}


@pytest.mark.parametrize(
    ("text", "grade", "status"),
    [
        ("IPK min 1,99", None, "No GPA Listed"), ("IPK min 2,00", 2.0, "Priority GPA Match"), ("GPA >= 3.00", 3.0, "Priority GPA Match"), ("GPA >= 3.26", 3.26, "Meets GPA"), ("ipk 3.30 ", 3.3, "Slight GPA Gap"), ("minimum GPA 3.36", 3.36, "Moderate GPA Gap"),
        ("bachelor gpa 3.51", 3.51, "High GPA Gap"), ("GPA > 4.01", None, "No GPA Listed"), ("IPK min 5,00, GPA > 3.2", 3.2, "Priority GPA Match"), ("strong academic record", None, "Qualitative GPA Requirement"), (None, None, "No GPA Listed"),
    ],
)
def test_grades(spark, text, grade, status):
    r = S.with_grade(spark.createDataFrame([(text,)], "t string"), F.coalesce("t", F.lit(""))).first()
    assert (float(r.gpa_required) if r.gpa_required is not None else None) == grade and r.gpa_status == status


@pytest.mark.parametrize(
    ("url", "text", "day"),
    [("x/02/2026/y", "deadline: 1 Mei 2026", "2026-02-28"), ("x/13/2026/y", "deadline: 1 Mei 2026", "2026-05-01"), (None, "closing: 31 Juni 2026, 2026-07-01", None), (None, "2026-05-31T23:59", None), (None, "until 2026/05/31.", "2026-05-31"), (None, "3 mei 2026 (batas)", "2026-05-03"), (None, "deadline 3 foo 2026, 2026-05-31", None)],
)
def test_deadlines(spark, url, text, day):
    r = S.with_due(spark.createDataFrame([(url, text)], "u string, t string"), F.col("u"), F.col("t"), "2026-05-01").first()
    assert (str(r.deadline_parsed) if r.deadline_parsed else None) == day


@pytest.mark.parametrize(("day", "status", "urgency", "points"), [("2026-04-30", "Expired", "Expired", -50), ("2026-05-01", "Open", "High", 5), ("2026-05-04", "Open", "High", 5), ("2026-05-05", "Open", "Medium", 3), ("2026-05-08", "Open", "Medium", 3), ("2026-05-09", "Open", "Low", 0)])
def test_deadline_bands(spark, day, status, urgency, points):
    r = S.with_due(spark.createDataFrame([(f"({day})",)], "t string"), F.lit(None).cast("string"), F.col("t"), "2026-05-01").first()
    assert (r.deadline_status, r.urgency_level, r.deadline_points) == (status, urgency, points)


def test_dedup_does_not_depend_on_partitions(spark):
    rows = [(i, f"u{i % 7}" if i % 5 else None, "Management Trainee" if i % 2 else "Data Trainee x", "c", None, "d" * (i % 4), i * 7 % 13, i * 3 % 10) for i in range(60)]
    schema = "seq int, job_url string, job_title string, company string, location string, job_description_summary string, match_score int, data_confidence int"
    results = []
    for n in (1, 8):
        df = spark.createDataFrame(rows, schema).repartition(n).withColumn("apply_url", F.lit(None).cast("string"))
        results.append([sorted(map(str, f.collect())) for f in (D.first_rows(df, D.record_key()), D.merged_rows(df, D.record_key()), D.fuzzy_rows(df))])
    assert results[0] == results[1]
    once = D.first_rows(df, D.record_key())
    assert sorted(map(str, once.collect())) == sorted(map(str, D.first_rows(once, D.record_key()).collect()))


def test_ranks_are_dense(spark):
    df = A.ranked(spark.range(1000).withColumn("v", F.col("id") * 37 % 101), F.desc("v"), F.asc("id"))
    rows = df.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1001)) and rows == sorted(rows, key=lambda r: (-r.v, r.id))


def test_texts(spark):
    df = spark.createDataFrame([("Info Loker Management Trainee 2026 Batch IV", "Acme at Jakarta - PT Satu - site")], "a string, b string")
    r = df.select(T.title_key(F.col("a")), T.feed_title(F.col("b"))[1], T.slug(F.col("a"), F.col("b"))).first()
    assert r[0] == "managementtrainee" and r[1] == "PT Satu" and len(r[2]) <= 80
