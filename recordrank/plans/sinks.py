"""Writers of results; the sentinel and joined lists exist only in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scoring import bands
from ..functions.text import clean
from ..operators import summaries
from . import runs

#: Headers of ranked files with their columns, and what an audit adds.
RANKED = {
    "Rank": "rank", "Score": "match_score", "Match Category": "match_category", "Recommendation": "recommendation", "Job Title": "job_title", "Company": "company", "Location": "location", "Source": "source", "Link": "job_url", "Why Match": "why_match", "Gaps / Concerns": "gaps",
    "Suggested CV Tailoring": "suggested_cv_tailoring", "reason_codes": "reason_codes", "data_confidence": "data_confidence", "scrape_status": "scrape_status", "run_id": "run_id", "gpa_required": "gpa_required", "gpa_gap": "gpa_gap", "gpa_status": "gpa_status", "gpa_note": "gpa_note",
    "salary_ai_extracted": "salary_ai_extracted",
}
AUDIT = RANKED | {"deadline_parsed": "deadline_parsed", "deadline_status": "deadline_status", "days_until_deadline": "days_until_deadline", "urgency_level": "urgency_level", "deadline_note": "deadline_note", "not_apply_today_reason": "reason"}
#: Columns of the wide export and where they come from; those of ``priority_fields`` have their own names.
WIDE = {
    "rank": "rank", "score": "match_score", "super_aggressive_priority": "priority", "super_aggressive_recommendation": "priority_recommendation", "match_category": "match_category", "tracker_status": "tracker_status", "job_title": "job_title", "company_name": "company", "location": "location",
    "job_link": "job_url", "source": "source", "source_url": "source_url", "date_posted": "date_posted", "date_collected": "last_scraped", "salary_min": "salary", "salary_max": "salary_max", "industry": "industry", "work_arrangement": "work_arrangement", "parsing_confidence": "data_confidence",
    "match_reasons": "why_match", "gaps": "gaps", "missing_skills": "missing_skills", "red_flags": "reason_codes", "cv_tailoring_notes": "suggested_cv_tailoring", "job_description": "job_description_summary", "requirements": "requirements", "responsibilities": "responsibilities",
    "raw_text": "raw_text", "data_origin": "origin", "duplicate_group_key": "duplicate_group", "gpa_required": "gpa_required", "gpa_gap": "gpa_gap", "gpa_status": "gpa_status", "gpa_note": "gpa_note", "apply_notes": "apply_notes",
}


def _text(df: DataFrame, c: str) -> Column:
    kinds = dict(df.dtypes)
    return F.lit(None).cast("string") if c not in kinds else F.nullif(F.array_join(c, ", " if c == "reason_codes" else "; "), F.lit("")) if kinds[c].startswith("array") else F.col(c).cast("string")


def rendered(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Text columns for a file, by header: lists joined, the sentinel for null and for a missing column, no text where a row passes."""
    blank = {"reason": "", "gaps": "None detected"}
    return df.select(*[F.coalesce(_text(df, c), F.lit(blank.get(c, V.NOT_LISTED))).alias(header) for header, c in columns.items()])


def write_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Quoted CSV files with a header that begins with a byte-order mark, so that spreadsheets read them as UTF-8."""
    first = next(iter(columns))
    rows = rendered(df, columns).withColumnRenamed(first, f"\ufeff{first}")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def priority_fields(df: DataFrame) -> DataFrame:
    s = F.col("match_score")
    return df.withColumns({"priority": bands(s, V.PRIORITIES, 1), "priority_recommendation": bands(s, V.PRIORITIES, 2), "apply_notes": bands(s, V.PRIORITIES, 3)})


def wide(df: DataFrame) -> DataFrame:
    """The wide export of 35 columns: priorities, and texts on one line that are empty where nothing is known."""
    df = priority_fields(df)
    raw = ("match_score", "rank", "data_confidence")
    return df.select(*[(F.col(c) if c in raw and c in df.columns else clean(_text(df, c)) if c != "origin" or c in df.columns else F.lit("scraper")).alias(name) for name, c in WIDE.items()])


def write_summary(one_row: DataFrame, path: str) -> None:
    one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report(spark: SparkSession, title: str, sections: dict[str, DataFrame], most: int = 30) -> str:
    """A Markdown report of small tables, of each at most ``most`` rows."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        lines += ["| " + " | ".join(str(v) if v is not None else V.NOT_LISTED for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(lines) + "\n"


def publish(df: DataFrame, run_path: str, latest_path: str, columns: dict[str, str]) -> None:
    """A run's file, then the same as the latest: written beside it and put in its place by a rename, so that readers see one or the other."""
    write_csv(df, run_path, columns)
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (run_path, f"{latest_path}.next", latest_path, f"{latest_path}.old")]
    run, new, now, old = paths
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs = now.getFileSystem(conf)
    for p in (new, old):
        fs.delete(p, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(run.getFileSystem(conf), run, fs, new, False, conf)
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"{latest_path} could not be set aside")
    if not fs.rename(new, now):
        if fs.exists(old):
            fs.rename(old, now)
        raise OSError(f"{latest_path} could not be put in its place")
    fs.delete(old, True)


def upsert_map(current: DataFrame | None, changes: DataFrame, key: str, value: str) -> DataFrame:
    """A whole state map after changes, for a sink that writes documents whole: the change stands, and a null value deletes."""
    rows = changes.select(key, value, F.lit(1).alias("_p"))
    if current is not None:
        rows = rows.unionByName(current.select(key, value, F.lit(0).alias("_p")))
    return rows.groupBy(key).agg(F.max_by(F.struct(value), "_p").alias("v")).select(key, f"v.{value}").where(F.col(value).isNotNull())


def write_document(rows: DataFrame, path: str, key: str, value: str) -> None:
    """A key-value table as one JSON document with a map, for readers of the whole state."""
    rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report_sections(df: DataFrame, kind: str, most: int = 30) -> dict[str, DataFrame]:
    """The small tables of a run's report: ``normal``, ``powerful``, ``audit`` or ``audit_gaps``. ``df`` has ranks, scores and reasons."""
    c = F.col
    order = c("rank") if "rank" in df.columns else F.desc("match_score")
    cut = lambda rows, *cols: rows.orderBy(order).limit(most).select("job_title", "company", "match_score", *cols)
    passing = df.where("reason is null")
    grades = summaries.dense_counts(df, "gpa_status", V.GRADE_LABELS, "No GPA Listed").orderBy("place").select("label", "n")
    gaps = {"Slight GPA gap": cut(df.where("gpa_status = 'Slight GPA Gap'"), "gpa_required"), "Moderate or high GPA gap": cut(df.where("gpa_status in ('Moderate GPA Gap', 'High GPA Gap')"), "gpa_required", "gpa_status")}
    if kind == "normal":
        return {"Apply today": cut(passing.limit(10) if most > 10 else passing, "match_category"), "Strong": cut(df.where("match_score >= 85")), "Good": cut(df.where("match_score >= 75 and match_score < 85")), "GPA": grades, **gaps,
                "Review": cut(runs.manual_review(df), "data_confidence"), "Skip": cut(runs.skipped(df), "recommendation")}
    expired = {"Expired": cut(df.where("deadline_status = 'Expired'"), "deadline_note")}
    whole = {"GPA": grades, "Deadlines": summaries.open_counts(df, "deadline_status").select("deadline_status", "n"), "Urgency": summaries.open_counts(df, "urgency_level").select("urgency_level", "n")}
    reasons = {"Reasons": summaries.open_counts(df.where("reason is not null"), "reason").select("reason", "n")}
    if kind == "powerful":
        return {"Apply today": cut(passing, "urgency_level"), **whole, **reasons, **expired, "Review": cut(runs.wide_review(df), "gpa_status", "deadline_status", "data_confidence")}
    if kind == "audit":
        return {"Totals": summaries.audit_summary(df).select("total_jobs_audited", "total_apply_today", "gpa_ok", "gpa_above", "no_description"), **whole, **reasons}
    return {"Apply today": cut(passing, "urgency_level"), **gaps, **expired, "Review": cut(runs.wide_review(df, with_url=True), "gpa_status", "deadline_status", "data_confidence")}


def calendar_event(title, start, place):
    """An iCalendar event of an hour with an alarm 15 minutes before, as a text column."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("DTSTART:"), stamp(start)), F.concat(F.lit("DTEND:"), stamp(start + F.expr("interval 1 hour"))), F.concat(F.lit("SUMMARY:"), title), F.concat(F.lit("LOCATION:"), F.coalesce(place, F.lit(""))), F.lit("BEGIN:VALARM"), F.lit("TRIGGER:-PT15M"), F.lit("END:VALARM"), F.lit("END:VEVENT"))
