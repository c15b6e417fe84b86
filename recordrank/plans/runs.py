"""Compositions: the batch run, the audit of an older run, and the filtered view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import vocabulary as V
from ..functions.text import joined_fields, listed
from ..operators.dedup import merged_rows, record_key


def rank_order() -> list[Column]:
    """Score and confidence down; the date as text, unknown last; company; arrival."""
    return [F.desc("match_score"), F.desc("data_confidence"), F.asc_nulls_last("date_posted"), F.asc("company"), F.asc("seq")]


def deadline_order() -> list[Column]:
    place = lambda c, names: F.element_at(F.create_map(*[F.lit(x) for kv in zip(names, range(len(names))) for x in kv]), F.col(c))
    return [F.desc("match_score"), F.desc("data_confidence"), place("deadline_status", ["Open", "Unknown", "Expired"]), place("urgency_level", ["High", "Medium", "Low", "Unknown", "Expired"]), F.asc("company"), F.asc("job_title"), F.asc("seq")]


def reasons(df: DataFrame) -> DataFrame:
    c = F.col
    return S.settled(df, reason=S.not_today(c("match_score"), c("data_confidence"), c("recommendation"), c("reason_codes"), c("gpa_status"), c("deadline_status"), F.coalesce(listed(c("job_url")), listed(c("apply_url"))) if "apply_url" in df.columns else listed(c("job_url"))))


def batch(postings: DataFrame, today: str, profile: V.Profile | None = None) -> DataFrame:
    """Postings deduplicated, scored, with deadlines and reasons: one shuffle, on the record's key."""
    if "match_score" not in postings.columns:
        postings = postings.withColumn("match_score", F.lit(0))
    if "apply_url" not in postings.columns:
        postings = postings.withColumn("apply_url", F.lit(None).cast("string"))
    once = merged_rows(postings, record_key()).withColumnRenamed("match_score", "prior_score")
    return reasons(S.with_deadline(S.score(once, profile), today))


def audit(ranked: DataFrame, wide: DataFrame, today: str) -> DataFrame:
    """An older run with missing fields filled from its wide export, and the grade's points applied to its score once.

    The last wide row of an address counts, by ``seq``; values are filled in only where they are listed.
    """
    fields = ["requirements", "job_description_summary", "salary", "deadline"]
    more = wide.select(F.lower(F.trim("job_url")).alias("_u"), "seq", *fields).groupBy("_u").agg(F.max_by(F.struct(*fields), "seq").alias("w"))
    rows = ranked.join(more, F.lower(F.trim(ranked["job_url"])) == F.col("_u"), "left")
    rows = rows.withColumns({c: F.coalesce(listed(F.col(f"w.{c}")), F.col(c) if c in ranked.columns else F.lit(None).cast("string")) for c in fields}).drop("_u", "w")
    rows = S.with_grade(rows, joined_fields(rows.columns, V.GRADE_FIELDS))
    rows = S.settled(rows, match_score=F.greatest(F.lit(0), F.least(F.lit(100), F.col("match_score") + F.col("gpa_points"))))
    rows = rows.withColumn("reason_codes", F.concat(F.filter("reason_codes", lambda x: ~x.startswith("GPA_")), F.col("gpa_codes"))).drop("gpa_codes", "gpa_points")
    return reasons(S.with_deadline(rows, today))


def with_model(df: DataFrame, score: Callable[[DataFrame], DataFrame] | DataFrame, least: int = 60, most: int = 20) -> DataFrame:
    """Scores blended with a model's for the first candidates, categories made anew. The candidates are chosen before the model runs.

    ``score`` is a table of ``(seq, semantic_score)``, such as a cache, or a function from the candidates to one. The rows come without an
    order; ``rank_order`` over the new score is the order of the ranking that follows.
    """
    chosen = df.where(F.col("match_score") >= least).orderBy(*rank_order()).limit(most)
    scores = score(chosen) if callable(score) else score
    out = df.join(scores.select("seq", "semantic_score"), "seq", "left")
    blended = S.blend(F.col("match_score"), F.col("semantic_score"))
    return out.withColumn("match_score", blended).withColumns({"match_category": S.category(F.col("match_score")), "recommendation": S.recommendation(F.col("match_score"), F.col("data_confidence"))})


def view(df: DataFrame, query: str | None = None, least: int = 75, location: str | None = None, industry: str | None = None, kind: str | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """The rows that a board shows."""
    if hidden is not None:
        df = df.join(hidden, "id", "left_anti")
    df = df.where(F.col("match_score") >= least)
    if query:
        q = F.lit(query.lower())
        df = df.where(F.contains(F.lower("job_title"), q) | F.contains(F.lower(F.coalesce("company", F.lit(""))), q) | F.contains(F.lower(F.coalesce("location", F.lit(""))), q))
    for c, v in (("location", location), ("industry", industry), ("company_type", kind)):
        if v:
            df = df.where(F.contains(c, F.lit(v)) if c == "location" else F.col(c) == v)
    return df


def needs_enrichment(df: DataFrame) -> DataFrame:
    """Rows with at least two of four fields missing, little confidence and a fair score; a column that the table lacks is missing."""
    empty = sum(((listed(F.col(c)).isNull() if c in df.columns else F.lit(True)).cast("int") for c in ("company", "salary", "deadline", "industry")), F.lit(0))
    return df.where((empty >= 2) & (F.col("data_confidence") < 65) & (F.col("match_score") >= 55))


def manual_review(df: DataFrame) -> DataFrame:
    return df.where((F.col("data_confidence") < 60) | F.col("salary").isNull() | F.arrays_overlap("reason_codes", F.array(F.lit("GPA_RISK"), F.lit("MAJOR_RISK"), F.lit("VAGUE_JD"))))


def announced(df: DataFrame, least: int = 80, fallback: int = 3, most: int = 5) -> DataFrame:
    """Passing rows of at least ``least``, at most five; without any, the first three passing. Both are top-k of bounded heaps."""
    passing = df.where("reason is null")
    good = passing.where(F.col("match_score") >= least).orderBy(*rank_order()).limit(most).withColumn("_g", F.lit(1))
    rest = passing.orderBy(*rank_order()).limit(fallback).withColumn("_g", F.lit(2))
    return good.unionByName(rest.join(F.broadcast(good.select(F.lit(1).alias("_x")).limit(1)), F.lit(True), "left_anti")).drop("_g")


def skipped(df: DataFrame) -> DataFrame:
    """Rows that are not worth an application."""
    bad = F.array(*[F.lit(x) for x in ("EXPERIENCE_TOO_HIGH", "COMMISSION_ONLY", "UNPAID_INTERNSHIP")])
    return df.where((F.col("recommendation") == "Skip") | F.arrays_overlap("reason_codes", bad))


def wide_review(df: DataFrame, with_url: bool = False) -> DataFrame:
    """Rows that a full run lists for review: no deadline, no numeric grade, or little confidence; an audit adds those without an address."""
    says = (F.col("deadline_status") == "Unknown") | F.col("gpa_status").isin("No GPA Listed", "Qualitative GPA Requirement") | (F.coalesce("data_confidence", F.lit(0)) < 60)
    return df.where(says | listed(F.col("job_url")).isNull() if with_url else says)


def search(df: DataFrame, keyword: str, most: int = 5) -> DataFrame:
    """The first rows, by rank, whose title, company, place or explanation has the keyword, each with the number of all such rows.

    The number is an aggregation of one row beside a bounded heap; the rows are never gathered.
    """
    fields = [F.array_join(c, "; ") if kind.startswith("array") else F.col(c) for c, kind in df.dtypes if c in ("job_title", "company", "location", "why_match")]
    found = df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(keyword.lower())))
    total = found.agg(F.count("*").alias("total_found"))
    return found.orderBy(*rank_order()).limit(most).withColumn("total_found", total.scalar())


def keywords_of_top(df: DataFrame, column: str = "keywords_found", rows: int = 5, most: int = 15) -> DataFrame:
    """The distinct keywords of the first rows, in order, at most fifteen."""
    words = df.orderBy(*rank_order()).limit(rows).select(F.explode(column).alias("keyword"))
    return words.where("keyword <> ''").distinct().orderBy("keyword").limit(most)


def run_names(started: Column) -> tuple[Column, Column]:
    """A run's id and the name of its folder."""
    return F.date_format(started, "yyyyMMdd_HHmmss"), F.date_format(started, "yyyy-MM-dd_HH-mm-ss")


def duration(started: Column, finished: Column) -> Column:
    """Seconds from start to end."""
    return F.timestamp_diff("SECOND", started, finished)


def cache_hits(df: DataFrame, cache: DataFrame, now: Column, ttl: str, key: str = "job_url") -> tuple[DataFrame, DataFrame]:
    """Rows with the cached ``data`` of their address where it is fresh, and those without."""
    young = cache.where(F.col("ts") > now - F.expr(ttl)).groupBy(key).agg(F.max_by("data", "ts").alias("data"))
    return df.join(young, key), df.join(young.select(key), key, "left_anti")


def enrichment_batch(df: DataFrame, cache: DataFrame, now: Column, ttl: str = "interval 14 days", most: int = 10) -> DataFrame:
    """The first rows, by rank, that need enrichment and have no fresh cache entry."""
    return cache_hits(needs_enrichment(df), cache, now, ttl)[1].orderBy(*rank_order()).limit(most)


def enriched(df: DataFrame, data: DataFrame, key: str = "job_url") -> DataFrame:
    """``df`` with ``data(key, company_type, estimated_salary, industry, deadline_info)`` from a cache or a model: only missing fields are filled,
    ``unknown`` fills nothing, and the status of a row with an entry says so. A ``status`` without text stays so but for that word."""
    had = df.columns
    known = lambda c: F.when(F.col(f"e.{c}") != "unknown", listed(F.col(f"e.{c}")))
    old = lambda c: listed(F.col(c)) if c in had else F.lit(None).cast("string")
    fields = F.struct("company_type", "estimated_salary", "industry", "deadline_info")
    rows = df.join(data.groupBy(key).agg(F.max(fields).alias("e")), key, "left")
    rows = rows.withColumns({
        "company_type": F.coalesce(known("company_type"), old("company_type")), "salary": F.coalesce(old("salary"), known("estimated_salary")), "industry": F.coalesce(old("industry"), known("industry")), "enrichment_note": F.coalesce(known("deadline_info"), old("enrichment_note")),
        "scrape_status": F.when(F.col("e").isNotNull(), F.concat(F.coalesce(old("scrape_status"), F.lit("")), F.lit(" + Enriched (AI)"))).otherwise(old("scrape_status")),
    })
    return rows.drop("e")


def with_fallback(df: DataFrame, fields: DataFrame, key: str = "page_id") -> DataFrame:
    """``df`` with a model's fields in place of its own where the model has one; ``fields`` has the key and any of five columns."""
    names = [c for c in ("job_title", "company", "location", "salary", "requirements") if c in fields.columns]
    told = fields.groupBy(key).agg(F.max(F.struct(*names)).alias("m"))
    rows = df.join(told, key, "left").withColumns({c: F.coalesce(listed(F.col(f"m.{c}")), F.col(c)) for c in names})
    status = F.when(F.col("m").isNotNull(), "Success (LLM AI Fallback)").otherwise(F.col("scrape_status") if "scrape_status" in df.columns else F.lit(None).cast("string"))
    return rows.withColumn("scrape_status", status).drop("m")


def unfenced(answer: Column) -> Column:
    """A model's answer without the marks around a block of code."""
    return F.regexp_replace(F.regexp_replace(answer, r"```(?:json)?", ""), r"^\s+|\s+$", "")


def insight_input(df: DataFrame, most: int = 30, chars: int = 400) -> DataFrame:
    """One text of the first rows for a model that summarises a market: titles, companies and the first characters of texts."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, chars)
    text = lambda c: F.coalesce(c, F.lit(""))
    one = F.concat(F.lit("Title: "), text("job_title"), F.lit("\nCompany: "), text("company"), F.lit("\nDesc: "), cut("job_description_summary"), F.lit("\nReq: "), cut("requirements"), F.lit("\n---\n"))
    first = df.orderBy(*rank_order()).limit(most).select(F.struct(-F.col("match_score").cast("double"), -F.col("data_confidence").cast("double"), F.col("date_posted").isNull(), "date_posted", "company", "seq").alias("o"), one.alias("t"))
    return first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "").alias("text"))
