"""The rule score of a posting, its bands and adjustments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import vocabulary as V


def some(*items: Column) -> Column:
    """An array of the items that are not null."""
    return F.array_compact(F.array(*items))


def _codes(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def bands(value: Column, table: list[tuple], at: int) -> Column:
    """The entry ``at`` of the first band whose lower limit the value reaches; the last band has none."""
    out = F
    for limit, *rest in table[:-1]:
        out = out.when(value >= limit, rest[at - 1])
    return out.otherwise(table[-1][at])


def category(score: Column) -> Column:
    return bands(score, V.CATEGORIES, 1)


def recommendation(score: Column, confidence: Column | None = None) -> Column:
    rec = bands(score, V.CATEGORIES, 2)
    return rec if confidence is None else F.when(F.coalesce(confidence, F.lit(100)) < 50, "Review Manually").otherwise(rec)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row, whatever refers to them.

    The optimiser copies an expression into filters and projections above it; it does not copy out of a generator,
    and ``inline`` over an array of one struct is one that stays in generated code.
    """
    keep = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(*columns)) if len(columns) > 1 else df.select(*keep, F.explode(F.array(*columns.values())).alias(*columns))


def with_grade(df: DataFrame, text: Column, candidate: float = 3.29) -> DataFrame:
    """Required grade, gap, status, points and codes of the requirement in a text."""
    df = settled(df, _text=text)
    df = settled(df, **{f"_g{i}": g for i, g in enumerate(T.grade_tries(F.col("_text")))}, _phrase=T.grade_phrase(F.col("_text")))
    df = settled(df, gpa_required=F.coalesce(*[F.when(F.col(f"_g{i}").between(2, 4), F.col(f"_g{i}")) for i in range(len(V.GRADE_PATTERNS))]))
    value, phrase = F.col("gpa_required"), F.col("_phrase")

    def pick(at: int, wrap=F.lit) -> Column:
        out = F
        for limit, *rest in V.GRADE_BANDS:
            # the bands are those of one grade: they end at the candidate's, and what is above it moves with it
            limit = min(limit, candidate) if limit < V.BAND_GRADE else limit if limit > 5 else round(limit - V.BAND_GRADE + candidate, 2)
            out = out.when(value <= F.lit(str(limit)).cast("decimal(3,2)"), wrap(rest[at]))
        return out.when(phrase, wrap(V.GRADE_QUALITATIVE[at])).otherwise(wrap(V.GRADE_NONE[at]))

    gap = F.when(value <= F.lit(str(candidate)).cast("decimal(3,2)"), F.lit(0)).when(value.isNotNull(), F.greatest(value - F.lit(str(candidate)).cast("decimal(3,2)"), F.lit(0))).cast("decimal(4,2)")
    return settled(df, gpa_gap=gap, gpa_status=pick(0), gpa_points=pick(1), gpa_codes=pick(2, _codes)).drop("_text", "_phrase", *[f"_g{i}" for i in range(len(V.GRADE_PATTERNS))])


def with_due(df: DataFrame, url: Column, text: Column, today: str) -> DataFrame:
    """Deadline, days left, status, urgency and points."""
    df = settled(df, _text=text)
    df = settled(df, **{f"_d{i}": T.groups(F.col("_text"), p) for i, (p, _) in enumerate(V.DEADLINE_PATTERNS)}, _u=T.groups(url, T.URL_MONTH))
    df = settled(df, deadline_parsed=F.coalesce(T.url_deadline(F.col("_u")), T.text_deadline([F.col(f"_d{i}") for i in range(len(V.DEADLINE_PATTERNS))])))
    return settled(df, **_due_fields(F.col("deadline_parsed"), F.lit(today).cast("date"))).drop("_text", "_u", *[f"_d{i}" for i in range(len(V.DEADLINE_PATTERNS))])


def _due_fields(day: Column, today: Column) -> dict[str, Column]:
    left = F.date_diff(day, today)
    status = urgency = points = F
    for limit, s, u, p in V.DEADLINE_BANDS:
        status, urgency, points = status.when(left <= limit, s), urgency.when(left <= limit, u), points.when(left <= limit, p)
    urgency = urgency.when(left.isNotNull(), "Low").otherwise("Unknown")
    return {"days_until_deadline": left, "deadline_status": status.when(left.isNotNull(), "Open").otherwise("Unknown"), "urgency_level": urgency, "deadline_points": points.otherwise(0)}


def deadline_codes(urgency: Column) -> Column:
    out = F
    for u, codes in V.DEADLINE_CODES.items():
        out = out.when(urgency == u, _codes(codes))
    return out.otherwise(_codes(V.DEADLINE_CODES["Unknown"]))


def deadline_note(day: Column, left: Column) -> Column:
    on = F.concat(F.lit(" ("), day.cast("string"), F.lit(")"))
    days = F.concat(left.cast("string"), F.lit(" days left"), on)
    return F.when(left < 0, F.concat(F.lit("Expired "), F.abs(left).cast("string"), F.lit(" days ago"), on)).when(left <= 3, F.concat(F.lit("Urgent! "), days)).when(left.isNotNull(), days).otherwise("No deadline detected")


def grade_note(required: Column, status: Column, candidate: float = 3.29) -> Column:
    """A sentence on a grade; it is never searched for a requirement."""
    out, wanted = F, required.cast("decimal(3,2)").cast("string")
    for (limit, *_), says in zip(V.GRADE_BANDS, V.GRADE_NOTES):
        out = out.when(required <= F.lit(str(limit)).cast("decimal(3,2)"), F.concat(F.lit(f"GPA {candidate} {says} "), wanted))
    return out.when(status == V.GRADE_QUALITATIVE[0], "Only qualitative academic requirement detected").otherwise("No GPA requirement detected")


def score(postings: DataFrame, profile: V.Profile | None = None) -> DataFrame:
    """``postings`` with match_score, match_category, recommendation, why_match, gaps, reason_codes and the grade's columns.

    One projection of built-in expressions: no shuffle. A missing text counts as empty.
    """
    p = profile or V.Profile()
    blank = lambda c: F.coalesce(F.lower(F.col(c)), F.lit(""))
    rows = settled(postings, _title=blank("job_title"), _full=F.concat_ws(" ", blank("job_title"), blank("job_description_summary"), blank("requirements")), _company=blank("company"))
    title, full = F.col("_title"), F.col("_full")
    rows = with_grade(rows, T.joined_fields(postings.columns, V.GRADE_FIELDS), p.grade)
    industry = F.coalesce(*[F.when(F.contains(full, F.lit(i)) | F.contains(F.col("_company"), F.lit(i)), F.lit(i)) for i in p.industries])
    rows = settled(
        rows, _role=T.first_in(title, p.roles), _skills=T.all_in(full, p.skills), _industry=industry, _entry=T.any_in(full, p.entry_terms), _leads=T.any_in(full, p.leadership), _studied=T.any_in(full, p.education),
        _three=full.rlike(r"3\s*(?:year|tahun)"), _five=full.rlike(r"5\s*(?:year|tahun)"), _unpaid=T.any_in(full, ["commission only", "unpaid", "tidak dibayar"]),
    )
    c, when = F.col, F.when
    points = (
        when(c("_role").isNotNull(), 20).otherwise(0) + 20 + F.least(F.lit(20), F.size("_skills") * 2) + when(c("_industry").isNotNull(), 10).otherwise(0) + when(c("_leads"), 10).otherwise(0) + when(c("_studied"), 10).otherwise(0)
        + (5 if p.relocates else 0) + 5 - when(c("_three"), 15).otherwise(0) - when(c("_five"), 30).otherwise(0) - when(c("_unpaid"), 25).otherwise(0) + c("gpa_points")
    )
    per_skill = F.flatten(F.transform("_skills", lambda s: some(*[when(F.contains(s, F.lit(w)), F.lit(code)) for w, code in p.skill_codes])))
    chain = F.exists("_skills", lambda s: s.contains("supply chain") | s.contains("operations"))
    codes = F.concat(
        some(when(c("_role").isNotNull() & T.any_in(title, ["mt", "odp", "trainee"]), "MT_ODP_MATCH"), when(c("_entry"), "FRESH_GRAD_ACCEPTED"), when(chain, "OPS_SUPPLY_CHAIN_MATCH")),
        per_skill,
        some(when(c("_industry") == "fmcg", "FMCG_MATCH"), when(~c("_studied"), "MAJOR_RISK"), F.lit("NATIONWIDE_PLACEMENT" if p.relocates else None), when(c("salary").isNull(), "SALARY_MISSING"), when(c("_three") | c("_five"), "EXPERIENCE_TOO_HIGH"), when(c("company").isNull(), "UNCLEAR_COMPANY"),
             when(F.length(F.coalesce("job_description_summary", F.lit(""))) < 100, "VAGUE_JD"), when(c("_unpaid"), when(F.contains(full, F.lit("unpaid")), "UNPAID_INTERNSHIP").otherwise("COMMISSION_ONLY"))),
        c("gpa_codes"),
    )
    why = some(
        F.concat(F.lit("Role match: "), c("_role")), when(c("_entry"), "Experience match: Entry level (0-2 years)"), when(F.size("_skills") > 0, F.concat(F.lit("Skills matched: "), F.array_join(F.slice("_skills", 1, 3), ", "))),
        F.concat(F.lit("Industry match: "), c("_industry")), when(c("_leads"), "Leadership/Execution fit"), when(c("_studied"), "Education match"), F.lit("Willing to relocate (nationwide)" if p.relocates else None),
    )
    gaps = some(when(c("_three"), "Requires 3+ years experience"), when(c("_five"), "Requires 5+ years experience"), when(c("_unpaid"), "Commission-only or unpaid"), when(c("gpa_points") < 0, F.concat(F.lit("GPA risk: "), c("gpa_status"))))
    skills = F.when(F.size("_skills") > 0, F.array_join(F.slice("_skills", 1, 3), ", ")).otherwise("operational leadership")
    tailoring = F.concat(F.lit("Document: "), T.document_variant(c("job_title"), p.variants, p.variant), F.lit(". Highlight "), skills)
    # only what conditions refer to is settled; lists stay plain projections, so a query that does not want them does not make them
    rows = settled(rows, match_score=F.greatest(F.lit(0), F.least(F.lit(100), points)))
    rows = rows.withColumns({"reason_codes": codes, "why_match": why, "gaps": gaps, "suggested_cv_tailoring": tailoring})
    rows = rows.withColumns({"match_category": category(c("match_score")), "recommendation": recommendation(c("match_score"), c("data_confidence")), "gpa_note": grade_note(c("gpa_required"), c("gpa_status"), p.grade)})
    return rows.drop(*[x for x in rows.columns if x.startswith("_")], "gpa_codes", "gpa_points")


def with_deadline(scored: DataFrame, today: str) -> DataFrame:
    """The deadline's columns, its points within the score, and its code in place of an older one."""
    rows = with_due(scored, F.col("job_url"), T.joined_fields(scored.columns, V.DEADLINE_FIELDS), today)
    rows = rows.withColumn("deadline_note", deadline_note(F.col("deadline_parsed"), F.col("days_until_deadline")))
    changed = F.greatest(F.lit(0), F.least(F.lit(100), F.col("match_score") + F.col("deadline_points")))
    rows = settled(rows, match_score=F.when(F.col("deadline_points") != 0, changed).otherwise(F.col("match_score")))
    codes = F.concat(F.filter("reason_codes", lambda x: ~x.startswith("DEADLINE_")), deadline_codes(F.col("urgency_level")))
    return settled(rows, match_category=category(F.col("match_score")), recommendation=recommendation(F.col("match_score"), F.col("data_confidence")), reason_codes=codes)


def not_today(rows_score: Column, confidence: Column, rec: Column, codes: Column, grade_status: Column, deadline_status: Column, url: Column) -> Column:
    """Why a posting is not one to apply to today; null if it is."""
    severe = [F.when(F.array_contains(codes, s), F.lit({"GPA_RISK_HIGH": "High GPA gap", "DEADLINE_EXPIRED": "Expired deadline"}.get(s, s.replace("_", " ").title()))) for s in V.SEVERE]
    return F.coalesce(
        F.when(deadline_status == "Expired", "Expired deadline"), F.when(rows_score < 75, "Score below 75"), F.when(F.coalesce(confidence, F.lit(0)) < 60, "Data confidence below 60"), F.when(~rec.isin("Apply", "Apply / Maybe"), "Recommendation not Apply"), *severe,
        F.when(url.isNull(), "Missing apply URL"), F.when(grade_status == "High GPA Gap", "High GPA gap"), F.when((grade_status == "Moderate GPA Gap") & (rows_score < 90), "Moderate GPA gap and score below 90"), F.when((grade_status == "Slight GPA Gap") & (rows_score < 80), "Slight GPA gap and score below 80"),
    )


def apply_today(rows_score: Column, confidence: Column, rec: Column, codes: Column, grade_status: Column) -> Column:
    """The exporter's variant of the same question."""
    severe = F.arrays_overlap(codes, F.array(*[F.lit(s) for s in V.SEVERE_EXPORT]))
    return (rows_score >= 75) & (confidence >= 60) & rec.isin("Apply", "Apply / Maybe") & ~severe & (grade_status != "High GPA Gap") & ~((grade_status == "Moderate GPA Gap") & F.array_contains(codes, "MAJOR_RISK"))


def blend(base: Column, model: Column) -> Column:
    """0.4 of the rule score and 0.6 of the model's, to one decimal, halves up."""
    return F.when(model.isNull(), base.cast("decimal(5,1)")).otherwise(F.round(base.cast("decimal(6,2)") * F.lit("0.4").cast("decimal(2,1)") + model.cast("decimal(6,2)") * F.lit("0.6").cast("decimal(2,1)"), 1).cast("decimal(5,1)"))


def data_confidence(**fields: Column) -> Column:
    """Points for the fields that are there."""
    has = lambda *names: sum((F.when(fields[n].isNotNull(), 1).otherwise(0) for n in names), F.lit(0)) > 0
    parts = [(20, ("title",)), (15, ("company",)), (15, ("location",)), (15, ("requirements",)), (15, ("description", "responsibilities")), (10, ("posted", "deadline")), (10, ("url",))]
    return sum((F.when(has(*names), n).otherwise(0) for n, names in parts), F.lit(0))


def pay_fit(pay: Column, low: Column, high: Column) -> Column:
    return F.when(pay >= high, 1.0).when(pay >= low, 0.7 + 0.3 * (pay - low) / F.nullif(high - low, F.lit(0.0))).when(pay >= 0.8 * low, 0.4).otherwise(0.1)
