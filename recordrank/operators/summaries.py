"""Histograms, counters, rankings and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..plans.tables import written


def dense_counts(df: DataFrame, column: str, labels: list[str], other: str) -> DataFrame:
    """A row for each label, also those without rows; an unknown value counts as ``other``."""
    known = df.select(F.when(F.col(column).isin(labels), F.col(column)).otherwise(other).alias("label"))
    rows = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")
    return F.broadcast(rows).join(known.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", "place", F.coalesce("n", F.lit(0)).alias("n"))


def open_counts(df: DataFrame, column: str, order: str = "seq") -> DataFrame:
    """Values with counts, the most frequent first, then the first seen."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def category_counts(df: DataFrame) -> DataFrame:
    s = F.col("match_score")
    cuts = [("strong", s >= 85), ("good", (s >= 75) & (s < 85)), ("possible", (s >= 60) & (s < 75)), ("weak", (s >= 45) & (s < 60)), ("rejected", s < 45)]
    return df.agg(*[F.count_if(c).alias(n) for n, c in cuts])


def run_summary(df: DataFrame, before: int | Column) -> DataFrame:
    """One row of counters over scored postings with deadlines and reasons, in one aggregation."""
    c = F.col
    labels = {f"gpa_{i}": F.count_if(c("gpa_status") == x) for i, x in enumerate(V.GRADE_LABELS)}
    parts = {
        "rows_total": F.count("*"), "apply_today": F.count_if(c("reason").isNull()), "strong": F.count_if(c("match_score") >= 85), "good": F.count_if(c("match_score").between(75, 84)), "possible": F.count_if(c("match_score").between(60, 74)),
        "expired": F.count_if(c("deadline_status") == "Expired"), "open": F.count_if(c("deadline_status") == "Open"), "unknown": F.count_if(c("deadline_status") == "Unknown"), "urgent": F.count_if(c("urgency_level") == "High"), "soon": F.count_if(c("urgency_level") == "Medium"),
        "expired_removed": F.count_if((c("reason") == "Expired deadline") & (c("match_score") >= 75)), **labels,
    }
    return df.agg(*[x.alias(n) for n, x in parts.items()]).withColumn("duplicates_removed", F.lit(before) - F.col("rows_total"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with their rank over all rows.

    The ranks are counted within range partitions and shifted by the partitions' sizes, which are as many numbers as
    partitions; no task gets all rows. The rows are written before the ranges are found, so what they come from is computed once, and the ranges are written and read for the sizes
    as well as for the rows, so both see the same bounds.
    """
    spark = df.sparkSession
    df = written(df, "unranked")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = written(rows, "ranked")
    rows = rows.withColumns({"_p": F.shiftright("_m", 33).cast("int"), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + F.col("_r") + 1).drop("_m", "_p", "_r", "_before")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with their rank: a bounded heap in each task, then one of n rows."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def heat_map(events: DataFrame, last_day: str, days: int = 84) -> DataFrame:
    """Every day of the span with its number of events and a level of 0 to 4."""
    spark = events.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("day"))
    counts = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return span.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.least(F.coalesce("n", F.lit(0)), F.lit(4)).alias("level"))


def transposed(df: DataFrame, key: str, columns: list[str], ids: list) -> DataFrame:
    """Aspects as rows and the given items as columns."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    return df.where(F.col(key).isin(ids)).selectExpr(key, f"stack({len(columns)}, {pairs}) as (aspect, value)").groupBy("aspect").pivot(key, ids).agg(F.first("value"))


#: Counters of a run's summary by the values of a column.
_BY_VALUE = {
    "gpa_status": {"Priority GPA Match": "gpa_priority_match_count", "Meets GPA": "gpa_meets_count", "Slight GPA Gap": "gpa_slight_gap_count", "Moderate GPA Gap": "gpa_moderate_gap_count", "High GPA Gap": "gpa_high_gap_count", "No GPA Listed": "gpa_not_listed_count", "Qualitative GPA Requirement": "gpa_qualitative_count"},
    "deadline_status": {"Open": "deadline_open_count", "Expired": "deadline_expired_count", "Unknown": "deadline_unknown_count"},
    "urgency_level": {"High": "deadline_urgent_high_count", "Medium": "deadline_urgent_medium_count"},
}


def _counters(df: DataFrame) -> dict[str, Column]:
    s = F.col("match_score")
    out = {"strong_match_count": s >= 85, "good_match_count": (s >= 75) & (s < 85), "possible_match_count": (s >= 60) & (s < 75), "weak_match_count": (s >= 45) & (s < 60), "not_recommended_count": s < 45}
    for column, values in _BY_VALUE.items():
        if column in df.columns:
            out |= {name: F.col(column) == value for value, name in values.items()}
    if "reason" in df.columns:
        out |= {"expired_removed_from_apply_today_count": F.col("reason") == "Expired deadline", "total_apply_today": F.col("reason").isNull()}
    else:
        ready = (s >= 75) & (F.coalesce("data_confidence", F.lit(0)) >= 60) & F.col("recommendation").isin("Apply", "Apply / Maybe") & (F.col("gpa_status") != "High GPA Gap")
        out["total_apply_today"] = ready
    if "deadline_points" in df.columns:
        out["scores_changed_by_deadline_count"] = F.col("deadline_points") != 0
    if "gpa_status" in df.columns:
        out["scores_changed_by_gpa_count"] = F.col("gpa_status") != "No GPA Listed"
    return {name: F.count_if(F.coalesce(c, F.lit(False))) for name, c in out.items()}


def _header(run: dict, started: Column | None, finished: Column | None) -> dict[str, Column]:
    out = {k: F.lit(v) for k, v in run.items()}
    if started is not None:
        out |= {"started_at": started, "finished_at": finished, "duration_seconds": F.timestamp_diff("SECOND", started, finished)}
    return out


def full_summary(df: DataFrame, loaded: dict[str, int], run: dict | None = None, started: Column | None = None, finished: Column | None = None) -> DataFrame:
    """One row that describes a run over its exported rows, in one aggregation.

    ``loaded`` has the counts that only the run knows: previous_rows_loaded, new_rows_loaded, total_links_discovered,
    total_successful_detail_pages; the rows before deduplication are the first two together. ``run`` has texts such as run_id and folders.
    """
    before = loaded.get("previous_rows_loaded", 0) + loaded.get("new_rows_loaded", 0)
    told = {k: F.lit(v).cast("long") for k, v in loaded.items()}
    told |= {"historical_rows_loaded": F.lit(loaded.get("previous_rows_loaded", 0)).cast("long"), "total_rows_before_dedup": F.lit(before).cast("long"), "total_detail_pages_attempted": F.lit(loaded.get("total_links_discovered", 0)).cast("long"),
             "total_detail_pages_failed": F.lit(loaded.get("total_links_discovered", 0) - loaded.get("total_successful_detail_pages", 0)).cast("long")}
    out = df.agg(F.count("*").alias("total_exported"), *[c.alias(n) for n, c in _counters(df).items()])
    return out.withColumn("duplicates_removed", F.lit(before) - F.col("total_exported")).withColumns(told | _header(run or {}, started, finished))


def rescore_summary(df: DataFrame, run: dict | None = None, started: Column | None = None, finished: Column | None = None) -> DataFrame:
    """One row that describes a rescoring: nothing loaded anew, nothing removed."""
    out = df.agg(F.count("*").alias("total_exported"), *[c.alias(n) for n, c in _counters(df).items()])
    return out.withColumns({"previous_rows_loaded": F.col("total_exported"), "total_rows_before_dedup": F.col("total_exported"), "new_rows_loaded": F.lit(0), "duplicates_removed": F.lit(0)} | _header({"run_type": "gpa_rescore"} | (run or {}), started, finished))


def audit_summary(df: DataFrame, run: dict | None = None, started: Column | None = None, finished: Column | None = None) -> DataFrame:
    """One row that describes an audit, with its totals of grades that pass and do not, and of rows without any description."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit("")
    ok = F.col("gpa_status").isin("Priority GPA Match", "Meets GPA", "No GPA Listed")
    more = {"total_jobs_audited": F.count("*"), "gpa_ok": F.count_if(ok), "gpa_above": F.count_if(F.contains("gpa_status", F.lit("GPA Gap"))), "no_description": F.count_if((text("job_description_summary") == "") & (text("requirements") == "")),
            "enriched_rows": F.count_if(F.contains(text("scrape_status"), F.lit("Enriched")))}
    return df.agg(*[c.alias(n) for n, c in (more | _counters(df)).items()]).withColumns(_header({"run_type": "one_pass_audit"} | (run or {}), started, finished))


def overview(df: DataFrame, board: DataFrame) -> DataFrame:
    """One row of the first page's counters: keys on the board, rows to apply to today, and three score bands."""
    s = F.col("match_score")
    bands = {"strong": s >= 85, "good": (s >= 75) & (s < 85), "possible": (s >= 60) & (s < 75)}
    return df.agg(F.count_if(F.col("reason").isNull()).alias("apply_today"), *[F.count_if(c).alias(n) for n, c in bands.items()]).withColumn("applied", board.agg(F.count("*")).scalar())


def filter_values(df: DataFrame) -> DataFrame:
    """``(kind, value)``: every place, by parts between commas, and every industry that the rows name."""
    places = df.select(F.explode(F.split("location", ",")).alias("v")).select(F.lit("location").alias("kind"), F.trim("v").alias("value"))
    industries = df.select(F.lit("industry").alias("kind"), F.col("industry").alias("value"))
    return places.unionByName(industries).where("value <> ''").distinct()


def top_values(df: DataFrame, column: str, n: int = 5, other: str = "Other") -> DataFrame:
    """The most frequent values of a column with their counts; a missing one counts as ``other``."""
    return df.groupBy(F.coalesce(column, F.lit(other)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def ready_counts(df: DataFrame) -> DataFrame:
    """How many rows are ready to apply to by each of three counts: without the severe codes, without the grade, and by both."""
    c = F.col
    base = (c("match_score") >= 75) & (F.coalesce("data_confidence", F.lit(0)) >= 60) & c("recommendation").isin("Apply", "Apply / Maybe")
    severe = F.arrays_overlap("reason_codes", F.array(*[F.lit(x) for x in V.SEVERE_EXPORT]))
    return df.agg(F.count_if(base).alias("report"), F.count_if(base & (c("gpa_status") != "High GPA Gap")).alias("without_severe"), F.count_if(base & ~severe & (c("gpa_status") != "High GPA Gap")).alias("both"))
