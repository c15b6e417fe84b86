"""Sources of postings, states and pages, all with a schema; a missing value is null, never the sentinel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import feed_title, listed, plain, unescaped
from ..operators.summaries import ranked
from ..plans.tables import written

#: Headers of ranked files and their columns.
HEADERS = {
    "Rank": "rank", "Score": "match_score", "Match Category": "match_category", "Recommendation": "recommendation", "Job Title": "job_title", "Company": "company", "Location": "location", "Source": "source", "Link": "job_url",
    "Why Match": "why_match", "Gaps / Concerns": "gaps", "Suggested CV Tailoring": "suggested_cv_tailoring", "Application Deadline": "deadline", "Salary": "salary", "Date Posted": "date_posted", "Apply Link": "apply_url",
}
#: Names under which files carry the same value.
SYNONYMS = {"job_title": ["title", "position"], "company": ["company_name", "perusahaan"], "location": ["lokasi"], "job_url": ["url", "link", "job_link"], "match_score": ["score"], "gaps": ["gaps_or_concerns"], "why_match": ["match_reasons", "recommendation_insight"]}


def snake(name: str) -> str:
    name = name.lstrip("﻿").strip()
    return HEADERS.get(name) or "_".join("".join(ch if ch.isalnum() else " " for ch in name.lower()).split())


def _names(spark: SparkSession, headers: DataFrame) -> dict[str, str]:
    """Columns by the names that files give them: as many rows for the driver as there are different names."""
    return {r.name: snake(r.name) for r in headers.select(F.explode("header").alias("name")).distinct().where("name is not null").collect()}


def read_ranked(spark: SparkSession, path: str, columns: list[str] | None = None, only: str | None = None, skip: tuple[str, ...] = ("latest", "archive_old")) -> DataFrame:
    """CSV files of ranked postings under a folder: quoted line ends, a byte-order mark, any columns in any order in each file.

    Files are listed and read by Spark alone, headers included, which stand on one line: a file's rows meet its header and are put together by name, so the number of files, or of different headers, sets no plan. A
    column that a file lacks is null. Files whose path contains a text of ``skip`` are left out, and with ``only`` those without it. Every row has ``run_path`` and a ``seq`` that orders the rows by path and place. A
    number that cannot be read is 0 for the score and the confidence. No file gives an empty table of the named columns.
    """
    where = F.col("_metadata.file_path")
    chosen = F.lit(True) if only is None else F.contains(where, F.lit(only))
    for x in skip:
        chosen = chosen & ~F.contains(where, F.lit(x))

    def empty() -> DataFrame:
        names = columns or list(dict.fromkeys(HEADERS.values()))
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*names, "run_path"]) + ", seq bigint")

    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    try:
        lines = found.text(path).where(chosen)
    except AnalysisException:
        return empty()
    # no header has more fields than its line has commas, and one
    begun = lines.where("_metadata.file_block_start = 0").select(where.alias("f"), F.monotonically_increasing_id().alias("at"), "value")
    first = begun.groupBy("f").agg(F.min_by("value", "at").alias("head"))
    width = first.agg(F.max(F.length("head") - F.length(F.replace("head", F.lit(","))) + 1)).first()[0]
    if not width:
        return empty()
    schema = ", ".join(f"`c{i}` string" for i in range(width))
    csv = found.option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True).schema(schema)
    cells = F.array(*[F.col(f"c{i}") for i in range(width)])
    # a file is read by one task from its start on, so its rows are numbered in their order
    rows = csv.csv(path).where(chosen).select(where.alias("_file"), F.monotonically_increasing_id().alias("_place"), cells.alias("header"))
    headers = written(rows.groupBy("_file").agg(F.min_by("header", "_place").alias("header")), "headers")
    names = _names(spark, headers)
    canonical = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    numbered = ranked(headers, F.col("_file")).select("_file", F.transform("header", lambda n: canonical[n]).alias("_names"), F.col("rank").alias("_no"))
    df = csv.option("header", True).csv(path).where(chosen).select(where.alias("run_path"), F.monotonically_increasing_id().alias("_place"), cells.alias("_cells")).join(numbered, F.col("run_path") == F.col("_file"))
    df = df.withColumn("_pairs", F.arrays_zip("_names", "_cells"))
    known = [n for n in dict.fromkeys(names.values()) if n]
    wanted: dict[str, list[str]] = {n: [n] for n in known}
    for name, others in SYNONYMS.items():
        if given := [x for x in [name, *others] if wanted.pop(x, None)]:
            wanted[name] = given

    def value(name: str) -> Column:
        return F.get(F.filter(F.transform(F.filter("_pairs", lambda p: p["_names"] == name), lambda p: listed(p["_cells"])), lambda v: v.isNotNull()), F.lit(0))

    for c in columns or []:
        wanted.setdefault(c, [])
    cells_of = {n: F.coalesce(*[value(x) for x in given]) if given else F.lit(None).cast("string") for n, given in wanted.items()}
    for c in ("match_score", "data_confidence"):
        if wanted.get(c):
            cells_of[c] = F.coalesce(cells_of[c].try_cast("double"), F.lit(0.0))
    seq = F.col("_no") * F.lit(1 << 33) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return df.select(*[v.alias(n) for n, v in cells_of.items()], "run_path", seq.alias("seq"))


def read_feed(spark: SparkSession, path: str, source: str, limit: int | None = None) -> DataFrame:
    """Links of an RSS file's items that have one: title and company from the title, a description of 300 characters without tags."""
    df = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    title, company = feed_title(unescaped(F.col("title")))
    # files in order of their path, items by the file's block and their place in it
    at = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_p")).where(F.coalesce(F.trim("link"), F.lit("")) != "")
    df = ranked(at, F.col("_f"), F.col("_b"), F.col("_p")).withColumn("seq", F.col("rank") - 1)
    df = df.select(F.trim("link").alias("job_url"), title.alias("job_title"), F.lit(source).alias("source_name"), company.alias("company"), F.substring(F.trim(plain(unescaped(F.col("description")))), 1, 300).alias("description_preview"), F.col("pubDate").alias("pub_date"), "seq")
    return df.orderBy("seq").limit(limit) if limit else df


#: Maps of a workflow document.
STATE = "kanban map<string,string>, hidden map<string,timestamp>, notes map<string,string>, apply_dates map<string,date>, reminders map<string,string>, timeline map<string,array<struct<status:string,date:string>>>"


def read_state(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One map of a workflow document as ``(id, value)``; a missing or broken document is empty."""
    try:
        df = spark.read.option("multiLine", True).schema(STATE).json(path)
    except AnalysisException:
        df = spark.createDataFrame([], STATE)
    return df.select(F.explode(name).alias("id", "value"))


def catalog(core: DataFrame, optional: DataFrame | None = None) -> DataFrame:
    """The sources to visit: the core ones, and the optional ones where given."""
    return core if optional is None else core.unionByName(optional, allowMissingColumns=True)


def history(*runs: DataFrame) -> DataFrame:
    """All runs one after the other, with ``seq`` in that order."""
    out = None
    for i, df in enumerate(runs):
        df = df.withColumn("_run", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("seq", F.col("_run") * F.lit(1 << 48) + F.col("seq")).drop("_run")


#: Schemas of caches, by name; all are maps from a key to an entry.
CACHES = {"urls": "map<string,timestamp>", "health": "map<string,struct<errors:int,total:int,blocked:boolean>>", "semantic": "map<string,struct<semantic_score:double,reasoning:string,salary:string,timestamp:timestamp>>",
          "enrichment": "map<string,struct<data:struct<company_type:string,estimated_salary:string,industry:string,deadline_info:string>,timestamp:timestamp>>"}


def read_cache(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A cache's document as ``(key, value)``; a missing or broken one is empty."""
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    return text.select(F.explode(F.from_json("value", CACHES[name])).alias("key", "value"))


def read_bodies(pages: DataFrame, column: str = "api_data") -> DataFrame:
    """Captured JSON bodies of a page as variants, in order: ``column`` is an array of texts; one that is not JSON is left out."""
    return pages.select(*[c for c in pages.columns if c != column], F.posexplode(column).alias("pos", "body")).withColumn("body", F.try_parse_json("body")).where("body is not null")


def read_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A published run: its one-row summary, its ranked rows with ids, and its insights; those that are missing are empty."""

    def document(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("multiLine", True).json(f"{path}/{name}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    rows = read_ranked(spark, path, ["job_title", "company", "location"], skip=())
    key = lambda *cs: F.substring(F.regexp_replace(F.lower(F.concat_ws("", *cs)), "[^a-z0-9]", ""), 1, 80)
    rows = rows.withColumns({"id": key("company", "job_title", "location"), "id_alt": key("job_title", "company", "location")})
    return document("run_summary.json", "run_id string, finished_at string, total_exported bigint, total_apply_today bigint"), rows, document("market_insights.json", "top_skills array<struct<skill:string,demand:string>>, hiring_trend_summary string, salary_insights string")
