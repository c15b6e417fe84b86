"""Links and postings in pages: rules as built-in expressions, one pass over the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ANCHOR = r"(?is)<a\s[^>]*href=[\"'][^\"'#]+[\"'][^>]*>.*?</a>"
_HREF = r"(?is)^<a\s[^>]*href=[\"']([^\"'#]+)[\"']"
_CLASS = r"(?is)^<a\s[^>]*class=[\"']([^\"']*)[\"']"

#: Rules of the parsers: a part of the address that must be in it, one that must not, a part of the anchor's class, where the address is cut, the least title,
#: a part of the whole address, one row for each address. Those of curated and graduate boards look at the page's structure, see ``dom``.
RULES = {
    "board_a": {"has": "/id/job/", "cut": "\\?", "title": 0, "once": False},
    "board_b": {"has": "", "class": "jcs-JobTitle", "cut": "&", "title": 0, "once": False},
    "board_c": {"has": "/job/", "cut": None, "title": 6, "once": False},
    "aggregator": {"has": "/desc/", "cut": None, "title": 0, "once": False},
    "board_d": {"has": "/opportunities/jobs/", "lacks": "/explore", "cut": "\\?", "title": 0, "once": True},
    "board_e": {"has": "/jobs?/", "host": "kalibrr", "cut": "\\?", "title": 0, "once": True},
    "any": {"has": "", "cut": "\\?", "title": 0, "once": True},
}


#: Types of sources and their rules; large boards are told apart by address.
SOURCE_TYPES = {"rss_feed": "rss", "curated_job_board": "curated", "graduate_job_board": "graduate", "job_board": "board_c", "aggregator": "aggregator", "glints": "board_d", "kalibrr": "board_e"}


def parser_of(source_type: Column, url: Column) -> Column:
    """Which rule reads a source: by its type, and for large boards by a part of the address; null for other types."""
    large = F
    for part, rule in (("jobstreet", "board_a"), ("indeed", "board_b"), ("glints", "board_d"), ("kalibrr", "board_e")):
        large = large.when(F.contains(url, F.lit(part)), rule)
    out = F.when(source_type == "large_job_board", large)
    for kind, rule in SOURCE_TYPES.items():
        out = out.when(source_type == kind, rule)
    return out


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(…, pos, href, classes, title)``: a row for each anchor, in order."""
    keys = [c for c in pages.columns if c != html]
    out = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))).alias("pos", "_a"))
    title = F.trim(F.regexp_replace(F.regexp_replace("_a", r"(?is)^<a\s[^>]*>", ""), "<[^>]+>", ""))
    return out.select(*keys, "pos", F.regexp_extract("_a", _HREF, 1).alias("href"), F.regexp_extract("_a", _CLASS, 1).alias("classes"), title.alias("title"))


def links(pages: DataFrame, rule: str, page: str = "page_id", url: str = "url") -> DataFrame:
    """``(page, pos, job_url, job_title)`` by a rule; relative addresses are joined with the page's host."""
    r = RULES[rule]
    out = anchors(pages)
    full = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.array_join(F.slice(F.split(url, "/"), 1, 3), "/"), F.when(F.col("href").startswith("/"), "").otherwise("/"), F.col("href")))
    out = out.withColumn("job_url", full)
    if r["has"]:
        out = out.where(F.col("job_url").rlike(r["has"]))
    if r.get("class"):
        out = out.where(F.contains("classes", F.lit(r["class"])))
    if r.get("lacks"):
        out = out.where(~F.contains("job_url", F.lit(r["lacks"])))
    if r["cut"]:
        out = out.withColumn("job_url", F.split("job_url", r["cut"])[0])
    if r.get("host"):
        # of the address as it stays: what is cut off does not count
        out = out.where(F.contains("job_url", F.lit(r["host"])))
    out = out.where(F.length("title") >= r["title"]).select(page, "pos", "job_url", F.col("title").alias("job_title"))
    if r["once"]:
        out = out.groupBy(page, "job_url").agg(F.min("pos").alias("pos"), F.min_by("job_title", "pos").alias("job_title")).select(page, "pos", "job_url", "job_title")
    return out


def page_urls(sources: DataFrame, pages: int) -> DataFrame:
    """Addresses of the pages of curated sources; others have one."""
    n = F.when(F.col("source_type") == "curated_job_board", pages).otherwise(1)
    out = sources.select("*", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    return out.withColumn("page_url", F.when(F.col("page") == 1, F.col("url")).otherwise(F.format_string("%s/page/%d/", F.regexp_replace("url", "/$", ""), F.col("page"))))


def until_stale(found: DataFrame, source: str = "source_name") -> DataFrame:
    """First addresses of each source up to its first page without a new one."""
    first = found.groupBy(source, "job_url").agg(F.min(F.struct("page", "pos")).alias("at"), F.min_by("job_title", F.struct("page", "pos")).alias("job_title"))
    first = first.select(source, "job_url", "job_title", "at.*")
    fresh = first.select(source, "page").distinct()
    gap = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy("page"))).where(F.col("_n") == F.col("page"))
    return first.join(gap.select(source, "page"), [source, "page"], "left_semi")


def limited(found: DataFrame, per_source: int, total: int, source: str = "source_name", order: str = "source_no") -> DataFrame:
    """At most ``per_source`` rows of each source; sources end after the one that crosses ``total``."""
    rows = found.withColumn("rn", F.row_number().over(Window.partitionBy(source).orderBy("page", "pos"))).where(F.col("rn") <= per_source)
    counts = rows.groupBy(source, order).agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.orderBy(order)) - F.col("n")).where(F.col("_before") < total)
    return rows.join(before.select(source), source, "left_semi").drop("rn")


_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def job_ld(pages: DataFrame, html: str = "html") -> DataFrame:
    """Fields of the first JobPosting in a page's JSON-LD: a root object, a list's item, or one of ``@graph``; broken scripts are passed over."""

    def at(v: str, path: str) -> str:
        return f"try_variant_get({v}, '{path}', 'string')"

    # a page's scripts, their items and the first posting among those are one row's work: array functions, no shuffle
    keys = [c for c in pages.columns if c != html]
    lists = "coalesce(try_cast(v as array<variant>), try_cast(try_variant_get(v, '$[\"@graph\"]', 'variant') as array<variant>), array(v))"
    is_one = at("p", '$["@type"]') + " = 'JobPosting'"
    firsts = F.expr(f"get(filter(transform(_v, v -> get(filter({lists}, p -> {is_one}), 0)), p -> p is not null), 0)")
    scripts = F.transform(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), lambda t: F.try_parse_json(t))
    p = pages.select(*keys, scripts.alias("_v")).select(*keys, F.explode(F.array(firsts)).alias("_p")).where("_p is not null")
    e = lambda path: F.expr(at("_p", path))
    obj = lambda path: F.expr(f"schema_of_variant(try_variant_get(_p, '{path}', 'variant')) like 'OBJECT%'")
    pay, low, high = e("$.baseSalary.value.value"), e("$.baseSalary.value.minValue"), e("$.baseSalary.value.maxValue")
    unit = F.coalesce(e("$.baseSalary.value.unitText"), F.lit(""))
    place = F.coalesce(F.when(obj("$.jobLocation.address"), F.coalesce(e("$.jobLocation.address.addressLocality"), e("$.jobLocation.address.addressRegion"))).otherwise(e("$.jobLocation.address")), F.when(~obj("$.jobLocation"), e("$.jobLocation")))
    place = F.when(F.expr("schema_of_variant(try_variant_get(_p, '$.jobLocation', 'variant')) like 'ARRAY%'"), F.lit(None)).otherwise(place)
    return p.select(
        *keys, e("$.title").alias("job_title"), F.when(obj("$.hiringOrganization"), e("$.hiringOrganization.name")).otherwise(e("$.hiringOrganization")).alias("company"), place.alias("location"), e("$.datePosted").alias("date_posted"), e("$.validThrough").alias("deadline"),
        F.coalesce(F.when(~obj("$.baseSalary"), e("$.baseSalary")), F.when(~obj("$.baseSalary.value"), e("$.baseSalary.value")), pay, F.when(low.isNotNull(), F.trim(F.concat(low, F.lit("-"), F.coalesce(high, F.lit("")), F.lit(" "), unit)))).alias("salary"), e("$.employmentType").alias("employment_type"), e("$.description").alias("description"),
    )
