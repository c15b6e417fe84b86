"""Deduplication with explicit arrival order ``seq``: results do not depend on partitions.

First and best rows are chosen by min_by and max_by, which combine before the shuffle, so a key with any share of
the rows does not gather them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import listed, title_key


def record_key() -> Column:
    """Address of the record, else that of its form, else company, title and place; in lower case."""
    url = lambda c: F.nullif(F.lower(F.trim(listed(F.col(c)))), F.lit(""))
    low = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    return F.coalesce(url("job_url"), url("apply_url"), F.concat_ws("|", low("company"), low("job_title"), low("location")))


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def first_rows(df: DataFrame, key: Column) -> DataFrame:
    """The first row by ``seq`` of each key; a null key is a key."""
    return df.groupBy(key.alias("_key")).agg(F.min_by(_whole(df), "seq").alias("r")).select("r.*")


def merged_rows(df: DataFrame, key: Column) -> DataFrame:
    """The first row of each key with the longest description, the best score, and the group's key where it has more rows."""
    size = F.struct(F.length(F.coalesce("job_description_summary", F.lit(""))), -F.col("seq"))
    out = df.groupBy(key.alias("_key")).agg(F.min_by(_whole(df), "seq").alias("r"), F.max_by("job_description_summary", size).alias("d"), F.max("match_score").alias("s"), F.count("*").alias("c"))
    more = F.col("c") > 1
    kept = [F.col(f"r.{c}") for c in df.columns if c not in ("job_description_summary", "match_score")]
    return out.select(*kept, F.col("d").alias("job_description_summary"), F.col("s").alias("match_score"), F.when(more, "merged_duplicate").otherwise("single").alias("origin"), F.when(more, F.col("_key")).alias("duplicate_group"))


def fuzzy_rows(df: DataFrame) -> DataFrame:
    """First by address; then of each title key of 8 letters or more the row of the highest confidence, at the place of the first."""
    url = F.nullif(F.lower(F.trim(listed(F.col("job_url")))), F.lit(""))
    once = first_rows(df.where(url.isNotNull()), url).unionByName(df.where(url.isNull()))
    keyed = once.withColumn("_t", title_key(F.col("job_title")))
    short = F.length("_t") < 8
    best = keyed.where(~short).groupBy("_t").agg(F.max_by(_whole(df), F.struct(F.coalesce("data_confidence", F.lit(0)), -F.col("seq"))).alias("r"), F.min("seq").alias("place")).select("r.*", "place")
    return keyed.where(F.coalesce(short, F.lit(True))).drop("_t").withColumn("place", F.col("seq")).unionByName(best)
