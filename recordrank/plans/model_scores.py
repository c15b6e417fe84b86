"""Scores of a language model for the first candidates: cached answers first, the model in batches for the rest, and what it said for the cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .runs import rank_order, unfenced
from .tables import written

#: A model: texts in, answers out, in their order. It may raise; the batch is then asked again.
Model = Callable[[list[dict]], list[str]]
ASKED = ["seq", "job_title", "company", "job_description_summary", "requirements"]
_ANSWER = "semantic_score double, reasoning string, estimated_salary_min string, estimated_salary_max string"


def answers(rows: DataFrame, model: Model, batch: int = 8, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """``(seq, answer)`` for ``rows``: each Arrow batch is asked ``batch`` rows at a time; rows of a call that fails ``attempts`` times have a null answer."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            said: list[str | None] = []
            records = part.to_pylist()
            for i in range(0, len(records), batch):
                some, told = records[i : i + batch], None
                for turn in range(attempts):
                    try:
                        told = model(some)
                        break
                    except Exception:  # noqa: BLE001  a model fails in its own ways; what is left unanswered keeps its rule score
                        time.sleep(pause * 2**turn)
                if told is not None and len(told) != len(some):
                    told = None
                said += told if told is not None else [None] * len(some)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], names=["seq", "answer"])

    return rows.select(*ASKED).mapInArrow(ask, f"seq {dict(rows.dtypes)['seq']}, answer string")


def model_scores(df: DataFrame, cache: DataFrame, model: Model, now: Column, ttl: str = "interval 7 days", least: int = 60, most: int = 20, **asking) -> tuple[DataFrame, DataFrame]:
    """``df`` with the model's part in its scores, and the new entries of the cache.

    The first ``most`` rows of ``least`` points or more are looked up in ``cache(job_url, semantic_score, reasoning, salary, ts)``, where the youngest entry within ``ttl`` counts; the others are asked, once. A score is
    then 0.4 of the rule's and 0.6 of the model's, the reasoning goes before the explanation, which says whether it was cached, and a salary is told where the answer has a bound that is not 0. An answer
    without a score has the rule's; one that is no JSON, or none, changes nothing and is not cached. A row without an address is asked each time. Ranks are to be made anew.
    """
    chosen = df.where(F.col("match_score") >= least).orderBy(*rank_order()).limit(most)
    chosen = written(chosen.select(*ASKED, "job_url", "match_score"), "candidates")
    young = cache.where(F.col("ts") > now - F.expr(ttl)).groupBy("job_url").agg(F.max_by(F.struct("semantic_score", "reasoning", "salary"), "ts").alias("m"))
    hits = chosen.join(young, "job_url").select("seq", "m.*", F.lit(True).alias("cached"))
    misses = chosen.join(young, "job_url", "left_anti")
    told = F.from_json(unfenced(F.col("answer")), _ANSWER)
    # written, so that the model is asked once, however often its answers are read
    some = F.concat_ws("", "a.semantic_score", "a.reasoning", "a.estimated_salary_min", "a.estimated_salary_max") != ""
    said = written(answers(misses, model, **asking).withColumn("a", told).where(some).select("seq", "a.*"), "answers")
    there = lambda c: F.coalesce(F.col(c).try_cast("double") != 0, F.col(c).isNotNull() & (F.col(c) != ""))
    bound = lambda c: F.coalesce(c, F.lit("None"))
    salary = F.when(there("estimated_salary_min") | there("estimated_salary_max"), F.concat(F.lit("Rp"), bound("estimated_salary_min"), F.lit(" - Rp"), bound("estimated_salary_max"))).otherwise("")
    fresh = said.join(chosen.select("seq", "job_url", F.col("match_score").cast("double").alias("base")), "seq").select("seq", "job_url", F.coalesce("semantic_score", "base").alias("semantic_score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), salary.alias("salary"))
    scores = hits.unionByName(fresh.drop("job_url").withColumn("cached", F.lit(False))).withColumnRenamed("salary", "_salary")
    out = df.join(scores, "seq", "left")
    why = F.array_join("why_match", "; ") if dict(df.dtypes)["why_match"].startswith("array") else F.coalesce("why_match", F.lit(""))
    mark = F.when(F.col("cached"), "[AI·cached] ").otherwise("[AI] ")
    has = F.coalesce(F.col("reasoning") != "", F.lit(False))
    score = S.blend(F.col("match_score"), F.col("semantic_score"))
    out = out.withColumns({"match_score": score, "why_match": F.when(has, F.concat(mark, "reasoning", F.lit(" | "), why)).otherwise(why), "salary_ai_extracted": F.nullif("_salary", F.lit(""))})
    out = out.withColumns({"match_category": S.category(F.col("match_score")), "recommendation": S.recommendation(F.col("match_score"), F.col("data_confidence"))})
    return out.drop("semantic_score", "reasoning", "_salary", "cached"), fresh.where("job_url is not null").select("job_url", "semantic_score", "reasoning", "salary", now.alias("ts"))
