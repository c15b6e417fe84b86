"""Workflow state: events, status boards, joins with postings, caches and health of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The value of the last event of each key; a null value deletes the key."""
    return events.groupBy(key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("v")).select(key, f"v.{value}").where(F.col(value).isNotNull())


def first_applied(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(F.when(F.col("status") == "applied", F.col("ts"))).alias("applied_at")).where("applied_at is not null")


def last_events(events: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The last n events of each key with their rank, the latest first. The top rows are kept before the shuffle."""
    return events.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("rn") <= n)


def toggled(events: DataFrame, key: str) -> DataFrame:
    """Keys that an odd number of toggles has left switched on."""
    return events.groupBy(key).agg(F.count("*").alias("c")).where("c % 2 = 1").drop("c")


def health(log: DataFrame, key: str, run: str, failed: Column) -> DataFrame:
    """State of each source after its last run, with hysteresis: blocked over 0.8 failures, free again under 0.3, from 3 requests on.

    Counts run on over the runs; the state is the last decision that is not open.
    """
    counts = log.groupBy(key, run).agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    so_far = Window.partitionBy(key).orderBy(run)
    counts = counts.withColumns({"total": F.sum("n").over(so_far), "errors": F.sum("bad").over(so_far)})
    rate = F.col("errors") / F.col("total")
    counts = counts.withColumn("says", F.when((F.col("total") >= 3) & (rate > 0.8), True).when((F.col("total") >= 3) & (rate < 0.3), False))
    out = counts.groupBy(key).agg(F.max("total").alias("total"), F.max_by("errors", run).alias("errors"), F.max_by("says", F.when(F.col("says").isNotNull(), F.col(run))).alias("says"))
    return out.select(key, "total", "errors", F.coalesce("says", F.lit(False)).alias("blocked"))


def with_status(postings: DataFrame, board: DataFrame, key: str, default: str = "Not Applied") -> DataFrame:
    return postings.join(board.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit(default)))


def by_either(left: DataFrame, right: DataFrame, key: str, keys: list[str], order: str) -> DataFrame:
    """Left rows with the first right row, by ``order``, that has the key in any of ``keys``: an equi-join on the keys unpivoted."""
    names = [c for c in right.columns if c not in keys]
    long = right.select(F.explode(F.array_distinct(F.array(*keys))).alias(key), F.struct(*names).alias("r"), F.col(order).alias("_o")).where(F.col(key).isNotNull())
    return left.join(long.groupBy(key).agg(F.min_by("r", "_o").alias("r")), key, "left").select(left["*"], "r.*")


def fresh(cache: DataFrame, key: str, now: Column, ttl: str) -> DataFrame:
    """Cache rows younger than the time to live."""
    return cache.where(F.col("ts") > now - F.expr(ttl))


def merged_state(server: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """Both maps; the local value stands where both have one."""
    a, b = server.select(key, F.col(value).alias("_s")), local.select(key, F.col(value).alias("_l"))
    return a.join(b, key, "full").select(key, F.coalesce("_l", "_s").alias(value))


def upserted(events: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key; a blank one deletes."""
    return latest(events.withColumn(value, F.nullif(F.trim(value), F.lit(""))), key, value, *order)


def tracked(board: DataFrame, current: DataFrame, history: DataFrame, key: str, keys: list[str], order: str = "seq") -> DataFrame:
    """Board rows with the current posting that has their key in any of ``keys``, else with the history's, else alone; ``origin`` says which."""
    names = [c for c in current.columns if c not in keys]
    one = lambda df: by_either(board.select(key).distinct(), df.select(*keys, *names), key, keys, order).select(F.col(key), F.struct(*names).alias("r"))
    found = board.join(one(current).withColumnRenamed("r", "now"), key, "left").join(one(history).withColumnRenamed("r", "old"), key, "left")
    has_now, has_old = F.col(f"now.{order}").isNotNull(), F.col(f"old.{order}").isNotNull()
    cells = [F.when(has_now, F.col(f"now.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in names]
    return found.select(*board.columns, F.when(has_now, "current").when(has_old, "history").otherwise("none").alias("origin"), *cells)


def with_placeholders(tracked_rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Rows without a posting get a placeholder for its title, company and place."""
    none = F.col(order).isNull()
    fill = {"job_title": F.concat(F.lit("Tracked record ("), F.substring(key, 1, 12), F.lit(")")), "company": F.lit("History"), "location": F.lit(None).cast("string")}
    return tracked_rows.withColumns({c: F.when(none, v).otherwise(F.col(c)) for c, v in fill.items() if c in tracked_rows.columns})


def kept_history(old: DataFrame, fresh_rows: DataFrame, key: str) -> DataFrame:
    """Fresh rows, and old ones whose key is not among them."""
    return fresh_rows.unionByName(old.join(fresh_rows.select(key), key, "left_anti"), allowMissingColumns=True)


def without_blocked(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose source is not blocked."""
    return rows.join(blocked.where("blocked").select(key), key, "left_anti")


def agenda(postings: DataFrame, reminders: DataFrame, board: DataFrame, key: str) -> DataFrame:
    """Postings with a reminder and a status other than the last one; order by ``remind_at`` for the nearest first."""
    return postings.join(reminders, key).join(board, key).where("remind_at is not null and status is not null and status <> 'result'")


def countdown(at: Column, now: Column) -> dict[str, Column]:
    """Whether a time is past, else whole days, hours and minutes left, and a label of the two largest of them."""
    left = F.timestamp_diff("SECOND", now, at)
    past = left <= 0
    days, hours, minutes = F.floor(left / 86400), F.floor(left % 86400 / 3600), F.floor(left % 3600 / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    label = F.when(past, "past").when(days > 0, F.concat(text(days, " days "), text(hours, " hours"))).when(hours > 0, F.concat(text(hours, " hours "), text(minutes, " minutes"))).otherwise(text(minutes, " minutes"))
    return {"is_past": past, **{n: F.when(~past, v) for n, v in (("days", days), ("hours", hours), ("minutes", minutes))}, "label": label}


def stage_countdown(day: Column, today: Column, stage: int = 14) -> dict[str, Column]:
    """Days left of a stage that began on ``day``, and their band: over three, one to three, none."""
    left = F.lit(stage) - F.date_diff(today, day)
    return {"days_left": left, "band": F.when(left > 3, "later").when(left >= 1, "soon").otherwise("due")}


def status_counts(board: DataFrame, statuses: list[str]) -> DataFrame:
    """One row of counts of the known statuses and of all keys."""
    return board.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))
