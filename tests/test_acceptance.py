"""Acceptance over time against a fold of each key's times."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordrank.operators.acceptance import accepted, compose, enter, step_function

DAY = 24
BEGIN = dt.datetime(2026, 1, 1)


def folded(rows):
    """``rows`` are (key, hours, forced)."""
    out, times = [], {}
    for k, h, f in rows:
        if h is not None:
            times.setdefault(k, {}).setdefault(h, False)
            times[k][h] |= f
    for k, ts in times.items():
        last = None
        for h in sorted(ts):
            if last is None or h >= last + DAY or ts[h]:
                out.append((k, h))
                last = h
    return sorted(out, key=str)


times = st.lists(st.integers(0, 120), min_size=1, max_size=60, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(times, st.data())
def test_step_functions(ts, data):
    must = data.draw(st.lists(st.sampled_from(range(len(ts))), max_size=3))
    cut = data.draw(st.integers(1, len(ts)))
    t, f = np.array(ts), np.isin(np.arange(len(ts)), must)

    def walk(state, lo, hi):
        for x, m in zip(ts[lo:hi], f[lo:hi]):
            if x >= state + DAY or m:
                state = x
        return state

    whole = step_function(t[:cut], f[:cut], DAY)
    if cut < len(ts):
        whole = compose(whole, step_function(t[cut:], f[cut:], DAY), DAY)
    for state in range(ts[0] - 60, ts[0]):
        assert enter(*whole, np.array([state]), DAY)[0] == walk(state, 0, len(ts))


@pytest.mark.parametrize(("keys", "rows", "forced"), [(1, 3000, 0.0), (1, 3000, 0.003), (2, 2000, 0.0), (300, 2000, 0.05), (5, 1, 0.0)])
def test_hot_keys_over_many_ranges(spark, keys, rows, forced):
    rng = random.Random(rows + keys)
    data = [(rng.choice([None, *range(keys)]) if keys > 1 else 7, rng.randint(0, rows), rng.random() < forced) for _ in range(rows)] + [(1, None, True)]
    log = spark.createDataFrame([(k, None if h is None else BEGIN + dt.timedelta(hours=h), f) for k, h, f in data], "k long, ts timestamp_ntz, f boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = accepted(log, "k", forced=F.col("f")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.k, int((r.accepted_at - BEGIN).total_seconds() // 3600)) for r in got), key=str) == folded(data)


def test_no_rows(spark):
    log = spark.createDataFrame([], "k string, ts timestamp")
    assert accepted(log, "k").schema.simpleString() == "struct<k:string,accepted_at:timestamp>"
    assert accepted(log, "k").count() == 0
