"""Exact deduplication by distributed MSD radix partitioning.

The key of a text is its length in bytes, then its bytes. Level by level, groups are split by the next digit, a run of bytes
that grows from level to level, until a group is a single row or its texts have ended. Equality is decided by the
bytes alone. Every split counts in two steps, first by group and salt, so that a group with any share of the
rows is spread over as many tasks as the shuffle has in the count as well as in the join that hands the counts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep, shards
from .words import slices

_FULL = "doc_id bigint, row bigint, salt int, size bigint, digit binary, sha binary, rest binary"
_LIGHT = "doc_id bigint, row bigint, salt int, size bigint, digit binary"


def _read(digit: int, salts: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for part in slices(batch.column(1)):
                data, off = part.data.tobytes(), part.off.tolist()
                texts = [data[a:b] for a, b in zip(off, off[1:])]
                own = ids.slice(part.at, part.n_docs)
                salt = (own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(salts)
                out = [own, pa.array(np.arange(row, row + part.n_docs)), pa.array(salt.astype(np.int32)), pa.array(np.diff(part.off)), pa.array([t[:digit] for t in texts], pa.binary())]
                if full:
                    out += [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([t[digit:] for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in (_FULL if full else _LIGHT).split(", ")])
                row += part.n_docs

    return run


def _split(rows: DataFrame, light: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the count, the largest id and the name of its group by ``key``; null counts stand for single rows.

    A group is named by the least number of its rows; no two groups have a row in common, so no two have one name.
    """
    part = light.groupBy(*key, "salt").agg(F.count("*").alias("c"), F.max("doc_id").alias("hi"), F.min("row").alias("group"))
    whole = part.groupBy(*key).agg(F.sum("c").alias("c"), F.max("hi").alias("hi"), F.min("group").alias("group"), F.collect_list("salt").alias("salts"))
    whole = whole.where("c > 1").withColumn("salt", F.explode("salts")).drop("salts")
    return rows.join(whole, [*key, "salt"], "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digit: int = 64, growth: int = 4) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; a null
    id is less than any other, and of rows of one text with null ids only, none is marked as kept unless it is alone.
    Rows that repeat an id and a text are one document, listed as often as they come. An empty table gives no rows.
    Other columns are ignored. The digest is an output and decides nothing.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    salts = shards(docs.sparkSession, 16)
    light = docs.mapInArrow(_read(digit, salts, False), _LIGHT)
    rows = _split(docs.mapInArrow(_read(digit, salts, True), _FULL), light, ["size", "digit"])
    done, taken, level = [], digit, 0
    while True:
        live = F.col("c").isNotNull() & (F.col("size") > taken)
        rows = rows.select("doc_id", "row", "salt", "size", "sha", "c", "hi", "group", F.when(live, F.col("rest")).alias("rest"))
        rows = keep(rows, f"radix{level}")
        done.append(rows.where("rest is null").select("doc_id", "sha", "c", "hi"))
        rows = rows.where("rest is not null")
        if rows.isEmpty():
            break
        width = digit * growth ** (level + 1)
        rows = rows.select("doc_id", "row", "salt", "size", "sha", F.col("group").alias("parent"), F.expr(f"substring(rest, 1, {width})").alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        key = ["parent", "digit"]
        rows = _split(rows, rows.select(*key, "row", "salt", "doc_id"), key)
        taken, level = taken + width, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    keep_id = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("hi"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("c", F.lit(1)).alias("group_size"), F.coalesce(F.col("doc_id") == keep_id, F.col("c").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
