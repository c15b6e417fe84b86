"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source that is to give ``target`` words of ``source_size`` makes ``target / source_size`` copies of each document on average.
The whole part is sure; the fractional parts are rounded by pairs: mass, in words, moves between two documents at random,
without bias, until one of them is integral, and the other meets the next one. So the words taken stay equal to
the target up to the last document's share. A leaf of some ``leaf`` documents is rounded by one fold over an
array; leaves leave one fractional document each, and those meet in the next level of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import unique_and_repeated
from .scratch import keep

_WORDS = r"[^\x20\x09-\x0D]+"
#: A row: its id, size, text's hash, number among rows that share these, and probability.
_ITEM = "struct<doc_id:bigint,size:bigint,h:bigint,twin:bigint,p:double>"
_KEY = ["source", "doc_id", "size", "h"]
_STATE = f"struct<open:{_ITEM},up:array<{_ITEM}>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def _uniform(seed: int, *cols) -> Column:
    """A number in [0, 1) that depends on the row only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``.

    Sources by code point, null last, have the weights in turn and share ``share`` times all words. A target stops at
    ``most`` times its source's size and the excess is shared anew by weight until none is above: then every open source
    has the same target per weight, which is found by running sums over the sources in order of their limits.
    The table has a row for each source, so one task orders it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    every = Window.orderBy(F.col("limit") / F.col("w"), F.encode("source", "utf-8"))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("open_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(share) - F.col("full")) / F.col("open_w"))
    # sources are full as long as their limit is under the level that the ones after them would get
    rows = rows.withColumn("at", F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.encode("source", "utf-8").alias("s"), F.col("level").alias("level")))).over(all_rows).getField("level"))
    return rows.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("at") * F.col("w"), F.col("limit"))).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Rounds an array of fractional documents: those rounded up, and the one that stays fractional or null."""

    def meet(state: Column, b: Column) -> Column:
        a, up = state["open"], state["up"]
        none = F.lit(None).cast(_ITEM)

        def settled(x: Column, p: Column) -> tuple[Column, Column, Column]:
            return p > 1 - 1e-9, p < 1e-9, F.struct(*[x[c].alias(c) for c in ("doc_id", "size", "h", "twin")], p.alias("p"))

        rise = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # words that a may win from b
        fall = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        move = F.when(_uniform(seed, *[x[c] for x in (a, b) for c in ("doc_id", "size", "h", "twin")]) * (rise + fall) < fall, rise).otherwise(-fall)
        a_one, a_none, a_new = settled(a, a["p"] + move / a["size"])
        b_one, b_none, b_new = settled(b, b["p"] - move / b["size"])
        ups = F.concat(up, F.when(a_one, F.array(a_new)).otherwise(F.array().cast(f"array<{_ITEM}>")), F.when(b_one, F.array(b_new)).otherwise(F.array().cast(f"array<{_ITEM}>")))
        stays = F.when(~(a_one | a_none), a_new).when(~(b_one | b_none), b_new).otherwise(none)
        return F.when(a.isNull(), F.struct(b.alias("open"), up.alias("up"))).otherwise(F.struct(stays.alias("open"), ups.alias("up"))).cast(_STATE)

    start = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast(f"array<{_ITEM}>").alias("up")).cast(_STATE)
    return F.aggregate(items, start, meet)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, leaf: int = 64, seed: int = 11) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, source)`` for each row of ``docs``.

    A size is a text's number of words; a null text has none. A document is taken a whole number of times, at most
    ``ceil(most)`` times. A null source is a source of its own. Documents of size 0 give no words and are copied the sure
    number of times. Random choices depend on ids, sizes and texts only, so reruns agree; rows that repeat all of these are told apart by a
    number. An empty table gives no rows. Other columns are ignored.
    """
    groups = _rounded(docs, id_col, text_col, source_col, weights, share, most, leaf, seed)
    rows = groups.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("twin"))
    copies = (F.col("sure") + F.when(F.col("twin") <= F.col("ups"), 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def _rounded(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, leaf: int = 64, seed: int = 11) -> DataFrame:
    """Rows by source, id, size and text: ``m`` equal ones, each taken ``sure`` times and ``ups`` of them once more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("h"))
    sized = keep(rows.groupBy(*_KEY).agg(F.count("*").alias("m")), "mix_sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    targets = keep(source_targets(sources.drop("n"), weights, share, most).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix_targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sized = sized.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target", "n", rate.alias("rate"))
    sized = sized.withColumn("sure", F.floor(F.col("rate") + 1e-9)).withColumn("p", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
    most_n = targets.agg(F.max("n")).first()[0] or 0
    level = sized.where("p > 1e-9 and size > 0").select("n", "p", *_KEY, F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("twin"))
    ups, depth = [], 0
    while True:
        # a leaf for each `leaf` documents of a source; the last level has one
        leaves = F.greatest(F.lit(1), F.ceil(F.col("n") / float(leaf) ** (depth + 1)))
        spot = F.pmod(F.xxhash64(F.lit(seed + depth), "doc_id", "size", "h", "twin"), leaves)
        item = F.struct((-F.col("size")).alias("order"), _uniform(seed + 100 + depth, "doc_id", "h", "twin").alias("r"), F.struct("doc_id", "size", "h", "twin", "p").cast(_ITEM).alias("item"))
        folded = level.groupBy("source", "n", spot.alias("leaf")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("items"))
        folded = keep(folded.select("source", "n", _fold(F.col("items"), seed + 200 + depth).alias("f")).select("source", "n", "f.open", "f.up"), f"mix_level{depth}")
        ups.append(folded.select("source", F.explode("up").alias("u")).select("source", "u.doc_id", "u.size", "u.h"))
        level = folded.where("open is not null").select("source", "n", "open.*")
        if most_n <= leaf ** (depth + 1):
            break
        depth += 1
    last = level.where(_uniform(seed + 300, "doc_id", "h", "twin") < F.col("p")).select(*_KEY)
    for x in ups:
        last = last.unionByName(x)
    counts = last.groupBy(*[F.col(c).alias(f"_{c}") for c in _KEY]).agg(F.count("*").alias("ups"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KEY]
    return sized.join(counts, same[0] & same[1] & same[2] & same[3], "left").select(*_KEY, "source_size", "target", "m", "sure", F.coalesce("ups", F.lit(0)).alias("ups"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as it is taken.

    Rows of one id, source and text are one document to the mix: their copies together are copies of one of them.
    """
    copies = (F.col("m") * F.col("sure") + F.col("ups")).cast("long")
    taken = _rounded(docs, id_col, text_col, source_col, **mix).select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("h").alias("as"), F.col("size").alias("words"), F.col("m").alias("rows"), copies.alias("copies")).where("copies > 0")
    row = lambda c: F.col(f"row.{c}")
    same = row(id_col).cast("long").eqNullSafe(F.col("id")) & row(source_col).eqNullSafe(F.col("of")) & (F.xxhash64(row(text_col)) == F.col("as")) & (word_count(row(text_col)) == F.col("words"))
    rows = unique_and_repeated(docs, taken, same, [id_col, source_col, text_col])
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
