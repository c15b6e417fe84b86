"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named users; the
spans of the assistant's words are the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

_TURN = "struct<speaker:string,body:string>"


def _head(turn: Column, me: Column) -> Column:
    mine = turn["speaker"] == me
    return F.when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), turn["speaker"], F.lit("|>\n")))


def escaped_name(name: Column) -> Column:
    """A speaker's name without characters that end a marker, as percent escapes; a null one is like no other."""
    for c in "%|>\r\n":
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(name, F.lit("%unknown"))


def escaped_text(text: Column) -> Column:
    """A text in which no marker can begin: ``<|`` has a backslash between, one more where there are some already. Taking one away gives the text again."""
    return F.coalesce(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), F.lit(""))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_chars: int = 1 << 20) -> DataFrame:
    """``(conv_id, speaker, part, begin, n_turns, rendered, mask)``: a row for each participant of a dialogue, and for each part of a long one.

    Turns are in order of number, then speaker, then text; a null number comes first. A dialogue is cut between turns: those that begin within the same ``part_chars`` characters of it, all speakers
    being named, are a part, and every participant of the dialogue gets all parts. So a value is as long as that and one turn, however long the dialogue, and parts one after the other are the
    whole: ``begin`` is where a part starts in what the participant is given. ``mask`` has the character ranges, within the part, of the assistant's words and of the end mark after them. A null speaker is
    named ``%unknown``, a null text is empty. A row without a dialogue is one of a single turn. Repeated rows are said again. An empty table gives no rows. Other columns are ignored. Names and texts are escaped one to
    one, so no two participants become one and no text can open or end a turn.
    """
    every = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), escaped_name(F.col(speaker_col).cast("string")).alias("speaker"), escaped_text(F.col(text_col)).alias("body"))
    rows = every.where("conv_id is not null")
    size = F.length("speaker") + F.length("body") + len("<|user name=|>\n<|end|>\n")
    sizes = rows.groupBy("conv_id").agg(F.sum(size).alias("c"))
    long = keep(sizes.where(F.col("c") > part_chars).select("conv_id"), "dialogues_long")
    # places in a long dialogue: equal rows are counted, the rest is in ranges whose sizes are added up, so no task holds a dialogue
    order = ["turn", "speaker", "body"]
    counted = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", *order).agg(F.count("*").alias("times")).withColumn("size", size.cast("long"))
    placed = keep(counted.repartitionByRange("conv_id", *order).withColumn("task", F.spark_partition_id()), "dialogue_rows")
    held = placed.groupBy("conv_id", "task").agg(F.sum(F.col("times") * F.col("size")).alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("conv_id", "task", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    local = F.sum(F.col("times") * F.col("size")).over(Window.partitionBy("conv_id", "task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("times") * F.col("size")
    spread = placed.withColumn("local", local).join(offsets, ["conv_id", "task"]).withColumn("at", F.col("ahead") + F.col("local"))
    spread = spread.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / part_chars), F.floor((F.col("at") + (F.col("times") - 1) * F.col("size")) / part_chars))))
    # of equal rows, those that begin within the part
    until = lambda p: F.greatest(F.lit(0), F.least(F.col("times"), F.ceil((p * part_chars - F.col("at")) / F.col("size"))))
    spread = spread.withColumn("times", (until(F.col("part") + 1) - until(F.col("part"))).cast("int")).where("times > 0")
    spread = keep(spread.select("conv_id", *order, "part", "times", "size"), "dialogue_parts")
    # a part begins after the earlier ones with all speakers named, less what the participant's own turns have no name for
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = spread.groupBy("conv_id", "part").agg(F.sum(F.col("times") * F.col("size")).alias("n"))
    whole = whole.withColumn("ahead", F.coalesce(F.sum("n").over(before.partitionBy("conv_id")), F.lit(0))).drop("n")
    saved = F.col("times") * (F.length("speaker") + len("<|user name=|>\n") - len("<|assistant|>\n"))
    own = whole.join(spread.select("conv_id", "speaker").distinct(), "conv_id").join(spread.groupBy("conv_id", "part", "speaker").agg(F.sum(saved).alias("n")), ["conv_id", "part", "speaker"], "left")
    begins = own.select("conv_id", F.col("speaker").alias("me"), "part", (F.col("ahead") - F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before.partitionBy("conv_id", "speaker")), F.lit(0))).alias("begin"))
    short = rows.join(long, "conv_id", "left_anti").select("conv_id", *order, F.lit(0).cast("long").alias("part"), F.lit(1).alias("times"))
    cut = short.unionByName(spread.drop("size"))
    people = rows.select("conv_id", F.col("speaker").alias("me")).distinct()
    said = cut.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "body", "times"))).alias("said"))
    said = said.withColumn("said", F.flatten(F.transform("said", lambda t: F.array_repeat(F.struct(t["speaker"].alias("speaker"), t["body"].alias("body")), t["times"]))))
    alone = every.where("conv_id is null").select("conv_id", F.lit(0).cast("long").alias("part"), F.array(F.struct("speaker", "body")).alias("said"), F.col("speaker").alias("me"))
    each = said.join(people, "conv_id").join(begins, ["conv_id", "me", "part"], "left").unionByName(alone, allowMissingColumns=True)
    me = F.col("me")
    pieces = F.transform("said", lambda t: F.concat(_head(t, me), t["body"], F.lit("<|end|>\n")))
    each = each.select("conv_id", me.alias("speaker"), "part", F.coalesce("begin", F.lit(0)).cast("long").alias("begin"), F.size("said").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("rendered"), "said")
    me = F.col("speaker")
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    ranges = "array<struct<start:int,end:int>>"

    def walk(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t, me))
        end = begin + F.length(t["body"]) + F.length(F.lit("<|end|>"))
        mine = F.when(t["speaker"] == me, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(ranges))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], mine).alias("spans")).cast(kind)

    def folded(turns: Column, at: Column) -> Column:
        return F.aggregate(turns, F.struct(at.cast("int").alias("at"), F.array().cast(ranges).alias("spans")).cast(kind), walk)

    # blocks of turns are folded one by one and joined at the end, so that no long array is copied at each turn
    block = 64
    starts = F.sequence(F.lit(1), F.greatest(F.size("said"), F.lit(1)), F.lit(block))
    blocks = each.withColumn("blocks", F.transform(starts, lambda i: F.slice("said", i, block)))
    local = blocks.withColumn("local", F.transform("blocks", lambda b: folded(b, F.lit(0))))
    sums = F.aggregate("local", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
    moved = F.zip_with(F.col("local"), F.slice("offsets", F.lit(1), F.size("local")), lambda x, o: F.transform(x["spans"], lambda r: F.struct((r["start"] + o).alias("start"), (r["end"] + o).alias("end"))))
    return local.withColumn("offsets", sums).select("conv_id", "speaker", "part", "begin", "n_turns", "rendered", F.flatten(moved).alias("mask"))
