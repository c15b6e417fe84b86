"""Groups of spelling variants: words one edit apart, found with a forward and a backward minimal acyclic automaton.

A near word shares either the whole first half of a word or the whole second half. So a word is looked up twice: its first half is walked exactly
in an automaton of words read forwards and the rest is completed with one error, then its second half in an automaton of words read backwards.
Automata are built per bucket of halves, so no task holds the vocabulary: a word lies in the bucket of its own half, and in that of the half which a word
one letter shorter or longer would look for. Words of an automaton are numbered in their order (a minimal perfect hash), and the number that a walk ends at finds the word's count.
The backward walk leaves out what the forward one finds, so no pair comes twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep

#: Letters of words: the basic alphabet and U+00C0 to U+00FF.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Entries of one bucket of halves on average; memory of a task follows it.
BUCKET = 60_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """A minimal acyclic automaton of sorted, distinct words; a word's number is its place among them."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[dict[str, int]] = [{}]
        ends, last = [False], ""

        def settle(depth: int) -> int:
            """States of the current path below ``depth`` become states of the automaton, equal ones the same."""
            state = -1
            while len(path) > depth:
                node, end = path.pop(), ends.pop()
                key = (end, *node.items())
                state = known.get(key, -1)
                if state < 0:
                    state = known[key] = len(size)
                    before, out = int(end), {}
                    for letter, to in node.items():
                        out[letter] = (to, before)
                        before += size[to]
                    self.edges.append(out)
                    self.final.append(end)
                    size.append(before)
                if path:
                    path[-1][last[len(path) - 1]] = state
            return state

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            settle(same + 1)
            path.extend({} for _ in range(len(word) - same))
            ends.extend([False] * (len(word) - same))
            ends[-1] = True
            last = word
        self.root = settle(0)

    def walk(self, word: str, at: int, state: int, number: int) -> int:
        """The number of the word that the rest of ``word`` from ``at`` leads to, -1 if there is none."""
        edges = self.edges
        for letter in word[at:]:
            step = edges[state].get(letter)
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> Iterator[int]:
        """Numbers, each once, of the words that share the first ``exact`` letters and differ by one edit after them."""
        state, number, walk = self.root, 0, self.walk
        for i in range(len(word) + 1):
            letter = word[i] if i < len(word) else None
            if i >= exact:
                # within a run of one letter, dropping any and adding one more anywhere are the same edit: the first and the last place stand for all
                if letter is not None and (i == exact or word[i - 1] != letter) and (hit := walk(word, i + 1, state, number)) >= 0:
                    yield hit
                for other, (to, before) in self.edges[state].items():
                    if other != letter:
                        if (hit := walk(word, i, to, number + before)) >= 0:
                            yield hit
                        if letter is not None and (hit := walk(word, i + 1, to, number + before)) >= 0:
                            yield hit
            step = self.edges[state].get(letter)
            if step is None:
                return
            state, number = step[0], number + step[1]


def _best(back: bool) -> Callable[[pa.Table], pa.Table]:
    """For each word looked up in a bucket: how many near words it has there, and the most frequent of them."""

    def run(part: pa.Table) -> pa.Table:
        rows = {w: (n, asks) for w, n, asks in zip(*(part[c].to_pylist() for c in ("word", "n", "asks")))}
        turned = sorted((w[::-1], n) for w, (n, _) in rows.items()) if back else sorted((w, n) for w, (n, _) in rows.items())
        counts = [n for _, n in turned]
        words = [w for w, _ in turned]
        automaton = Automaton(words)
        out = {"word": [], "n_near": [], "best_n": [], "best": []}
        for word in words:
            asked = word[::-1] if back else word
            if not rows[asked][1]:
                continue
            half = len(word) // 2
            hits = automaton.near(word, len(word) - half if back else half)
            if back:
                # what shares the first half is the forward automaton's
                hits = (k for k in hits if words[k][::-1][:half] != asked[:half])
            top, total = None, 0
            for k in hits:
                total += 1
                mine = (-counts[k], words[k][::-1] if back else words[k])
                if top is None or mine < top:
                    top = mine
            if top:
                for c, v in zip(out, (asked, total, -top[0], top[1])):
                    out[c].append(v)
        return pa.table(out, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))

    return run


def observed_words(docs: DataFrame, least: int = 6, spoilt: int = 199, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Occurrences of words of at least ``least`` letters: ``word, n``.

    Runs of letters are taken whole and A-Z lower-cased. Where ``spoilt`` divides the unsigned crc32 of ``<id>:<run>``, the run loses the letter at
    crc32 modulo its length, so that a corpus without misspellings has some to find. A null text has no words; a null id counts as an empty one.
    """
    # a run too short can only get shorter, so it is passed over by the pattern
    text = F.translate(text_column, _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("_run"))
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run")))
    size = F.length("_run")
    at = (F.col("_h") % size).cast("int")
    shorter = F.concat(F.expr("substring(_run, 1, cast(_h % length(_run) as int))"), F.col("_run").substr(at + 2, size))
    words = runs.select(F.when(F.col("_h") % spoilt == 0, shorter).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _halves(words: DataFrame, back: bool, buckets: int) -> DataFrame:
    """Words by bucket of a half; ``asks`` in the bucket of the half that the word itself is looked up with."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    if back:
        # the second half is the longer one: L - L // 2 letters; of a word one shorter or longer, one less (L odd) or one more (L even)
        own = size - half
        other = F.when(size % 2 == 1, own - 1).otherwise(own + 1)
        cut: Callable[[Column], Column] = lambda k: F.col("word").substr(size - k + 1, k)
    else:
        own = half
        other = F.when(size % 2 == 1, own + 1).otherwise(own - 1)
        cut = lambda k: F.col("word").substr(F.lit(1), k)
    place = lambda k: F.pmod(F.xxhash64(cut(k)), F.lit(buckets)).cast("int")
    both = F.array(F.struct(place(own).alias("bucket"), F.lit(True).alias("asks")), F.struct(place(other).alias("bucket"), F.lit(False).alias("asks")))
    # two halves of one word may fall in one bucket; the word is then there once, and asks
    return words.select("word", "n", F.explode(F.when(place(own) == place(other), F.slice(both, 1, 1)).otherwise(both)).alias("_p")).select("word", "n", "_p.*")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct words with their occurrences ``n``; words have two letters or more.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word of the largest n (of equals the
    first in code-point order) if that is at least ``ratio`` times its own, else null; its root is where forms lead from it, itself without one.
    No words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms must grow, or following them need not end")
    words = keep(words.select("word", "n"), "words")
    total, most = words.agg(F.count("*"), F.max("n")).first()
    buckets = max(1, math.ceil(2 * total / BUCKET))
    schema = "word string, n_near bigint, best_n bigint, best string"
    ahead, behind = (_halves(words, back, buckets).groupBy("bucket").applyInArrow(_best(back), schema) for back in (False, True))
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("form")))
    near = ahead.unionByName(behind).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    found = words.join(near, "word", "left").withColumn("ok", -F.col("b.k") >= ratio * F.col("n"))
    found = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("b.form")).alias("form"), F.when(F.col("ok"), -F.col("b.k")).alias("form_n")), "forms")
    drop(words)
    # counts grow by the ratio with each step, which bounds the steps; each round doubles how far a word sees
    steps = math.ceil(math.log(most or 1, ratio)) + 1
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    held: DataFrame | None = None
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = keep(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        drop(held)
        links = held = further
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
