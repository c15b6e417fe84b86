"""Alignment of two tokenizers over the same texts, on packed bitsets of token ends.

Texts of a chunk stand one after another in one space of bytes. Each tokenizer's token ends are a bitset over it, 64 bytes of text to a word. The AND of both
holds the places where both cut, and bounds the groups; the OR holds the end of each overlap of two tokens, so its bits are the links. Running sums of the words'
population counts give the rank of a place, which is the number of the token that covers it, in each tokenizer; select turns bits back into places.

Documents' counts of linked id pairs are summed per chunk before they are shuffled. Each chunk gets the sums of its own pairs back, so no pair travels once
per document and no table of pairs is held whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import batched, chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .packing import Encoder
from .scratch import drop, keep

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 2 << 20


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, from the driver's disk or, if it is not there, through Spark."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).first().content)


class Units(Encoder):
    """A tokenizer with ``pieces``, its entries' bytes, and ``whole``, which encodes texts; units are encoded side by side, in texts of ``ROW`` units."""

    ROW = 256

    def many(self, texts: list[str]) -> list[list[int]]:
        return self.whole(texts)

    def _add(self, keys: list[int], units: list[str]) -> None:
        if not hasattr(self, "lengths"):
            self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        # white space alone would be read as one with the unit behind it
        rows = [g for alone, run in groupby(units, str.isspace) for g in batched(run, 1 if alone else self.ROW)]
        ids, sizes = [], []
        for row, found in zip(rows, self.whole(["".join(g) for g in rows])):
            ends, wanted = np.cumsum(self.lengths[found]), np.cumsum([len(u.encode()) for u in row])
            at = np.searchsorted(ends, wanted)
            if len(row) == 1:
                at = np.array([len(found) - 1])
            elif len(ends) != at[-1] + 1 or (ends[at] != wanted).any():  # not spelt by its tokens
                each = self.whole(list(row))
                found, at = [i for x in each for i in x], np.cumsum([len(x) for x in each]) - 1
            ids.append(found)
            sizes.append(np.diff(at, prepend=-1))
        ids, ends = np.concatenate([np.array(x, np.int32) for x in ids]), np.cumsum(np.concatenate(sizes)) + self.bounds[-1]
        self.flat = np.concatenate([self.flat[: self.bounds[-1]], ids, np.zeros(max(0, len(self.flat) - self.bounds[-1] - len(ids)), np.int32)])
        self.known.update(zip(keys, range(len(self.bounds) - 1, len(self.bounds) - 1 + len(keys))))
        self.bounds += ends.tolist()

    def laid_out(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a space and the text, for texts that are not empty, and how many each text has."""
        found = list(self.encode(pa.array([" " + t if t else "" for t in texts], pa.large_string())))
        return np.concatenate([ids for _, ids, _ in found]).astype(np.int64), np.concatenate([np.diff(bounds) for *_, bounds in found])


class ByteLevel(Units):
    """A byte-level tokenizer from its JSON file; ``pieces`` are its entries' bytes. Texts are encoded by their distinct units."""

    def __init__(self, source: bytes):
        self.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(source.decode())
        self.model.encode_special_tokens = True
        # visible bytes of Latin-1 stand for themselves, the others for the code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        names = self.model.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.pieces[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and the text, for each text that is not empty."""
        out = []
        for _, flat, bounds in self.encode(pa.array([" " + t if t else "" for t in texts], pa.large_string())):
            ids = flat.tolist()
            out += [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        return out


class Pieces(Units):
    """A sentence-piece tokenizer from its model file, which puts a space before a text itself.

    Merges make entries only, and where no entry has a space but at its beginning, none reaches over a space: a text is encoded by its distinct units, a run of spaces and
    what follows up to the next one. A model with other entries, or one that rewrites texts, encodes them whole.
    """

    separates = np.arange(256) == 32

    def __init__(self, source: bytes):
        self.clear()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=source)
        one = re.compile("<0x([0-9A-F]{2})>")
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        odd = "A\xa0\ufb01 \u2460  B\t\n e\u0301 "
        self.space = self.model.piece_to_id("▁")
        self.apart = "▁" in names and all("▁" not in n.lstrip("▁") for n in names) and self.model.normalize(odd).replace("▁", " ") == " " + odd
        self.pieces = [bytes([int(m[1], 16)]) if (m := one.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space that the model would put before them."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        # before no text at all the model puts no space
        return [[self.space] if t == " " else ids for t, ids in zip(texts, found)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def laid_out(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.apart:
            return super().laid_out(texts)
        ids = self.ids(texts)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)


class Bitset:
    """A set of places below ``size``, packed 64 to a word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bitset:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many members lie below each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self) -> np.ndarray:
        """All members in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the last bytes of tokens: tokens of either side before each group's end, and the tokens of each link."""
    a, b = Bitset.of(ends_a, size), Bitset.of(ends_b, size)
    cuts = Bitset(a.words & b.words).select()
    links = Bitset(a.words | b.words).select()
    return a.rank(cuts) + 1, b.rank(cuts) + 1, a.rank(links), b.rank(links)


def _chunk(texts: list[str], a: ByteLevel, b: Pieces, names: np.ndarray, base: int) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Columns of a chunk's documents, its distinct id pairs, and how many of its documents hold each."""
    n = len(texts)
    whole = [(" " + t).encode() if t else b"" for t in texts]
    fits, sides = np.array([bool(w) for w in whole]), []
    for side in (a, b):
        flat, each = side.laid_out(texts)
        spelt = b"".join(map(side.pieces.__getitem__, flat.tolist()))
        size = np.array([len(p) for p in side.pieces], np.int64)[flat]
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(each)])]
        fits &= [spelt[i:j] == w for i, j, w in zip(at[:-1], at[1:], whole)]
        sides.append((flat, each))
    (flat_a, n_a), (flat_b, n_b) = ((flat[np.repeat(fits, each)], np.where(fits, each, 0)) for flat, each in sides)
    del sides
    size = sum(len(w) for ok, w in zip(fits, whole) if ok)
    none = np.zeros(0, np.int64)
    if not size:
        zero = [0] * n
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups_sha256": [""] * n, "places": [[]] * n, "times": [[]] * n}, none, none
    long_a, long_b = (np.array([len(p) for p in side.pieces], np.int64) for side in (a, b))
    to_a, to_b, link_a, link_b = align(np.cumsum(long_a[flat_a]) - 1, np.cumsum(long_b[flat_b]) - 1, size)
    doc = np.repeat(np.arange(n), n_a)
    n_groups, n_links = np.bincount(doc[to_a - 1], minlength=n), np.bincount(doc[link_a], minlength=n)

    # tokens in writing order: a group's A tokens, then its B tokens, each with the sign that follows it
    each_a, each_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    order = np.empty(len(flat_a) + len(flat_b), np.int64)
    at_a = np.arange(len(flat_a)) + np.repeat(to_b - each_b, each_a)
    at_b = np.arange(len(flat_b)) + np.repeat(to_a, each_b)
    order[at_a], order[at_b] = flat_a, flat_b + base
    order[at_a[to_a - 1]] += len(names) // 2
    order[at_b[to_b - 1]] += len(names) // 2
    bounds = np.concatenate([[0], np.cumsum(n_a + n_b)])
    written = ["".join(names[order[i:j]].tolist())[:-1] for i, j in zip(bounds[:-1], bounds[1:])]
    hashes = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
    del order, at_a, at_b, written

    # distinct pairs of each document with the times it links them
    width = len(b.pieces)
    kinds = len(a.pieces) * width
    held, times = np.unique(doc[link_a] * kinds + flat_a[link_a] * width + flat_b[link_b], return_counts=True)
    pairs, place = np.unique(held % kinds, return_inverse=True)
    own = np.concatenate([[0], np.cumsum(np.bincount(held // kinds, minlength=n))])
    column = lambda v: pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(v, pa.int32()))
    out = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes, "places": column(place), "times": column(times)}
    return out, pairs, np.bincount(place, minlength=len(pairs))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, int]:
    """A row for each document with its groups and links, and one for each chunk with its pairs; and the number of B ids, by which pairs are made."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast((read_file(spark, path_a), read_file(spark, path_b)))
    width = Pieces(source.value[1]).model.get_piece_size()
    kind = docs.schema[id_column].dataType
    fields = [StructField("chunk", LongType()), StructField("id", kind), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")], StructField("groups_sha256", StringType())]
    lists = [StructField(c, ArrayType(t)) for c, t in (("places", IntegerType()), ("times", IntegerType()), ("pairs", LongType()), ("holders", LongType()))]
    schema = StructType(fields + lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = names = form = None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if a is None:
                a, b = ByteLevel(source.value[0]), Pieces(source.value[1])
                n_a, n_b = len(a.pieces), len(b.pieces)
                names = np.array([f"{i}," for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i}|" for i in range(n_a)] + [f"{i};" for i in range(n_b)], object)
                ids = batch.schema.field(0).type
                form = pa.schema([("chunk", pa.int64()), ("id", ids), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, left = i, CHUNK
                while j < len(texts) and (j == i or len(texts[j]) <= left):
                    left -= len(texts[j])
                    j += 1
                found, pairs, holders = _chunk(texts[i:j], a, b, names, len(a.pieces))
                nothing = pa.nulls(j - i, pa.list_(pa.int64()))
                columns = {"chunk": pa.array(np.full(j - i, number)), "id": batch.column(0).slice(i, j - i), **found, "pairs": nothing, "holders": nothing}
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, form.field(c).type) for c, v in columns.items()], schema=form)
                if len(pairs):
                    row = {"chunk": [number], "pairs": [pairs], "holders": [holders]}
                    yield pa.RecordBatch.from_arrays([pa.array(row.get(f.name, [None]), f.type) for f in form], schema=form)
                number += 1
                i = j

    return docs.select(id_column, text_column).mapInArrow(run, schema), width


def align_tokenizers(docs: DataFrame, path_a: str = "/opt/tokenizers/byte_bpe_50k.json", path_b: str = "/opt/tokenizers/piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each document, repeated and null ids included.

    ``path_a`` is a byte-level tokenizer's JSON file, ``path_b`` a sentence-piece model. A null or empty text, or one whose tokens do not spell it, has no tokens:
    its numbers are 0 and its groups are an empty string. A pair's count is how many documents hold it linked.
    """
    table, width = aligned(docs, path_a, path_b, id_column, text_column)
    table = keep(table, "aligned")
    rows = table.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = keep(rows.groupBy("pair").agg(F.sum("holders").alias("count")), "pairs")
    # one row for each A id: as many as the vocabulary has entries
    best = counts.groupBy(F.expr(f"pair div {width}").cast("int").alias("a")).agg(F.max("count").alias("best"))
    counts = counts.join(best, F.expr(f"pair div {width}") == F.col("a")).select("pair", "count", (F.col("count") == F.col("best")).alias("top"))
    sums = rows.select("chunk", "place", "pair").join(counts, "pair").select("chunk", "place", "count", "top")
    kind = docs.schema[id_column].dataType
    schema = StructType([StructField(id_column, kind), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], StructField("groups_sha256", StringType())])

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over the links of a chunk's documents, by the counts of its pairs."""
        place = right["place"].to_numpy()
        count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], top[place] = right["count"].to_numpy(), right["top"].to_numpy().astype(np.int64)
        lists = left["places"].combine_chunks()
        at, times = lists.flatten().to_numpy(), left["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(left)), lists.value_lengths().to_numpy())
        total = lambda v: np.bincount(doc, times * v[at], len(left)) if len(doc) else np.zeros(len(left))
        # bincount sums in doubles, which are whole up to 2 ** 53: links of a document times documents
        n_best, count_sum = (pa.array(total(v).astype(np.int64)) for v in (top, count))
        return pa.table([left["id"], *[left[c] for c in ("n_a", "n_b", "n_groups", "n_links")], n_best, count_sum, left["groups_sha256"]], names=[f.name for f in schema])

    left = table.where("pairs is null").select(F.col("chunk").alias("_c"), *[c for c in table.columns if c not in ("chunk", "pairs", "holders")])
    out = keep(left.groupBy("_c").cogroup(sums.groupBy("chunk")).applyInArrow(weigh, schema), "alignment")
    drop(table)
    return out
