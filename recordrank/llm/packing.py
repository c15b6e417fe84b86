"""Token ids of documents, packed into rows of equal length by best-fit decreasing.

Tokenising works on units, a run of ASCII white space and the word after it: the tokeniser's pattern never joins two units,
so a slice of texts is encoded by its distinct units. Packing keeps a segment tree over the capacities that are left and finds the
fullest row that still takes a piece. Rows are filled within groups of a bounded number of tokens, whose documents
share a task, so nothing is moved between tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _RANDOM, SPACE, mix, powers, slices

#: Fixed pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII may join units; such texts are encoded whole.
_WIDE = re.compile("[\x85\xa0  -     　]")
_KEEP_UNITS = 300_000
_SCHEMA = "row_id string, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<bigint>"


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, from the driver's disk or, if it is not there, through Spark."""
    try:
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
    except OSError:
        lines = bytes(spark.read.format("binaryFile").load(path).first().content).split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    separates = SPACE

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.bounds = [0]

    def many(self, texts: list[str]) -> Iterable[list[int]]:
        return map(self.encoding.encode_ordinary, texts)

    def _add(self, keys: list[int], units: list[str]) -> None:
        for k, ids in zip(keys, self.many(units)):
            end = self.bounds[-1] + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            self.flat[self.bounds[-1] : end] = ids
            self.known[k] = len(self.bounds) - 1
            self.bounds.append(end)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of the texts: the place of the first, all ids, and their bounds by document."""
        for part in slices(texts, self.separates):
            own = [t or "" for t in texts.slice(part.at, part.n_docs).to_pylist()]
            if any(_WIDE.search(t) for t in own):
                ids = list(self.many(own))
                yield part.at, np.concatenate([np.array(x, np.int32) for x in ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                continue
            raw = np.frombuffer("".join(own).encode(), np.uint8)
            # a unit ends with its word; white space after the last word of a text is a unit too
            last = np.zeros(len(raw) + 1, bool)
            last[part.end] = True
            last[part.off[1:]] = True
            ends = np.flatnonzero(last)
            ends = ends[ends > 0]
            starts = np.concatenate([[0], ends[:-1]])
            if not len(ends):
                yield part.at, np.zeros(0, np.int32), np.zeros(part.n_docs + 1, np.int64)
                continue
            key = unit_hashes(raw, starts, ends)
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            if len(self.known) > _KEEP_UNITS:
                self.known, self.bounds = {}, [0]
            names = distinct.tolist()
            new = [i for i, k in enumerate(names) if k not in self.known]
            if new:
                data = raw.tobytes()
                self._add([names[i] for i in new], [data[starts[j] : ends[j]].decode() for j in first[new]])
            spot = np.array([self.known[k] for k in names])[inverse]
            bounds = np.array(self.bounds)
            begin, size = bounds[spot], bounds[spot + 1] - bounds[spot]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
            yield part.at, ids, total[np.searchsorted(ends, part.off, "right")]


def unit_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    place = np.arange(len(raw)) - np.repeat(starts, size)
    return mix(np.add.reduceat(_RANDOM[raw] * powers(int(size.max()))[place], starts) + size.astype(np.uint64))


class Capacities:
    """A segment tree over capacities 0 to ``top``: how many rows have each capacity left."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row of the least capacity that is no less than ``need``, and that capacity."""
        count, i = self.count, self.leaves + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.rows[capacity].pop(), capacity


def best_fit(sizes: list[int], top: int) -> list[list[int]]:
    """The pieces of each row, by best fit over decreasing sizes; sizes are 1 to ``top``."""
    tree, rows = Capacities(top), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i]) if sizes[i] < top else None
        if found is None:
            rows.append([i])
            left = top - sizes[i]
            at = len(rows) - 1
        else:
            at, capacity = found
            rows[at].append(i)
            left = capacity - sizes[i]
        if left:
            tree.put(left, at)
    return rows


def _packed(ranks, top: int, group_tokens: int):
    def pack(docs: list, ids: list[np.ndarray], name: str) -> pa.RecordBatch | None:
        pieces = [(k, a, min(a + top, len(x))) for k, x in enumerate(ids) for a in range(0, len(x), top)]
        out: list[list] = [[] for _ in range(8)]
        for n, own in enumerate(best_fit([b - a for _, a, b in pieces], top)):
            cuts = np.concatenate([[0], np.cumsum([pieces[i][2] - pieces[i][1] for i in own])]).tolist()
            row = np.concatenate([ids[k][a:b] for k, a, b in (pieces[i] for i in own)]).astype("<i4")
            for column, x in zip(out, (f"{name}-{n}", cuts[-1], len(own), row.tobytes(), cuts, cuts[:-1], [docs[pieces[i][0]] for i in own], [pieces[i][1] for i in own])):
                column.append(x)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, docs, ids, n, group = Encoder(ranks.value), [], [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at, flat, bounds in encoder.encode(batch.column(1)):
                for i in range(len(bounds) - 1):
                    if bounds[i + 1] > bounds[i]:
                        docs.append(own[at + i])
                        ids.append(flat[bounds[i] : bounds[i + 1]])
                n += len(flat)
                if n >= group_tokens:
                    yield pack(docs, ids, f"{task}-{group}")
                    docs, ids, n, group = [], [], 0, group + 1
        if docs:
            yield pack(docs, ids, f"{task}-{group}")

    return run


def pack_documents(docs: DataFrame, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", length: int = 2048, group_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most ``length`` token ids.

    ``ids`` are little-endian 32-bit ids; ``cu_seqlens`` has 0 and the ends of the segments, ``position_resets`` the places where positions start
    again from 0, ``doc_ids`` each segment's document and ``doc_offsets`` the place of its first token in that document. A document
    longer than a row is cut into whole rows and a rest; joined by offset, its segments are its ids again. Null and empty texts have
    no tokens and so no segment; a null id stays null. Repeated rows are packed each. An empty table gives no rows. Other columns are
    ignored. ``row_id`` names the task, group and row, and is unique within one run. Best fit is made over groups of some ``group_tokens`` tokens; partitions of less text than
    that are put together first, without a shuffle, so rows are as full in a table of many small files.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # a token of text has four bytes or so
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.coalesce(max(1, size // (4 * group_tokens))).mapInArrow(_packed(ranks, length, group_tokens), _SCHEMA)


def fill(packed: DataFrame, length: int = 2048) -> DataFrame:
    """One row: how many rows there are, how few all tokens could lie in, and the share of places that are taken."""
    full = F.coalesce(F.sum("n_tokens"), F.lit(0))
    return packed.agg(F.count("*").alias("rows"), F.ceil(full / length).alias("least_rows"), (full / F.nullif(F.count("*") * length, F.lit(0))).alias("fill"))


def write_matrices(packed: DataFrame, path: str, length: int = 2048, pad: int = 50256) -> None:
    """Parquet with a row for each packed row: its padded ids and positions, ``length`` little-endian 32-bit numbers each, and segment lengths."""

    def padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places = [], []
            for x, cuts in zip(b.column("ids").to_pylist(), b.column("cu_seqlens").to_pylist()):
                row, place = np.full(length, pad, "<i4"), np.zeros(length, "<i4")
                row[: cuts[-1]] = np.frombuffer(x, "<i4")
                place[: cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
                ids.append(row.tobytes())
                places.append(place.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(ids, pa.binary()), pa.array(places, pa.binary()), b.column("cu_seqlens")], names=["row_id", "ids", "positions", "cu_seqlens"])

    packed.select("row_id", "ids", "cu_seqlens").mapInArrow(padded, "row_id string, ids binary, positions binary, cu_seqlens array<int>").write.parquet(path)
