"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all items.

Words are numbered, and a text becomes a string with one code point for each word, so the automaton reads a text once,
word by word, and its matches are word places that map back to the original text. The automaton is
broadcast as its windows, of at most ``block_bytes``; a larger benchmark is cut into blocks of that size, and the text passes one automaton after the
other in the same task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lower-cased bytes of words; all other ASCII separates them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SCHEMA = "doc_id bigint, text string, n_words bigint, hits binary, items array<string>"


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_list(text)
                own = {b" ".join(words[i : i + size]).decode("utf-8", "surrogateescape") for i in range(max(1, len(words) - size + 1))} if words else ()
                items += [item] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], names=["item", "window"])

    return run


def _char(i: int) -> str:
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


def build(windows: list[tuple[str, list[str]]]):
    """The automaton of ``(window, items)`` and the code points of its words."""
    import ahocorasick

    codes: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton()
    for window, items in windows:
        words = window.encode().split()
        automaton.add_word("".join(codes.setdefault(w, _char(len(codes))) for w in words), (len(words), items))
    if windows:
        automaton.make_automaton()
    return automaton, codes


def scan(words: list[bytes], automaton, codes: dict[bytes, str], hits: bytearray, items: set[str]) -> None:
    """Marks the words inside any occurrence, and adds the items whose windows occur."""
    get = codes.get
    for end, (n, own) in automaton.iter("".join([get(w, "\0") for w in words])):
        hits[end + 1 - n : end + 1] = b"\1" * n
        items.update(own)


def spans(text: str, hits: bytes) -> list[dict]:
    """Character ranges in the original text of the runs of marked words."""
    out: list[dict] = []
    last = False
    for m, hit in zip(_WORD.finditer(text), hits):
        if hit and last:
            out[-1]["end"] = m.end()
        elif hit:
            out.append({"start": m.start(), "end": m.end()})
        last = bool(hit)
    return out


_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"
_NAMES = ["doc_id", "text", "n_words", "hits", "items"]
_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string())]
_RESULT_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
_RESULT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def _scanned(windows, first: bool, last: bool):
    """One block's pass over the texts. The first block starts from bare rows, and the last one tells the results, so that
    with a single block each text goes to Python once and only the results come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, codes = build(windows.value)
        for batch in batches:
            out: list[list] = [[] for _ in (_RESULT_NAMES if last else _NAMES)[1:]]
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                words = word_list(text)
                mark = bytearray((None if first else batch.column(3)[i].as_py()) or bytes(len(words)))
                own = set(() if first else batch.column(4)[i].as_py() or ())
                if codes and words:
                    scan(words, automaton, codes, mark, own)
                items = sorted(own)
                hits = bytes(mark) if own else None
                row = (len(words), sum(mark), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(own), items, spans(text, hits) if hits else []) if last else (text, len(words), hits, items)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = _RESULT_KINDS if last else _KINDS
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=_RESULT_NAMES if last else _NAMES)

    return run


def window_blocks(benchmark: DataFrame, spark, item_col: str, item_text: str, window: int, block_bytes: int) -> list:
    """Broadcasts of ``(window, items)``, each of about ``block_bytes`` at most."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    windows = items.mapInArrow(_windows(window), "item string, window string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    size = F.octet_length("window") + F.aggregate("items", F.lit(64).cast("long"), lambda a, x: a + F.octet_length(x) + 8)
    total = windows.agg(F.sum(size)).first()[0] or 0
    n_blocks = 1 + total // block_bytes
    blocks = []
    for b in range(n_blocks):
        own = windows if n_blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b)
        blocks.append(spark.sparkContext.broadcast([(r.window, list(r["items"])) for r in own.toLocalIterator()]))
    return blocks


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """For each row of ``docs``: words, words inside occurrences of the benchmark's windows, items, and character spans.

    A window is ``window`` consecutive words of an item; a shorter item that has words is one window. Null texts have no
    words; items with a null id count as the item ``null``. Repeated items are one item, repeated documents are told each.
    Empty tables give no rows, or no hits. Other columns are ignored. Windows shared by many items are held once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = window_blocks(benchmark, docs.sparkSession, item_col, item_text, window, block_bytes)
    for i, windows in enumerate(blocks):
        first, last = i == 0, i == len(blocks) - 1
        rows = rows.mapInArrow(_scanned(windows, first, last), _RESULT if last else _SCHEMA)
    return rows


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    place = docs.columns.index(text_col)

    def clean(windows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, codes = build(windows.value)
            get = codes.get
            for batch in batches:
                texts = ("".join([get(w, "\0") for w in word_list(t.as_py())]) for t in batch.column(place)) if codes else ()
                yield batch.filter(pa.array([next(iter(automaton.iter(t)), None) is None for t in texts], pa.bool_())) if codes else batch

        return run

    for windows in window_blocks(benchmark, docs.sparkSession, item_col, item_text, window, block_bytes):
        docs = docs.mapInArrow(clean(windows), docs.schema)
    return docs
