"""Tokenizer alignment against spans compared one by one."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recordrank.llm import alignment
from recordrank.llm.alignment import Bitset, ByteLevel, Pieces, align_tokenizers, read_file

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def spans(ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(pieces[i])))
        at += len(pieces[i])
    return out


def expected(rows):
    a, b = ByteLevel(read_file(None, A)), Pieces(read_file(None, B))
    docs, holders = [], Counter()
    for i, text in rows:
        whole = (" " + text).encode() if text else b""
        x, y = spans(a.model.encode(" " + (text or ""), add_special_tokens=False).ids, a.pieces), spans(b.model.encode(text or ""), b.pieces)
        if not whole or any(b"".join(t.pieces[i] for i, *_ in s) != whole for t, s in ((a, x), (b, y))):
            docs.append((i, [], [], Counter(), ""))
            continue
        links = Counter((i, j) for i, s, e in x for j, u, v in y if s < v and u < e)
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        part = lambda side, lo, hi: ",".join(str(i) for i, _, e in side if lo < e <= hi)
        groups = ";".join(f"{part(x, lo, hi)}|{part(y, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        docs.append((i, x, y, links, groups))
        holders.update(set(links))
    best = Counter()
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return sorted(
        ((i, len(x), len(y), g.count(";") + 1 if g else 0, sum(k.values()), sum(n for p, n in k.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in k.items()), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, k, g in docs), key=str
    )


TEXTS = ["", None, "a", "The quick brown fox.", "Zürich café naïve — 東京 🙂\n\n  tabs\t", "<|endoftext|> and </s> <unk>", "under▁score", "  leading", "trailing   ", "The quick brown fox.", "x" * 3000, "supercalifragilistic " * 700, "\x00nul\r\n", " ", "a▁", "die Straßenbahn"]


@pytest.mark.parametrize("size", [4 << 20, 40])
def test_against_spans(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "CHUNK", size)
    rows = [*enumerate(TEXTS), (None, "The quick"), (None, "The quick"), (3, "The quick brown fox.")]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n_a int, chunk string").repartition(3)
    got = align_tokenizers(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in align_tokenizers(docs, A, B).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_bitset():
    rng = np.random.default_rng(5)
    places = np.flatnonzero(rng.random(1000) < 0.3)
    s = Bitset.of(places, 1000)
    assert (s.select() == places).all()
    every = np.arange(1000)
    assert (s.rank(every) == np.searchsorted(places, every)).all()


def test_units_are_encoded_once():
    """Both tokenizers encode a text by its distinct units, as they encode it whole."""
    for side in (ByteLevel(read_file(None, A)), Pieces(read_file(None, B))):
        texts = [t or "" for t in TEXTS] + ["the quick  brown fox\n of  units " * 300]
        seen, whole = [], side.whole
        side.whole = lambda t, seen=seen, whole=whole: (seen.extend(t), whole(t))[1]
        ids, each = side.laid_out(texts * 3)
        expected = [x if t else [] for t, x in zip(texts, whole([" " + t for t in texts]))]
        assert ids.tolist() == [i for x in expected for i in x] * 3 and each.tolist() == [len(x) for x in expected] * 3
        assert sum(map(len, seen)) < sum(map(len, texts)) / 2
