"""Spelling variants against all pairs of a small vocabulary, and the automaton against a sorted list."""

import re
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from recordrank.llm import spelling
from recordrank.llm.spelling import Automaton, observed_words, spelling_variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts: dict[str, int]) -> set:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        top = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def words_of(rows) -> Counter:
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                out[word] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40))
def test_automaton(words):
    order = sorted(words)
    a = Automaton(order)
    assert [a.walk(w, 0, a.root, 0) for w in order] == list(range(len(order)))
    assert a.walk("abz", 0, a.root, 0) == -1
    for w in order:
        for exact in range(len(w) + 1):
            hits = list(a.near(w, exact))
            assert sorted(hits) == [k for k, x in enumerate(order) if x[:exact] == w[:exact] and one_edit(w[exact:], x[exact:])]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET", 40)
    base = ["wonder", "wonderful", "aaaaaa", "aaaaaaa", "élèvesà", "straßen", "bananas"]
    rows, i = [], 0
    for k, w in enumerate(base):
        for j in range(len(w)):
            for v in {w[:j] + w[j + 1 :], w[:j] + "x" + w[j:], w[:j] + "é" + w[j + 1 :]}:
                rows.append((i, " ".join([v] * (1 + (i * 7) % 11))))
                i += 1
        rows += [(i + m, f"{w.upper() if w.isascii() else w}, {w}; {w}×{w}" * (5 ** (k % 3))) for m in range(9)]
        i += 9
    rows += [(None, "Wonderful wonderful 12 a-b"), (5, None), (6, ""), (7, "short w0nder"), (7, "wonder " * 20000), (7, "wonder " * 20000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    counts = words_of(rows)
    seen = observed_words(docs)
    assert {(r.word, r.n) for r in seen.collect()} == set(counts.items())
    some = {w: n for w, n in counts.items() if n >= 5}
    got = [tuple(r) for r in spelling_variants(seen.where("n >= 5")).collect()]
    assert len(got) == len(some) and set(got) == expected(some)


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125, "zzzzzz": 5, "zzzzzy": 25, "zzzzzzz": 25, "yyyyyyyy": 6}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling_variants(words).collect()}
    assert got == expected(counts)
    assert {r[2] for r in got if r[0] == "aaaaaa"} == {"bbbbbb"}
    assert spelling_variants(words.where("n < 0")).count() == 0
    assert observed_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
