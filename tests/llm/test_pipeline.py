"""The pipeline's stages, each against plain Python over its own input, on the smallest tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as C
from recordrank.llm.packing import PATTERN, load_ranks

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, now = {}, docs
    for name, stage in C.STAGES:
        before = now.collect()
        rows = stage(spark, now, SF).collect()
        out[name] = (before, rows)
        if name != C.STAGES[-1][0]:
            now = spark.createDataFrame(rows, docs.schema)
            assert rows and now.columns == docs.columns
    return out


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    assert Counter(after) <= Counter(before) and after
    # what it learns needs more labels than the smallest table has
    large = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{large}/documents.parquet")
    left = {r.doc_id for r in C.toxicity(spark, docs, large).select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    toxic, clean = ({i for i, v in labels.items() if v == k} for k in (1, 0))
    assert len(toxic - left) >= 0.9 * len(toxic) and len(clean - left) <= 0.05 * len(clean)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    sets, holders = {}, defaultdict(list)
    for r in before:
        words = re.findall("[^\x20\x09-\x0d]+", lower(r.text))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        for g in sets[r.doc_id]:
            holders[g].append(r.doc_id)
    shared = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == sorted({find(i) for i in sets}) and Counter(after) <= Counter(before)


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = split(r.text)
        k = min(10, len(words))
        windows[k] |= {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
    clean = []
    for r in before:
        words = split(r.text)
        if not any(tuple(words[i : i + k]) in have for k, have in windows.items() for i in range(len(words) - k + 1)):
            clean.append(r)
    assert Counter(after) == Counter(clean) and len(clean) < len(before)


def test_mixing(stages):
    before, after = stages["mixing"]
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    have = Counter()
    for r in before:
        have[r.source] += size(r)
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, set(order), 1.5 * sum(have.values())
    while left:
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * have[s]}
        for s in full or left:
            target[s] = 2 * have[s] if full else level * weight[s]
        rest -= sum(2 * have[s] for s in full)
        left = left - full if full else set()
    copies, rows = Counter(after), Counter(before)
    assert set(copies) <= set(rows) and all(n <= 2 * rows[r] for r, n in copies.items())
    taken, largest = Counter(), Counter()
    for r, n in copies.items():
        taken[r.source] += n * size(r)
    for r in before:
        largest[r.source] = max(largest[r.source], size(r))
        rate = target[r.source] / have[r.source]
        if size(r):
            assert int(rate) * rows[r] <= copies[r] <= -int(-rate - 0.999999999) * rows[r]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)


def test_packing(spark, stages):
    before, after = stages["packing"]
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(spark, "/opt/tokenizers/byte_bpe_50k.tiktoken"), special_tokens={})
    want = Counter((r.doc_id, tuple(coder.encode_ordinary(r.text))) for r in before if r.text)
    pieces = defaultdict(list)
    for r in after:
        ids = np.frombuffer(bytes(r.ids), "<i4").tolist()
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 2048 and r.cu_seqlens[0] == 0 and r.position_resets == r.cu_seqlens[:-1]
        for d, at, i, j in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[d].append((at, ids[i:j]))
    # copies of a document have equal pieces: by offset, each as often as there are copies
    got = Counter()
    for d, own in pieces.items():
        by = defaultdict(list)
        for at, ids in own:
            by[at].append(ids)
        n = len(by[0])
        assert all(len(v) == n and all(x == v[0] for x in v) for v in by.values())
        got[d, tuple(x for at in sorted(by) for x in by[at][0])] += n
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    assert {d for r in C.run(spark, SF).select("doc_ids").collect() for d in r.doc_ids} == {d for r in stages["packing"][1] for d in r.doc_ids}
