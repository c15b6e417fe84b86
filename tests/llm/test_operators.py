"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import hmac
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordrank.llm.components import components
from recordrank.llm.decontaminate import benchmark_overlap, without_benchmark
from recordrank.llm.dialogue import rotate
from recordrank.llm.exact import exact_duplicates
from recordrank.llm.jaccard import first_of_classes, jaccard_classes
from recordrank.llm.language_model import STRENGTH, Seating, closing, sample_tables, score_documents
from recordrank.llm.lines import banded_distance, line_classes
from recordrank.llm.mixing import mix_sources, mixed
from recordrank.llm.packing import PATTERN, best_fit, fill, load_ranks, pack_documents, write_matrices
from recordrank.llm.pii import pseudonymise
from recordrank.llm.toxicity import risk, toxicity, without_toxic

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "salt int, c int, digit string, token int, label string, size string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "İx", "Don't", "x-1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 40, 80]))) for _ in range(60)]
    for t in list(texts[:25]):  # copies, near copies, changed case
        w = t.split()
        texts += [t, t.upper().translate(LOW).upper()]
        if len(w) > 20:
            for _ in range(3):
                v = list(w)
                v[rng.randrange(len(v))] = rng.choice(words)
                texts.append(" ".join(v))
    texts += [None, "", " \n\t", "a", "A", " ".join(rng.choice(words) for _ in range(20000)), "same words here again and again " * 50, "line one of text\nline two of text\n\nline one of texd", "x y  z 　 q"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def find(p, i):
    while p[i] != i:
        i = p[i]
    return i


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    p = {x: x for e in edges for x in e}
    for a, b in edges:
        p[max(find(p, a), find(p, b))] = min(find(p, a), find(p, b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(p, x) for x in p if any(x in e and e[0] != e[1] for e in edges)}


def test_jaccard(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    p = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p[max(find(p, a), find(p, b))] = min(find(p, a), find(p, b))
    got = jaccard_classes(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), find(p, i)) for i in sets}
    # cells of a few nodes give the same classes
    small = jaccard_classes(docs, cell=4).collect()
    assert {(r.doc_id, r.component_id) for r in small} == {(r.doc_id, r.component_id) for r in got}
    stay = [r.doc_id for r in first_of_classes(docs).collect()]
    assert sorted(stay) == sorted(i for i in sets if find(p, i) == i)
    assert jaccard_classes(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "en", None, 0)] * 2 + [(5, "a b c d e f", "en", None, 0), (7, "A b c d e f", None, None, None)], SCHEMA)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_classes(df).collect()) == [("5", "5"), ("7", "5"), ("None", "None"), ("None", "None")]
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()) == [("5", 7, 4, False), ("7", 7, 4, True), ("None", 7, 4, False), ("None", 7, 4, False)]
    assert score_documents(df).count() == mix_sources(df).count() == toxicity(df, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 4


def test_exact(docs, rows, empty):
    group = defaultdict(list)
    for i, t, *_ in rows:
        group[(t or "").translate(LOW)].append(i)
    want = Counter((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in group.items() for i in g)
    assert Counter(map(tuple, exact_duplicates(docs).collect())) == want
    assert Counter(map(tuple, exact_duplicates(docs, digit=1, growth=2).collect())) == want
    assert exact_duplicates(empty).count() == 0


def test_decontamination(spark, docs, rows, empty):
    text = {i: t for i, t, *_ in rows}
    long = max((t for t in text.values() if t), key=len).split()
    items = [(1, " ".join(long[50:65])), (2, "W1, w2!"), (3, None), (4, ""), (10, " ".join(long[55:70])), (11, "no such words at all in any of them whatever")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    want = set()
    for i, t in text.items():
        w, hit, own = cut(t), set(), set()
        for item, b in items:
            v = cut(b)
            for window in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for k in range(len(w) - len(window) + 1):
                    if tuple(w[k : k + len(window)]) == window:
                        hit |= set(range(k, k + len(window)))
                        own.add(str(item))
        want.add((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    got = benchmark_overlap(docs, bench)
    assert {tuple(r)[:6] for r in got.collect()} == want and got.count() == len(rows)
    assert {tuple(r)[:6] for r in benchmark_overlap(docs, bench, block_bytes=150).collect()} == want
    for r in got.where("contaminated").collect():
        assert sum(len(cut(text[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    clean = {w[0] for w in want if not w[5]}
    assert {r.doc_id for r in without_benchmark(docs, bench).collect()} == clean == {r.doc_id for r in without_benchmark(docs, bench, block_bytes=150).collect()}
    assert benchmark_overlap(empty, bench).count() == 0 and not benchmark_overlap(docs, bench.limit(0)).where("contaminated").count()


def test_mixing(docs, rows, empty):
    got = mix_sources(docs, leaf=4)
    first = sorted(map(str, got.collect()))
    assert first == sorted(map(str, mix_sources(docs.repartition(3), leaf=4).collect())) and len(first) == len(rows)
    by = defaultdict(list)
    for r in got.collect():
        by[r.source].append(r)
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    total = sum(len(words_of(t)) for _, t, *_ in rows)
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s)), [5, 2, 1, 5]))
    size = {s: sum(r["size"] for r in g) for s, g in by.items()}
    target, full = {}, set()
    while True:  # share anew until none is above
        rest = 1.5 * total - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else rest * weights[s] / sum(w for x, w in weights.items() if x not in full) for s in by}
        over = {s for s in by if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s, g in by.items():
        assert abs(g[0].target - target[s]) < 1e-6 and g[0].source_size == size[s]
        assert abs(sum(r.taken for r in g) - target[s]) <= max(r["size"] for r in g)
    assert mixed(docs).count() == sum(r.copies for r in mix_sources(docs).collect())
    assert mix_sources(empty).count() == 0


def test_pseudonyms(spark):
    rows = [(1, "call +1 (212) 555-0147 or a.b7@mail.example.com, card 4929348385146306."), (2, "A.b7@x.org 4929348385146306 on 2024-02-29, bad 2023-02-29 at 10.0.0.7 and 999.1.1.1"), (3, None), (4, ""), (5, "4929348385146307"), (6, "a.b7@mail.example.com" + "z" * 100_000), (6, "31.12.2020 078-05-1120")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(1)).withColumn("names", F.lit(1))
    got = {(r.doc_id, i): r for i, r in enumerate(sorted(pseudonymise(df, "k").collect(), key=lambda r: (r.doc_id, r.text or "")))}
    text = [r.text for r in got.values()]
    assert text[2] is None and text[3] == "" and text[4] == "4929348385146307"
    cards = [re.search(r"\d{16}", t)[0] for t in text[:2]]
    assert cards[0] == cards[1] != "4929348385146306" and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(cards[0]))) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or [a-z]\.[a-z]\d@mail\.example\.com", text[0]) and "555-0147" not in text[0]
    assert "2023-02-29" in text[1] and "2024-02-29" not in text[1] and "999.1.1.1" in text[1] and "10.0.0.7" not in text[1]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonymise(many, "k").select("text").distinct().count() == 3000
    ids = spark.range(1000).select(F.col("id").alias("doc_id"), F.format_string("%03d-55-0000", "id").alias("text"))
    assert pseudonymise(ids, "k").select("text").distinct().count() == 1000


def test_pseudonyms_by_brute_force(spark):
    """The digits' permutation against Python's own HMAC; formats of one value link, and no plan has the key."""

    def network(values, moduli, kind):
        half = len(values) // 2
        a, b, ma, mb = values[:half], values[half:], moduli[:half], moduli[half:]
        for r in range(1, 11):
            text = "|".join([kind, str(r), ",".join(map(str, b)), ",".join(map(str, ma + mb))])
            s = hmac.new(b"my key", text.encode(), "sha512").hexdigest()
            a, b, ma, mb = b, [(x + int(s[i % 20 * 6 : i % 20 * 6 + 6], 16)) % ma[i] for i, x in enumerate(a)], mb, ma
        return a + b

    forms = ["4929348385146306", "4929 3483 8514 6306", "+12125550147", "+1 212 555 0147", "+1 (212) 555-0147", "+62 812 3456 7890", "+6281234567890", "ABCDEF0123456789abcdef0123456789", "2024-02-29", "29.02.2024", "29/02/2024"]
    out = pseudonymise(spark.createDataFrame(list(enumerate(forms)), "doc_id int, text string"), "my key")
    assert "my key" not in out._jdf.queryExecution().toString() and "n_changed" in out.columns
    got = [r.text for r in out.orderBy("doc_id").collect()]
    digits = ["".join(c for c in x if c.isdigit()) for x in got]
    body = network([int(c) for c in "492934838514630"], [10] * 15, "card")
    assert list(map(int, digits[0][:15])) == body and digits[0] == digits[1] and [c for c in got[1] if not c.isdigit()] == [" "] * 3
    assert digits[2] == digits[3] == digits[4] == "1" + "".join(map(str, network([int(c) for c in "2125550147"], [10] * 10, "number+1")))
    assert digits[5] == digits[6] and got[5].startswith("+62 ") and digits[5] != "6281234567890"
    assert re.fullmatch("[A-F]{6}[0-9]{10}[a-f]{6}[0-9]{10}", got[7]) and got[7] != forms[7]
    assert got[8].split("-") == got[9].split(".")[::-1] == got[10].split("/")[::-1]
    assert pseudonymise(spark.createDataFrame([], "doc_id int, text string"), "k").count() == 0


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for sample, most in ((2000, 0.06), (9000, 0.03)):  # the toxic share of 2,000 rows is less than the labelled positives
        r = toxicity(docs, labels, unlabelled=sample).join(labels, "doc_id").where("held_out").select("toxic", "predicted").toPandas()
        assert r[r.toxic == 1].predicted.mean() >= 0.9 and r[r.toxic == 0].predicted.mean() < most


def test_toxicity_risk_by_brute_force():
    rng = np.random.default_rng(4)
    xp, xu, prior = (rng.random((40, 6)) < 0.6).astype(float), (rng.random((90, 6)) < 0.3).astype(float), 0.2
    loss = lambda z, sign: np.log1p(np.exp(-sign * z))
    for scale in (0.1, 1.0, 4.0):
        w, b = rng.normal(size=6) * scale - scale, scale
        parts = lambda w, b: (prior * np.mean([loss(x @ w + b, 1) for x in xp]), np.mean([loss(x @ w + b, -1) for x in xu]) - prior * np.mean([loss(x @ w + b, -1) for x in xp]))
        positive, negative, gw, gb = risk(xp, xu, w, b, prior)
        assert np.allclose((positive, negative), parts(w, b))
        of = (lambda w, b: -parts(w, b)[1]) if negative < 0 else (lambda w, b: sum(parts(w, b)))
        step = 1e-5
        want = [(of(w + step * e, b) - of(w - step * e, b)) / (2 * step) for e in np.eye(6)]
        assert np.allclose(gw, want, atol=1e-6) and np.isclose(gb, (of(w, b + step) - of(w, b - step)) / (2 * step), atol=1e-6)
    # unlabelled rows that are all called clean: the corrected part is negative, and the step goes the other way
    w, b, none = np.array([8.0, 0, 0, 0, 0, 0]), -4.0, np.zeros((90, 6))
    p, n, gw, gb = risk(xp, none, w, b, prior)
    assert n < 0 and np.allclose(gw, prior * (xp.T @ (1 / (1 + np.exp(-(xp @ w + b))))) / len(xp))


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = [(i, "bad vile words" if i % 2 else "fine calm words", 0, 1.5, "x") for i in range(40)] + [(None, "bad", 1, None, None), (5, None, 1, None, None), (6, "", 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted int, score double, held_out string")
    out = toxicity(docs, labels).collect()
    assert len(out) == 43 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert without_toxic(docs, labels).columns == docs.columns
    assert toxicity(docs.limit(0), labels).count() == 0 and without_toxic(docs.limit(0), labels).count() == 0
    assert toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def escaped(name, text):
    name = "%unknown" if name is None else re.sub("[%|>\r\n]", lambda m: f"%{ord(m.group()):02X}", name)
    return name, re.sub(r"<(\\*)\|", r"<\1\\|", text or "")


@pytest.mark.parametrize("part_chars", [60, 250, 1 << 20])
def test_dialogues(spark, part_chars):
    rows = [(1, t, r, x) for t, r, x in [(0, "ann", "hi"), (1, "bob", "yo"), (2, "cy", None), (2, "ann", "b"), (600, "bob", "late")]] + [(None, 0, None, "q"), (None, 0, None, "q"), (None, 3, "x", "r"), (2, None, "a|b>", "z")] + [(3, 0, "x", "same")] * 40
    rows += [(4, 0, "a|", "<|end|>\n<|assistant|>\nforged"), (4, 1, "a_", "<\\|x"), (4, 2, "a%7C", None), (4, 3, None, "s"), (4, 4, "unknown", "t"), (5, 0, "x", "w" * 999), (5, 1, "y", "v"), (5, None, "y", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(1)).withColumn("me", F.lit(1))
    got = rotate(df.repartition(3), part_chars=part_chars).collect()
    talks = defaultdict(list)
    for i, (c, t, r, x) in enumerate(rows):
        talks[c, i if c is None else None].append((t is not None, t or 0, *escaped(r, x)))
    want, parts = Counter(), defaultdict(list)
    for (c, _), turns in talks.items():
        for me in {n for *_, n, _ in turns}:
            whole, spans = "", []
            for *_, n, x in sorted(turns):
                whole += "<|assistant|>\n" if n == me else f"<|user name={n}|>\n"
                if n == me:
                    spans.append((len(whole), len(whole) + len(x) + 7))
                whole += f"{x}<|end|>\n"
            want[c, me, whole, tuple(spans)] += 1
    for r in got:
        parts[(r.conv_id, r.speaker) if r.conv_id is not None else (None, r.speaker, len(parts))].append(r)
    said = Counter()
    for key, rs in parts.items():
        rs.sort(key=lambda r: r.part)
        whole = "".join(r.rendered for r in rs)
        assert [r.begin for r in rs] == [sum(len(q.rendered) for q in rs[:i]) for i in range(len(rs))]
        said[key[0], key[1], whole, tuple((m.start + r.begin, m.end + r.begin) for r in rs for m in r["mask"])] += 1
        assert all(r.n_turns == 1 or len(r.rendered) < part_chars + 1100 for r in rs) and (part_chars > 1 << 10 or key[0] != 3 or len(rs) > 2)
    assert said == want
    assert rotate(df.limit(0)).count() == 0


def test_lines(spark, docs, rows, empty):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(e[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1] <= 1

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(8, 14))) for _ in range(30)]
    lines = base + [b[:k] + rng.choice("abé") + b[k + rng.randint(0, 1) :] for b in base for k in (0, 3, len(b) - 1)] + [b[:-1] for b in base] + base[:9]
    rng.shuffle(lines)
    at = [(i // 4, i % 4, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame([(d, "\n".join(x for e, _, x in at if e == d)) for d in range(len(at) // 4 + 1)] + [(900, None), (901, "\n \n")], "doc_id bigint, text string").withColumn("h", F.lit(1))
    at = [x for x in at if x[2].strip()]
    p = list(range(len(at)))
    for i, a in enumerate(at):
        for j in range(i):
            b = at[j]
            if a[2] == b[2] or (len(a[2]) >= 8 and len(b[2]) >= 8 and near(a[2], b[2])):
                p[max(find(p, i), find(p, j))] = min(find(p, i), find(p, j))
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.kept) for r in line_classes(df).collect()}
    assert got == {a[:2]: (*at[find(p, i)][:2], find(p, i) == i) for i, a in enumerate(at)}
    assert line_classes(empty).count() == 0
    long = "x" * 70_000
    assert line_classes(spark.createDataFrame([(1, long), (2, long[:-1] + "y")], "doc_id bigint, text string")).where("kept").count() == 1


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 10))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))) for _ in range(400)]
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string").select((banded_distance(F.col("a"), F.col("b"), threshold) <= threshold).alias("x"), (F.levenshtein("a", "b") <= threshold).alias("y"))
    assert not df.where("x <> y").count()


def test_packing(spark, docs, rows, empty, tmp_path):
    import tiktoken

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    plain = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_ranks(spark, path), special_tokens={})
    got = defaultdict(list)
    packed = pack_documents(docs, path, length=64, group_tokens=3000)
    for r in packed.collect():
        ids = np.frombuffer(bytes(r.ids), "<i4")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 64 and list(r.position_resets) == list(r.cu_seqlens[:-1])
        for k, (d, o) in enumerate(zip(r.doc_ids, r.doc_offsets)):
            got[d].append((o, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    for i, t, *_ in rows:
        want, n = plain.encode_ordinary(t or ""), [x[0] for x in rows].count(i)
        assert [x for _, p in sorted(got[i])[::n] for x in p] == want
    write_matrices(packed, str(tmp_path / "m"), 64)
    assert all(len(r.ids) == len(r.positions) == 256 for r in spark.read.parquet(str(tmp_path / "m")).collect())
    assert pack_documents(empty, path).count() == 0
    rng = random.Random(2)
    sizes = [rng.randint(1, 64) for _ in range(500)]
    left, n = [], 0
    for s in sorted(sizes, reverse=True):  # best fit by search
        fit = [i for i, c in enumerate(left) if c >= s]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= s
        else:
            left.append(64 - s)
    found = best_fit(sizes, 64)
    assert len(found) == len(left) and sorted(i for r in found for i in r) == list(range(500)) and all(sum(sizes[i] for i in r) <= 64 for r in found)


def test_language_model(docs, rows, empty):
    import math
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    counts = Counter(w for i, t, *_ in rows if not held[i] for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    got = score_documents(docs).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        w = [*words_of(text[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r.score < 0
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert score_documents(empty).count() == 0


def test_seating_follows_the_restaurant_process():
    rng = random.Random(4)
    for customers, mass, discount in ((1, 2.0, 0.5), (20, 2.0, 0.5), (60, 5.0, 0.8)):
        sums = []
        for _ in range(3000):  # one customer after the other
            t = 1
            for i in range(1, customers):
                t += rng.random() < mass / (mass + i - discount * t)
            sums.append(t)
        got = sample_tables(np.full(3000, customers), np.full(3000, mass), discount, np.random.default_rng(1))
        assert abs(got.mean() - np.mean(sums)) < 0.05 * np.mean(sums) + 0.01 and got.min() >= 1 and got.max() <= customers


@pytest.mark.parametrize(("customers", "mass", "discount"), [(1000, 5.0, 0.8), (20_000, 5.0, 0.8), (20_000, 100.0, 0.8)])
def test_seating_of_many_customers(customers, mass, discount):
    """Means within five standard errors of customers seated one by one: seating in blocks is 6 to 12 % above."""
    rng, runs = np.random.default_rng(7), 4000
    t = np.ones(runs)
    for i in range(1, customers):
        t += rng.random(runs) < mass / (mass + i - discount * t)
    got = sample_tables(np.full(runs, customers), np.full(runs, mass), discount, np.random.default_rng(1))
    assert abs(got.mean() - t.mean()) < 5 * np.sqrt((got.var() + t.var()) / runs)


def test_sweeps_ask_once_for_each_word(monkeypatch):
    """In a Gibbs sweep the chance that a word's table closes is found for each word, not for each of its contexts; pairs are in order of both."""
    from recordrank.llm import language_model as lm

    rng = np.random.default_rng(2)
    word, ctx = rng.integers(0, 3, 5000).astype(np.uint64), rng.integers(0, 1 << 48, 5000).astype(np.uint64)
    ctx[::3] = (ctx[::3] & np.uint64(0xFFFFFFFF)) | np.uint64(7 << 32)
    order = lm._order(word, ctx)
    assert (order == np.lexsort((ctx, word))).all()
    word, ctx = word[order], ctx[order]
    counts = pa.Table.from_batches([lm._batch([(0, *lm._pair_columns(word, ctx), lm._numbers(rng.integers(1, 400, 5000)))], lm._COUNTS)])
    shard = lm.Shard(counts)
    totals = {"discounts": (0.4, 0.6), "tops": 9, "vocabulary": 3, "tables": 5000}
    seating = lm.Seating(shard, totals, np.ones(5000, np.int64), 1)
    asked, true = [], lm.closing
    monkeypatch.setattr(lm, "closing", lambda c, t, d: asked.append((d, len(c))) or true(c, t, d))
    seating.sweep(shard, totals, np.ones(5000, np.int64), 2)
    assert max(n for d, n in asked if d == 0.4) <= 3 < max(n for d, n in asked if d == 0.6)
    assert (seating.tables >= 1).all() and (seating.tables <= shard.num).all() and (seating.customers == np.bincount(shard.at, seating.tables)).all()


def test_contexts_do_not_share_a_restaurant(spark):
    """Each of 200,000 contexts has one follower of its own, so all but the rarest tokens are foretold; merged contexts would not foretell them."""
    n = 200_000
    lines = spark.range(n).select(F.format_string("c%d f%d", "id", F.pmod(F.col("id") * 7919, F.lit(n))).alias("line"))
    df = lines.select(F.expr("explode(array_repeat(line, 4))").alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    r = score_documents(df).where("not held_out").agg(F.avg(F.col("score") - F.col("base_score")).alias("gain"), F.count("*").alias("n")).first()
    assert r.n > 3 * n and r.gain > 5


def test_lines_of_more_edits(spark, tmp_path):
    """The query links by an edit for 12 characters, 1 to 4, from 5 characters on."""
    from recordrank.llm.queries import op7_lines

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(e[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1]

    rng = random.Random(8)
    lines = []
    for n in (5, 6, 7, 11, 12, 23, 24, 25, 35, 36, 47, 48, 49, 60, 90):
        for _ in range(3):
            base = "".join(rng.choice("abcdefgt ") for _ in range(n - 1)) + "x"
            lines.append(base)
            for edits in range(1, 6):
                v = list(base)
                for _ in range(edits):
                    k = rng.randrange(len(v))
                    v[k : k + rng.randint(0, 1)] = rng.choice(["", "y", "z"])
                lines.append("".join(v).strip() or "q")
    p = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            n = min(len(a), len(b))
            if a == b or (n >= 5 and abs(len(a) - len(b)) <= 4 and distance(a, b) <= min(4, max(1, n // 12))):
                p[max(find(p, i), find(p, j))] = min(find(p, i), find(p, j))
    spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.class_doc for r in op7_lines(spark, str(tmp_path)).collect()} == {i: find(p, i) for i in range(len(lines))}


def test_line_filters_lose_no_link(spark):
    """Pairs within the edits pass the letter counts, kept modulo 16 beside lengths modulo 256, and the pieces; their distance is exact at any length."""
    rng = random.Random(12)
    pairs = []
    for n in (48, 250, 256, 700, 2600):
        for _ in range(25):
            base = "".join(rng.choice("etanoirs xyzé") for _ in range(n))
            v = list(base)
            for k in sorted((rng.randrange(n - 4) for _ in range(rng.randint(1, 7))), reverse=True):
                v[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "zz"])
            pairs.append((base, "".join(v)))
    pairs = [p for p in pairs if p[0] != p[1]]
    docs = spark.createDataFrame([(2 * i + j, f"{i:04d} {x} {i:04d}") for i, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id bigint, text string")
    near = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").where(F.levenshtein("a", "b") <= 4)
    got = line_classes(docs, threshold=4, least=5).where("links > 0").select((F.col("doc_id") / 2).cast("int").alias("i")).distinct()
    assert 30 < near.count() < len(pairs) - 30 and {r.i for r in got.collect()} == {r.i for r in near.collect()}


def test_joins_of_lines_are_compiled(spark, tmp_path):
    """The JVM does not compile code of a join beyond 8,000 bytes, which made the join of keys three times slower."""
    from recordrank.llm.lines import _candidates, _slots, _traits, _with_layouts

    texts = spark.range(100).select("id", F.format_string("some line of text with number %d", "id").alias("line"))
    _with_layouts(texts.select("*", F.length("line").alias("n"), _traits(F.col("line")).alias("traits")), 4).write.parquet(str(tmp_path / "t"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = _candidates(spark.read.parquet(str(tmp_path / "t")), _slots(4)[:1], 4)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) <= 8000


def test_own_keys_of_lines_are_kept(spark, tmp_path):
    """The lines' own keys are made once: of the two scans that a join of keys needs, one reads no text."""
    from recordrank.llm.lines import _candidates, _slots, _traits, _with_layouts, _with_rests

    lines = spark.createDataFrame([(i * 256 + len(x), x, len(x)) for i, x in enumerate(["one tree near an inn", "one tree near an ink", "é noon", "z" * 9])], "id bigint, line string, n int")
    rests = _with_rests(lines)
    named = [F.col(c) for c in rests.columns if c.startswith("rest")]
    traits = rests.select("id", "line", "n", _traits(F.col("line"), named).alias("traits"))
    assert not traits.where(F.col("traits") != _traits(F.col("line"))).count()
    _with_layouts(traits, 4).write.parquet(str(tmp_path / "t"))
    pairs = _candidates(spark.read.parquet(str(tmp_path / "t")), _slots(4)[:1], 4)
    scans = re.findall(r"ReadSchema: struct<(.*?)>+\n", pairs._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert sorted("line:" in x for x in scans) == [False, True] and pairs.count() == 1


def test_long_dialogues_are_cut_by_position(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, 0, 1]), rng.choice("ab"), f"t{rng.randrange(60)}") for c in [9] * 300 + [1] * 150] + [(2, 0, "a", "same")] * 50 + [(3, 0, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = [sorted(map(str, rotate(d, part_chars=250).collect())) for d in (df.repartition(3), df.orderBy(F.desc("text")).repartition(7))]
    assert got[0] == got[1]
    parts = defaultdict(list)
    for r in sorted(rotate(df, part_chars=250).where("speaker = 'a'").collect(), key=lambda r: r.part):
        parts[r.conv_id].append(r)
    want = defaultdict(list)
    for c, t, s, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        want[c].append("<|assistant|>\n" * (s == "a") + "<|user name=b|>\n" * (s == "b") + x + "<|end|>\n")
    assert {k: "".join(r.rendered for r in v) for k, v in parts.items()} == {k: "".join(v) for k, v in want.items()}
    assert len(parts[9]) > 20 and all(len(r.rendered) < 300 for v in parts.values() for r in v)


def test_a_dialogue_of_thousands_of_turns_is_whole(spark):
    rows = [(1, t, "ab"[t % 2], f"turn {t} é") for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    for r in rotate(df).collect():
        assert r.part == 0 and r.n_turns == 5000
        assert [r.rendered[m.start : m.end] for m in r["mask"]] == [f"turn {t} é<|end|>" for t in range(5000) if "ab"[t % 2] == r.speaker]


def test_stages_take_any_other_columns(spark):
    """Documents whose columns have the names of helper columns; equal and null ids; empty tables."""
    names = "_rows _copies _size _id _source id rows copies of words row same0 node first least part".split()
    rows = [(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, "h i j", None), (3, "h i j", None), (None, "k", "t"), (None, None, "t"), (4, "", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({n: F.lit(7) for n in names})
    alone = first_of_classes(df)
    assert alone.columns == df.columns and sorted(str(r.doc_id) for r in alone.collect()) == ["1", "3", "4", "None", "None"]
    mix = mixed(df)
    want = Counter()
    for r in mix_sources(df).collect():
        want[r.doc_id, r["size"]] += r.copies
    assert mix.columns == df.columns and Counter((r.doc_id, len((r.text or "").split())) for r in mix.collect()) == +want
    assert first_of_classes(df.limit(0)).count() == mixed(df.limit(0)).count() == 0
    assert without_benchmark(df, df.select(F.col("doc_id").alias("item_id"), "text").limit(0)).columns == df.columns


def test_equal_or_missing_ids_do_not_merge_texts(spark):
    """Groups of rows without an id or with one id, whose texts part after the first digits only."""
    rows = [(i, ("x" * 100) + tail) for tail in ("a" * 300, "b" * 300, "a" * 299 + "b") for i in (None, 0, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = exact_duplicates(df).collect()
    assert len(got) == 12 and {r.group_size for r in got} == {4} and len({r.text_sha256 for r in got}) == 3 and {r.keep_id for r in got} == {0}


def test_closing_of_tables():
    """By enumeration of all seatings of few customers, and the approximation for many against the recurrence."""
    from recordrank.llm import language_model as L

    d = 0.6

    def seatings(n, sizes=(), weight=1.0):  # each with its probability given that all eat one dish, up to the factor of the tables
        if not n:
            yield sizes, weight
            return
        yield from seatings(n - 1, (*sizes, 1), weight)
        for i, k in enumerate(sizes):
            yield from seatings(n - 1, (*sizes[:i], k + 1, *sizes[i + 1 :]), weight * (k - d))

    for c in range(2, 8):
        sums = defaultdict(lambda: [0.0, 0.0])
        for sizes, w in seatings(c):
            sums[len(sizes)][0] += w
            sums[len(sizes)][1] += w * sizes.count(1) / c
        for t, (whole, alone) in sums.items():
            assert np.isclose(closing(np.array([c]), np.array([t]), d)[0], alone / whole)
    c = np.full(60, L.EXACT)
    t = np.arange(5, 65)
    exact = L._closing_table(d)[c, t]
    limit, L.EXACT = L.EXACT, 100
    try:
        L._closing_table.cache_clear()
        assert np.all(np.abs(closing(c, t, d) / exact - 1) < 0.02)
    finally:
        L.EXACT = limit
        L._closing_table.cache_clear()


def test_gibbs_against_a_sampler_of_single_seats():
    """Mean predictive probabilities of a tiny corpus: customers and tables in arrays against every table and its guests, moved one by one."""
    words = "a b a b a c a b c c a b a a b c d a b d a b c a a a b b a b".split()
    pairs = Counter(zip(words, words[1:]))  # context, word
    kinds = sorted({w for _, w in pairs})
    contexts = sorted({c for c, _ in pairs})
    d1 = d2 = 0.5
    v = len(kinds)

    def predictive(tables, customers_above, tops):
        p = {}
        for c in contexts:
            n, t = sum(k for (x, _), k in pairs.items() if x == c), sum(k for (x, _), k in tables.items() if x == c)
            for w in kinds:
                top = (customers_above[w] - d1 * tops[w] + (STRENGTH + d1 * sum(tops.values())) / (v + 1)) / (STRENGTH + sum(customers_above.values()))
                p[c, w] = (pairs.get((c, w), 0) - d2 * tables.get((c, w), 0) + (STRENGTH + d2 * t) * top) / (STRENGTH + n)
        return p

    rng = random.Random(3)
    below, above = {k: [] for k in pairs}, {w: [] for w in kinds}

    def seat_above(w):
        new = (STRENGTH + d1 * sum(map(len, above.values()))) / (v + 1)
        weights = [k - d1 for k in above[w]] + [new]
        i = rng.choices(range(len(weights)), weights)[0]
        above[w][i:] = [above[w][i] + 1, *above[w][i + 1 :]] if i < len(above[w]) else [1]

    def leave(guests):
        i = rng.choices(range(len(guests)), guests)[0]
        guests[i] -= 1
        if not guests[i]:
            del guests[i]
            return True
        return False

    def seat(c, w):
        n_above, t_above = sum(above[w]), len(above[w])
        top = (n_above - d1 * t_above + (STRENGTH + d1 * sum(map(len, above.values()))) / (v + 1)) / (STRENGTH + sum(map(sum, above.values())))
        mine = below[c, w]
        weights = [k - d2 for k in mine] + [(STRENGTH + d2 * sum(len(g) for (x, _), g in below.items() if x == c)) * top]
        i = rng.choices(range(len(weights)), weights)[0]
        if i < len(mine):
            mine[i] += 1
        else:
            mine.append(1)
            seat_above(w)

    for (c, w), n in pairs.items():
        for _ in range(n):
            seat(c, w)
    want, sweeps = Counter(), 1500
    for s in range(sweeps + 50):
        for (c, w), n in pairs.items():
            for _ in range(n):
                if leave(below[c, w]):
                    leave(above[w])
                seat(c, w)
        for w in kinds:
            for _ in range(sum(above[w])):
                leave(above[w])
                seat_above(w)
        if s >= 50:
            want.update(predictive({k: len(g) for k, g in below.items()}, {w: sum(g) for w, g in above.items()}, {w: len(g) for w, g in above.items()}))

    class Tiny:
        keys = sorted(pairs, key=lambda k: k[::-1])
        num = np.array([pairs[k] for k in keys])
        words = np.array(kinds)
        at = np.array([kinds.index(w) for _, w in keys])
        ctx = np.array([contexts.index(c) for c, _ in keys])

    got, now = Counter(), {"vocabulary": v, "discounts": (d1, d2), "tables": len(pairs), "tops": v}
    sums = lambda t: np.bincount(Tiny.ctx, t, len(contexts))
    seating = Seating(Tiny, now, sums(np.ones(len(Tiny.num))), 1)
    for s in range(sweeps + 50):
        now = now | {"tables": int(seating.tables.sum()), "tops": int(seating.tops.sum())}
        seating.sweep(Tiny, now, sums(seating.tables), s)
        assert np.all((seating.tables >= 1) & (seating.tables <= Tiny.num) & (seating.tops[Tiny.at] <= seating.customers[Tiny.at]))
        if s >= 50:
            got.update(predictive(dict(zip(Tiny.keys, seating.tables.tolist())), dict(zip(kinds, seating.customers.tolist())), dict(zip(kinds, seating.tops.tolist()))))
    apart = [abs(got[k] / want[k] - 1) for k in want]
    assert max(apart) < 0.1 and np.mean(apart) < 0.03, (max(apart), np.mean(apart))


def test_numbers_and_buckets(spark):
    """Numbers come back whole at the bounds of a byte; a table in buckets is grouped without a shuffle and leaves no entry in the catalog."""
    from recordrank.llm.language_model import _numbers, _told
    from recordrank.llm.scratch import bucketed, drop

    for x in ([], [0], [254, 255, 256], [1 << 40, 3, 255, 0]):
        assert _told(_numbers(np.array(x, np.int64))).tolist() == x
    before = len(spark.catalog.listTables())
    table = bucketed(spark.range(100).selectExpr("cast(id % 7 as int) AS shard", "id"), "bucketed_test", "shard")
    counts = table.groupBy("shard").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sum(r["count"] for r in counts.collect()) == 100 and len(spark.catalog.listTables()) == before
    drop(table)


def test_mixed_takes_each_text_as_often_as_its_row(spark):
    rows = [(None, f"t{i} b c", "a") for i in range(50)] + [(7, f"u{i} b", "b") for i in range(20)] + [(8, "same words", "b")] * 5 + [(9, None, None), (9, "", None), (9, "x", "b"), (9, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("copies", F.lit("c"))
    size = lambda t: len((t or "").split())
    got = mixed(df, weights=(1.0,), share=1.7, most=4.0).collect()
    taken = mix_sources(df, weights=(1.0,), share=1.7, most=4.0).collect()
    assert len(got) == sum(r.copies for r in taken) and len(taken) == len(rows)
    want, sizes = Counter(), Counter((i, s, size(t)) for i, t, s in rows)
    for r in taken:
        want[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got) == +want
    each = Counter((r.doc_id, r.text, r.source) for r in got)
    for (i, t, s), n in each.items():
        rate = next(r.target / r.source_size for r in taken if r.source == s)
        assert abs(n - rate * rows.count((i, t, s))) < rows.count((i, t, s)) + 1e-9
    assert sum(sizes.values()) == len(rows)


def test_mixing_is_unbiased(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "a") for i in range(40)] + [(99, "w " * 40, "b")], "doc_id long, text string, source string")
    runs = [{r.doc_id: (r.copies, r.target / r.source_size) for r in mix_sources(df, weights=(1, 2), share=0.8, leaf=8, seed=s * 1000).collect()} for s in range(10)]
    for i in (0, 3, 6, 17, 39):
        rate = runs[0][i][1]
        assert abs(sum(r[i][0] for r in runs) / len(runs) - rate) < 0.55
    assert abs(sum(r[i][0] for r in runs for i in range(40)) / (10 * 40) - runs[0][0][1]) < 0.08


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    from recordrank.llm import toxicity as T

    bad, good = "awful slur filth hate venom", "garden river bread lamp quiet"
    rows = [(0, f"{bad} {good} n{i % 7}") for i in range(20000)] + [(i, f"{bad if i % 4 == 0 else good} {'pad ' * (i % 9)}") for i in range(1, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(T, "train", lambda xp, xu, prior, real=T.train: seen.append((len(xp), len(xu), prior)) or real(xp, xu, prior))
    got = T.toxicity(docs, labels, positives=50, unlabelled=20000).where("held_out and doc_id > 0").collect()
    (p, u, prior), = seen
    assert p <= 50 and u <= 1200 and 0.2 < prior < 0.3
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)


def test_rows_are_full_in_many_small_partitions(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["river", "stone", "lamp", "über", "winter"]) for _ in range(rng.randint(1, 700)))) for i in range(900)] + [(None, "null id")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_id", F.lit("x")).withColumn("ids", F.lit(1))
    packed = pack_documents(df.repartition(64), length=256)
    r = fill(packed, 256).first()
    assert r.fill >= 0.99 and r.rows <= 1.01 * r.least_rows
    assert sorted({str(d) for p in packed.collect() for d in p.doc_ids}) == sorted({str(i) for i, _ in rows})
    whole = fill(pack_documents(df.coalesce(1), length=256), 256).first()
    assert abs(r.rows - whole.rows) <= 2 and fill(pack_documents(df.limit(0))).first().rows == 0


def test_shuffle_files_go_with_their_phase(spark, tmp_path):
    """After a kept table is written with ``release``, the shuffle it came from can go at once, not a phase later."""
    import time

    from recordrank.llm.scratch import drop, keep

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    for _ in range(2):
        spark.sql("SELECT 1").collect()
        spark._jvm.System.gc()
        time.sleep(1)
    before = tracker.shuffleStatuses().size()
    kept = keep(spark.range(1000).repartition(3), "released", release=True)
    time.sleep(2)
    assert tracker.shuffleStatuses().size() <= before
    drop(kept)
