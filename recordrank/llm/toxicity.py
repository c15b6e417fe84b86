"""Non-negative positive-unlabelled learning of toxic text.

A linear classifier in numpy learns from confirmed toxic documents and unlabelled text. The risk is that of Kiryo et al. (2017):
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``, with the logistic loss; where the part in the maximum falls below
zero, the step goes against its gradient. Labels of clean documents serve to estimate the class prior only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep
from .words import PUNCT, slices

BUCKETS = 1 << 18


def features(part) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, words and their first 4 and 6 bytes, and their bounds."""
    word, short, middle = part.hashes(4, 6)
    doc = part.doc.astype(np.uint64)
    code = np.concatenate([(doc << np.uint64(18)) | (h >> np.uint64(46)) for h in (word, short, middle)])
    code = np.unique(code)
    bounds = np.searchsorted(code, np.arange(part.n_docs + 1, dtype=np.uint64) << np.uint64(18))
    return (code & np.uint64(BUCKETS - 1)).astype(np.int64), bounds


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for part in slices(batch.column(2), PUNCT):
            code, bounds = features(part)
            codes.append(code.astype(np.int32))
            sizes.append(np.diff(bounds))
        offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(codes)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["positive", "picked", "codes"])


def _placed(chosen: np.ndarray):
    """Sampled rows to the places of their chosen features, of two bytes each."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, cuts = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            at = (place[codes[a:b]] for a, b in zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[x >= 0].astype(np.uint16).tobytes() for x in at], pa.binary())], names=["positive", "picked", "at"])

    return run


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The parts of the risk, ``prior * E_P[l(+)]`` and ``E_U[l(-)] - prior * E_P[l(-)]``, and the gradient of the step.

    Where the second part is negative, the step goes against its gradient alone.
    """
    zp, zu = xp @ w + b, xu @ w + b
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gp, gu = logistic(zp), logistic(zu)  # derivatives of l(-); those of l(+) are less by one
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    minus_w, minus_b = xu.T @ gu / len(xu) - prior * (xp.T @ gp) / len(xp), gu.mean() - prior * gp.mean()
    if negative < 0:
        return positive, negative, -minus_w, -minus_b
    return positive, negative, prior * (xp.T @ (gp - 1)) / len(xp) + minus_w, prior * (gp - 1).mean() + minus_b


def train(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the columns and the bias, from rows of positive and of unlabelled documents."""
    w, b = np.zeros(xp.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        _, _, gw, gb = risk(xp, xu, w, b, prior)
        g = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _score(model, texts: pa.Array) -> np.ndarray:
    w, b = model
    z = [np.zeros(0)]
    for part in slices(texts, PUNCT):
        code, bounds = features(part)
        sums = np.concatenate([[0.0], np.cumsum(w[code], dtype=np.float64)])
        z.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(z) + b, -60, 60)))


def _crc(c):
    return F.crc32(c.cast("string"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, positives: int = 3000, unlabelled: int = 9000, keep_features: int = 2048) -> tuple[np.ndarray, float]:
    """A classifier of texts, learned on a bounded sample; see ``toxicity``.

    The driver gets counts of at most ``BUCKETS`` features, and two bytes for each of at most ``keep_features`` features of a sampled text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & (_crc(F.col("doc_id")) % folds != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    seen = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0)).alias("p")).first()
    prior = min(max(seen.p / seen.n, 1e-4), 1 - 1e-4) if seen.n else 0.01
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    chosen = known.where("label = 1").orderBy(order).limit(positives).select("doc_id", F.lit(True).alias("positive"))
    n = rows.count()
    # a hash threshold, so that no sort of all documents is needed; four deviations above the number wanted at most.
    # Unlabelled text is the hash's pick of all learning rows, confirmed toxic ones among them where it falls on them: a plain sample at every size
    part = min(1.0, unlabelled / max(n, 1))
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)) < int(part * (1 << 30))
    sample = rows.where(F.col("doc_id").isNotNull() & (_crc(F.col("doc_id")) % folds != 0)).join(F.broadcast(chosen), "doc_id", "left")
    sample = sample.select("doc_id", F.coalesce("positive", F.lit(False)).alias("positive"), pick.alias("picked"), "text").where("positive or picked")
    # both depend on the id alone: one row for each id, of repeated ids the text of the least hash, so that the bounds are bounds on rows
    sample = sample.groupBy("doc_id", "positive", "picked").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")).drop("doc_id")
    sample = keep(sample.mapInArrow(_sampled, "positive boolean, picked boolean, codes array<int>"), "toxic_sample")
    weights = np.zeros(BUCKETS, np.float32)
    size = sample.agg(F.count_if("positive").alias("p"), F.count_if("picked").alias("u")).first()
    if not size.p or not size.u:
        drop(sample)
        return weights, -4.0
    counts = sample.select("positive", "picked", F.explode("codes").alias("code")).groupBy("code").agg(F.count_if("positive").alias("p"), F.count_if("picked").alias("u"))
    p, u, both = F.col("p") / size.p, F.col("u") / size.u, (F.col("p") + F.col("u")) / (size.p + size.u)
    apart = F.abs(p - u) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / size.p + 1 / size.u))
    best = counts.where(F.col("p") + F.col("u") >= 5).select("code", apart.alias("apart")).where("apart > 5").orderBy(F.desc("apart"), "code").limit(keep_features)
    features_kept = np.array(sorted(r.code for r in best.collect()), np.int64)
    if not len(features_kept):
        drop(sample)
        return weights, float(np.log(prior / (1 - prior)))
    told: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in sample.mapInArrow(_placed(features_kept), "positive boolean, picked boolean, at binary").toLocalIterator():
        x = np.zeros(len(features_kept), np.float32)
        x[np.frombuffer(bytes(r["at"]), np.uint16)] = 1
        if r.positive:
            told[True].append(x)
        if r.picked:
            told[False].append(x)
    drop(sample)
    weights[features_kept], bias = train(np.stack(told[True]), np.stack(told[False]), prior)
    return weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **fitting) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels are learned only from ids whose crc32 modulo ``folds`` is not 0. At most ``positives`` toxic documents and about
    ``unlabelled`` others are fitted on, chosen by a hash of the id; an id that repeats gives one row, of the text with the least hash. The class prior is the share
    of toxic ones among all labels of the learning folds, kept within 0.0001 and 0.9999; without labels it is 0.01. Features are the ``keep_features`` hashed words and word beginnings that tell the two samples
    apart best, of those in at least 5 sampled rows and more than 5 standard deviations apart. Scores depend on the text alone; a null or empty text gets the score of the bias. A null id is not held out and not
    learned from. Repeated documents are scored each; repeated labels count once, as toxic if any of them says so. Without labels
    the score is low everywhere. An empty table gives no rows. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, folds=folds, **fitting))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(_crc(F.col("doc_id")) % folds == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **fitting))
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(model.value, batch.column(place)) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
