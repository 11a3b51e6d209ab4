"""Severity of toxic text by cumulative-link ordinal regression.

Features x say which words, and which word beginnings of 4 to 9 characters that go
on, a text has, hashed to ``2**bits`` buckets.  With one weight vector w for all grades

    P(grade >= k | x) = sigmoid(w . x - theta_k),   theta_1 <= ... <= theta_K.

Training reads at most ``max_rows`` labelled rows, those with the smallest hash of
their id, so the sample doesn't depend on how rows are dealt.  A first pass over them
keeps the ``max_features`` buckets that toxic rows have most above chance (at least
``least_z`` standard deviations), a second one fits w and theta on the mean negative
log-likelihood with a small L1 term, by accelerated proximal gradient steps that restart
where the momentum points uphill.  Weights are held at zero or above, since only what
toxic rows have more often is kept; thresholds are held in order.  It makes ``rounds``
steps, and what they reach is the model.  Scoring reads every text whole and puts out the
expected severity, the sum over k of P(grade >= k).

Edge cases: a null or empty text has no features and gets the score of the
thresholds alone.  Labels that are null are left out; of repeated labels of one id
the largest counts.  Of documents that share a labelled id the least text is trained on,
and each is scored.  Without labels, or with a single grade, nothing is toxic.  An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import U64, Words, hash_words, pieces, text_column
from lattica.session import cut, prepare

EDGES = b".,;:!?\"'`()[]{}<>*#%&$-_/\\|~"


@dataclass(frozen=True)
class Params:
    bits: int = 22
    max_rows: int = 40_000  # bound of the labelled sample
    max_features: int = 4096
    least_rows: int = 4  # a bucket seen in fewer sampled rows has no weight
    least_z: float = 5.0
    l1: float = 1e-5
    rounds: int = 1000
    reject_at: float = 0.25  # of P(grade >= 1)
    split_top: bool = True  # the top grade's rows with more kept buckets than their median get a grade of their own


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray  # one for each of them
    thresholds: np.ndarray  # one for each grade from 1
    params: Params


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the vocabulary its buckets: offsets, buckets."""
    told: list[bytes] = []
    ends = [0]
    for raw in words.vocab:
        word = raw.strip(EDGES).decode("utf-8", "replace")
        if word:
            told.append(b"=" + word.encode())
            told.extend(word[:k].encode() for k in range(4, min(len(word), 10)))
        ends.append(len(told))
    return np.array(ends), (hash_words(told) >> U64(64 - bits)).astype(np.int64)


def presence(batch: pa.RecordBatch, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of a piece; of the buckets in the sorted ``wanted`` where given, as places in it."""
    words = Words(text_column(batch))
    ends, own = features(words, bits)
    row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets))
    ids = words.ids
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, own), max(0, len(wanted) - 1))
        held = wanted[at] == own if len(wanted) else np.zeros(len(own), bool)
        ends, own = np.concatenate([[0], np.cumsum(held)])[ends], at[held]
        some = np.diff(ends)[ids] > 0 if len(ids) else np.zeros(0, bool)
        row, ids = row[some], ids[some]
    both = np.unique(row * max(1, len(words.vocab)) + ids)
    row, ids = both // max(1, len(words.vocab)), both % max(1, len(words.vocab))
    per = np.diff(ends)[ids] if len(ids) else np.zeros(0, np.int64)
    last = np.cumsum(per)
    gather = np.arange(last[-1] if len(last) else 0) + np.repeat(ends[ids] - (last - per), per)
    pairs = np.unique(np.repeat(row, per) << bits | own[gather])
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def at_least(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K, a column each."""
    return _sigmoid(scores[:, None] - thresholds[None, :])


def fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, size: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``size`` features and ordered thresholds, from sparse presence (rows, cols) and grades 0 .. K."""
    n, top = len(grades), int(grades.max(initial=0))
    weights = np.zeros(size)
    if not n or top == 0 or (grades == grades[0]).all():
        return weights, np.full(max(1, top), 30.0)
    share = np.clip(np.array([(grades >= k).mean() for k in range(1, top + 1)]), 1e-6, 1 - 1e-6)
    thresholds = np.log((1 - share) / share)
    at = np.arange(n)
    # the largest squared singular value of (features, 1) / sqrt(n), for the length of a step
    v, v0, norm = np.ones(size), 1.0, 1.0
    for _ in range(30):
        u = np.bincount(rows, v[cols], minlength=n) + v0
        v, v0 = np.bincount(cols, u[rows], minlength=size) / n, u.mean()
        norm = float(np.sqrt((v**2).sum() + v0**2))
        v, v0 = v / norm, v0 / norm
    step = 1 / (0.5 * 1.1 * norm * top)
    ahead, ahead_t, pace = weights, thresholds, 1.0
    for _ in range(p.rounds):
        score = np.bincount(rows, ahead[cols], minlength=n)
        tail = np.hstack([np.ones((n, 1)), at_least(score, ahead_t), np.zeros((n, 1))])
        slope = tail * (1 - tail)
        high, low = slope[at, grades], slope[at, grades + 1]
        likely = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-12)
        grad = np.bincount(cols, (-(high - low) / likely / n)[rows], minlength=size)
        grad_t = np.array([(high / likely)[grades == k].sum() - (low / likely)[grades == k - 1].sum() for k in range(1, top + 1)]) / n
        new = np.maximum(0.0, ahead - step * (grad + p.l1))
        new_t = np.maximum.accumulate(ahead_t - step * grad_t)
        quicker = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        if ((ahead - new) * (new - weights)).sum() + ((ahead_t - new_t) * (new_t - thresholds)).sum() > 0:
            quicker = pace = 1.0  # the momentum points uphill
        ahead = new + (pace - 1) / quicker * (new - weights)
        ahead_t = np.maximum.accumulate(new_t + (pace - 1) / quicker * (new_t - thresholds))
        weights, thresholds, pace = new, new_t, quicker
    return weights, thresholds


def train(docs: DataFrame, grades: DataFrame, params: Params | None = None) -> Model:
    """``grades``: doc_id and grade (0, 1, ...).  Only counts and kept buckets reach the driver."""
    p = params or Params()
    prepare(docs.sparkSession)
    one = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)  # a proven bound, so it can be broadcast
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text"))
    totals = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)), F.countDistinct("doc_id")).first()
    n, bad, ids = totals(texts)
    if n > ids:  # repeated ids, which the sample's bound doesn't count
        texts = cut(texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text")))
        n, bad, ids = totals(texts)

    def count(batches):
        for batch in pieces(batches):
            row, col = presence(batch, p.bits)
            toxic = batch.column("grade").to_numpy() > 0
            own, at = np.unique(col, return_inverse=True)
            yield pa.record_batch({"bucket": pa.array(own), "n": pa.array(np.bincount(at, minlength=len(own)).astype(np.int64)), "bad": pa.array(np.bincount(at, toxic[row], minlength=len(own)).astype(np.int64))})

    share = bad / n if n else 0.0
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    counts = texts.mapInArrow(count, "bucket long, n long, bad long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    told = counts.where(F.col("n") >= p.least_rows).withColumn("z", z).where(F.col("z") >= p.least_z).orderBy(F.desc("z"), "bucket").limit(p.max_features) if 0 < share < 1 else None
    wanted = np.sort(np.array([r[0] for r in told.select("bucket").collect()], dtype=np.int64)) if told is not None else np.zeros(0, np.int64)

    def read(batches):
        for batch in pieces(batches):
            row, col = presence(batch, p.bits, wanted)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "cols": pa.array([col[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    got = texts.mapInArrow(read, "doc_id long, grade int, cols binary").toArrow().sort_by("doc_id")
    own = [np.frombuffer(x, dtype=np.int32) for x in got.column("cols").to_pylist()]
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own]) if own else np.zeros(0, np.int64)
    cols = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
    graded = got.column("grade").to_numpy().astype(np.int64)
    if p.split_top and graded.max(initial=0) > 0:
        most, hits = graded == graded.max(), np.bincount(rows, minlength=len(graded))
        graded = graded + (most & (hits > np.median(hits[most])))
    weights, thresholds = fit(rows, cols, graded, len(wanted), p)
    held = weights != 0
    return Model(wanted[held], weights[held], thresholds, p)


def _scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    rows, cols = presence(batch, model.params.bits, model.buckets)
    return at_least(np.bincount(rows, model.weights[cols], minlength=batch.num_rows), model.thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, severity (the likeliest grade) and toxic, a row for each row of ``docs``."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            tail = _scores(shared.value, batch)
            each = -np.diff(np.hstack([np.ones((len(tail), 1)), tail, np.zeros((len(tail), 1))]), axis=1)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "expected_severity": pa.array(tail.sum(axis=1)), "severity": pa.array(each.argmax(axis=1).astype(np.int32)), "toxic": pa.array(tail[:, 0] > shared.value.params.reject_at)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_severity double, severity int, toxic boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(_scores(shared.value, batch)[:, 0] <= shared.value.params.reject_at))

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of the labels table, which knows 0 and 1 only; ``split_top`` makes three of them."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 1).when(F.col("toxic") <= 0, 0).alias("grade"))
