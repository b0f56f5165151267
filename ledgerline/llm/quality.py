"""Quality classifier: Naive Bayes support vectors.

Binary n-gram indicators are scaled by their class log-count ratios, a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent,
and a logistic curve on rows kept out of the fit turns margins into scores.

N-grams are words, word pairs, the punctuation that ends a word, and repeats
(a word that equals the one, two or three before it); each is hashed to one of
``2 ** bits`` features, so the model has a fixed size however large the corpus is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, mix, run_hashes, text_chunks, unit_hash, widened, words


@dataclass(frozen=True)
class QualityParams:
    #: Labelled rows that the model is fitted to, at most (about as many are drawn, by a seeded hash of the id).
    max_train: int = 8000
    #: Bytes of their texts, at most, in the same order; and of one of them.
    max_bytes: int = 48 << 20
    max_text: int = 1 << 20
    bits: int = 18
    #: Added to each class's count of a feature.
    smoothing: float = 1.0
    #: Upper bound of a row's dual variable.
    c: float = 1.0
    epochs: int = 12
    #: Parts of the drawn rows; each is left out in turn, so that the curve sees them all.
    folds: int = 5
    threshold: float = 0.7
    seed: int = 11


_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of a chunk, each once, in order."""
    starts, ends, first = words(data, offs)
    n_docs = len(offs) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    h = run_hashes(data, starts, ends)
    out_doc, out = [doc], [h]
    run = np.zeros(len(h), np.int64)  # how many words just before this one equal it, 3 at most
    if len(h) > 1:
        same_doc = doc[1:] == doc[:-1]
        out_doc.append(doc[1:][same_doc])
        out.append(mix(h[:-1] * np.uint64(3) + h[1:])[same_doc])
        equal = np.concatenate([[False], same_doc & (h[1:] == h[:-1])])
        reach = equal
        for back in (1, 2, 3):
            run[reach] = back
            reach = reach & np.concatenate([[False], reach[:-1]])
    out_doc.append(doc[run > 0])
    out.append(mix(run[run > 0].astype(np.uint64) + np.uint64(0xA5A5)))
    tail = ~_WORDLIKE[data[ends - 1]]
    if tail.any():
        # the run of marks at the end of a word, by its last three bytes
        e, s = ends[tail], starts[tail]
        code = np.zeros(len(e), np.uint64)
        live = np.ones(len(e), bool)
        for k in range(1, 4):
            at = e - k
            live &= at >= s
            live[live] = ~_WORDLIKE[data[at[live]]]
            code = code * np.uint64(257) + np.where(live, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out_doc.append(doc[tail])
        out.append(mix(code + np.uint64(0x5A5A5A)))
    key = np.concatenate(out_doc).astype(np.uint64) << np.uint64(bits) | np.concatenate(out) >> np.uint64(64 - bits)
    key = np.unique(key)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, bits: int, smoothing: float) -> np.ndarray:
    """log of the smoothed share of class 1's counts over class 0's, for each feature."""
    counts = []
    for label in (1, 0):
        own = [r for r, v in zip(rows, y, strict=True) if v == label]
        count = np.full(1 << bits, smoothing)
        for at in range(0, len(own), 256):  # some rows at a time, so that no copy of all is made
            count += np.bincount(np.concatenate(own[at : at + 256]), minlength=1 << bits)
        counts.append(count)
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over unit-length rows of scaled indicators."""
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    cap = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y <= 0).sum()))  # both classes weigh the same
    scale = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    square = np.array([(ratio[r] ** 2).sum() * k * k + 1.0 for r, k in zip(rows, scale, strict=True)])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] * scale[i]
            gradient = sign[i] * (v @ w[r] + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cap[i])
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                w[r] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, b


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) of the curve that best gives ``y`` from the margins, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    positive, negative = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, feature = features(data, offs, self.bits)
        n = len(offs) - 1
        size = np.maximum(1, np.bincount(doc, minlength=n))
        margin = np.bincount(doc, weights=self.weights[feature], minlength=n) / np.sqrt(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, p: QualityParams = QualityParams()) -> QualityModel:
    """The model of feature rows and 0/1 labels.  One class or no rows: every score is the smoothed share of class 1."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return QualityModel(np.zeros(1 << p.bits), 0.0, 1.0, float(np.log(share / (1 - share))), p.bits)
    part = np.random.default_rng(p.seed).permutation(len(y)) % p.folds
    margin, truth = [], []
    for k in range(p.folds):
        fit = np.flatnonzero(part != k)
        if len(set(y[fit])) < 2:
            continue
        w, b = _fit_once([rows[i] for i in fit], y[fit], p)
        own = np.flatnonzero(part == k)
        margin += [w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b for i in own]
        truth += [y[i] for i in own]
    w, b = _fit_once(rows, y, p)
    if len(set(truth)) < 2:
        margin, truth = [w[r].sum() / np.sqrt(max(1, len(r))) + b for r in rows], y
    return QualityModel(w, b, *logistic_curve(np.array(margin), np.array(truth)), p.bits)


def _fit_once(rows: list[np.ndarray], y: np.ndarray, p: QualityParams) -> tuple[np.ndarray, float]:
    return dual_coordinate_descent(rows, y, log_count_ratio(rows, y, p.bits, p.smoothing), p.c, p.epochs, p.seed)


def training_rows(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """(label, features) of the drawn rows.  An id with two labels, or none, teaches nothing; held-out ids neither."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
        .where("label = most")
    )
    share = p.max_train / max(1, known.count())
    drawn = known.where(unit_hash(p.seed, F.col("doc_id")) < share).orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id").limit(p.max_train).select("doc_id", "label")
    # at most max_train pairs of numbers: broadcast whatever the size of the corpus
    text = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text")
    # repeated ids may give more rows than were drawn; which of them stay doesn't depend on the order of tasks
    text = bounded_sample(text, p.seed, 2 * p.max_train, p.max_bytes, p.max_text)
    bits = p.bits

    def take(batches):
        for b in batches:
            for at, end, data, offs in text_chunks(b.column(1)):
                doc, feature = features(data, offs, bits)
                cuts = np.searchsorted(doc, np.arange(end - at + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[at:end].cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature, pa.int32()))], names=["label", "features"])

    return text.mapInArrow(take, "label int, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), fitted on the driver to a sample that ``max_train``, ``max_bytes`` and ``max_text`` bound."""
    got = training_rows(docs, labels, p).toArrow()
    column = got.column("features").combine_chunks()
    flat, cuts = np.asarray(column.values), np.asarray(column.offsets)
    rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # views, not copies
    y = np.asarray(got.column("label"), np.int64)
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), zlib.crc32(rows[i])))  # the fit doesn't depend on the order of tasks
    return fit_rows([rows[i] for i in order], y[order], p)


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a column ``out``, the score of each whole text in [0, 1].

    A null or empty text has no features and gets the score of the bias alone.
    An existing column of the name ``out`` is replaced; equal texts get equal scores.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits numbers
    kept = docs.select([F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != out])
    schema = widened(kept, (out, "double"))
    fed = docs.select([*(F.col(f"`{c}`") for c in kept.columns), F.col(f"`{text}`").alias("__text")])

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.scores(data, offs) for _, _, data, offs in text_chunks(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*b.schema.names[:-1], out])

    return fed.mapInArrow(run, schema)


def classify(docs: DataFrame, model: QualityModel, threshold: float = QualityParams.threshold, keep: list[str] | None = None) -> DataFrame:
    """``score`` and ``predicted`` (1 at the threshold or above)."""
    return score(docs, model, keep=keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
