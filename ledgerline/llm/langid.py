"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte pairs and byte triples (ASCII
lower-cased, each run of white space or digits as one space); a softmax layer on
that mean gives the languages.  Both layers are trained by stochastic gradient
descent in numpy.  For scoring the two linear layers are multiplied out, so that a
subword costs one table row.  A temperature and a rejection level are fitted to
what is said of rows that a descent left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, bounded_sample, held_out, text_chunks, unit_hash, widened

#: Returned for a null text and for a text without a letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    #: Rows that the model is fitted to, about (drawn by a seeded hash of the id).
    max_train: int = 4000
    #: Bytes of their texts, at most, in the order of a seeded hash; and of one of them.
    max_bytes: int = 12 << 20
    max_text: int = 1 << 18
    bits: int = 16
    width: int = 12
    epochs: int = 6
    rate: float = 0.5
    #: Parts of the drawn rows; each is left out of a descent in turn, and temperature and level are fitted to what is then said of it.
    folds: int = 3
    #: Share of correctly named calibration rows that the rejection level lets through.
    keep: float = 0.995
    seed: int = 23


_MAP = LOWER.copy()
_MAP[[*range(0x09, 0x0E), *range(48, 58)]] = 0x20


def subwords(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, where each document's begin): the pairs and triples at every byte, within the document."""
    n, n_docs = len(data), len(offs) - 1
    if n < 2:
        return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
    b = _MAP[data].astype(np.uint32)
    blank = b == 0x20
    pair = b[:-1] << np.uint32(8) | b[1:]
    triple = np.zeros(n - 1, np.uint32)
    triple[:-1] = pair[:-1] << np.uint32(8) | b[2:]
    shift = np.uint32(32 - bits)
    feats = np.empty((n - 1, 2), np.int32)
    feats[:, 0] = (pair * np.uint32(2654435761) + np.uint32(97)) * np.uint32(2246822519) >> shift
    feats[:, 1] = (triple * np.uint32(2654435761) ^ triple >> np.uint32(9)) * np.uint32(3266489917) >> shift
    good = np.ones((n - 1, 2), bool)
    ends = offs[1:-1]
    good[:, 0] = ~(blank[:-1] & blank[1:])
    good[:-1, 1] = good[:-1, 0] & good[1:, 0]
    good[-1, 1] = False
    inner = ends[(ends > 0) & (ends < n)]
    good[inner - 1] = False  # a pair or triple that starts at a document's last byte
    good[inner[inner > 1] - 2, 1] = False
    flat = good.ravel()
    first = np.zeros(2 * (n - 1) + 1, np.int64)
    np.cumsum(flat, out=first[1:])
    return feats.ravel()[flat], first[2 * np.minimum(offs, n - 1)]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: One row of logits for each hashed subword.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Scores below are rejected.
    level: float
    bits: int

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        feats, first = subwords(data, offs, self.bits)
        n = np.diff(first)
        logits = np.tile(self.bias, (len(n), 1))
        if len(feats):
            if len(n) == 1 and len(feats) > 4 * CHUNK_BYTES:  # a very long text, in pieces
                total = sum(self.table[feats[i : i + CHUNK_BYTES]].sum(0, dtype=np.float64) for i in range(0, len(feats), CHUNK_BYTES))[None]
            else:
                total = np.zeros(logits.shape)
                some = n > 0
                total[some] = np.add.reduceat(self.table[feats], first[:-1][some], axis=0, dtype=np.float64)
            logits = logits + total / np.maximum(1, n)[:, None]
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def _logits(row: tuple[np.ndarray, np.ndarray], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    idx, count = row
    return (count / count.sum()) @ table[idx] + bias if len(idx) else bias


def step(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, row: tuple[np.ndarray, np.ndarray], goal: int, rate: float) -> None:
    """One step of gradient descent on the cross-entropy of one row; the embeddings of its subwords move by a fifth of the rate."""
    idx, count = row
    share = count / count.sum()
    x = emb[idx]
    mean = share @ x
    error = _softmax(mean @ out + bias)
    error[goal] -= 1
    back = out @ error
    out -= rate * np.outer(mean, error)
    bias -= rate * 0.05 * error
    emb[idx] = x - (rate * len(idx)) * share[:, None] * back[None, :] * 0.2


def descent(rows: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, train: np.ndarray, n_names: int, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(logits of each subword, bias) after the epochs over the rows ``train``."""
    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.width, 1 / p.width, (1 << p.bits, p.width))
    out, bias = np.zeros((p.width, n_names)), np.zeros(n_names)
    steps, done = max(1, p.epochs * len(train)), 0
    for _ in range(p.epochs):
        for i in rng.permutation(train):
            if len(rows[i][0]):
                step(emb, out, bias, rows[i], goal[i], p.rate * (1 - done / steps))
            done += 1
    return (emb @ out).astype(np.float32), bias


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], y: list[str], p: LanguageParams = LanguageParams()) -> LanguageModel:
    """The model of (features, counts) rows and their languages.  No rows: a model that names every text ``und``."""
    names = sorted(set(y)) or [UNDETERMINED]
    goal = np.array([names.index(v) for v in y], np.int64)
    part = np.random.default_rng(p.seed).permutation(len(y)) % p.folds
    logits = np.zeros((len(y), len(names)))
    for k in range(p.folds):
        table, bias = descent(rows, goal, np.flatnonzero(part != k), len(names), p)
        for i in np.flatnonzero(part == k):
            logits[i] = _logits(rows[i], table, bias)
    table, bias = descent(rows, goal, np.arange(len(y)), len(names), p)
    check = np.arange(len(y))
    best, loss = 1.0, np.inf
    for t in np.geomspace(0.05, 20, 60):
        if len(check) and (now := -np.log(_softmax(logits / t)[np.arange(len(check)), goal[check]] + 1e-12).mean()) < loss:
            best, loss = float(t), now
    prob = _softmax(logits / best) if len(check) else np.zeros((0, len(names)))
    right = prob.max(1)[prob.argmax(1) == goal[check]] if len(check) else np.zeros(0)
    level = float(np.quantile(right, 1 - p.keep)) if len(right) else 0.0
    return LanguageModel(names, table, bias, best, level, p.bits)


def training_rows(docs: DataFrame, p: LanguageParams) -> DataFrame:
    """(lang, features, counts) of the drawn rows: not held out, with id, text and language.

    Repeated ids may give more rows than were drawn; which of them stay doesn't depend on the order of tasks.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = p.max_train / max(1, usable.count())
    drawn = usable.where(unit_hash(p.seed, F.col("doc_id")) < share).select("lang", "text")
    drawn = bounded_sample(drawn, p.seed, 2 * p.max_train, p.max_bytes, p.max_text)
    bits = p.bits

    def take(batches):
        for b in batches:
            for at, end, data, offs in text_chunks(b.column(1)):
                feats, first = subwords(data, offs, bits)
                got = [np.unique(feats[first[i] : first[i + 1]], return_counts=True) for i in range(end - at)]
                cuts = pa.array(np.cumsum([0, *(len(x) for x, _ in got)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at:end], *(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([g[k] for g in got]) if got else np.zeros(0), pa.int32())) for k in (0, 1))],
                    names=["lang", "features", "counts"],
                )

    return drawn.mapInArrow(take, "lang string, features array<int>, counts array<int>")


def fit(docs: DataFrame, p: LanguageParams = LanguageParams()) -> LanguageModel:
    """The model of ``docs`` (doc_id, text, lang), fitted on the driver to a sample that ``max_train``, ``max_bytes`` and ``max_text`` bound."""
    got = training_rows(docs, p).toArrow()
    lang = got.column("lang").to_pylist()
    parts = [got.column(c).combine_chunks() for c in ("features", "counts")]
    rows = [(np.asarray(parts[0][i].values), np.asarray(parts[1][i].values)) for i in range(len(lang))]
    order = sorted(range(len(rows)), key=lambda i: (lang[i], len(rows[i][0]), rows[i][0].tobytes(), rows[i][1].tobytes()))
    return fit_rows([rows[i] for i in order], [lang[i] for i in order], p)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and rejected (the score is below the calibrated level).

    A null text, and one without a letter, gets ``und`` with score 0 and is rejected.
    Existing columns of these names are replaced; equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits rows of one number per language
    new = ["lang_pred", "score", "rejected"]
    kept = docs.select([F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in new])
    body = F.col(f"`{text}`")
    fed = docs.select([*(F.col(f"`{c}`") for c in kept.columns), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("__letters"), body.alias("__text")])
    schema = widened(kept, ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))

    def run(batches):
        m = shared.value
        names = pa.array([*m.languages, UNDETERMINED])
        for b in batches:
            letters = np.asarray(b.column(b.num_columns - 2).to_numpy(zero_copy_only=False), bool)
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offs in text_chunks(b.column(b.num_columns - 1)):
                prob = m.probabilities(data, offs)
                best.append(prob.argmax(1))
                score.append(prob.max(1))
            best, score = np.where(letters, np.concatenate(best), len(m.languages)), np.where(letters, np.concatenate(score), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], names.take(pa.array(best)), pa.array(score), pa.array((score < m.level) | ~letters)], names=[*b.schema.names[:-2], *new])

    return fed.mapInArrow(run, schema)
