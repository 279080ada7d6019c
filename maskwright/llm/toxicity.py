"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and character n-grams learns from texts
confirmed toxic and from texts whose label isn't looked at. The share of toxic
texts among the latter (the class prior) corrects the risk, and where the
estimated risk of the clean class turns negative its gradient is reversed. What
is called toxic is set on texts of both kinds that the fit hasn't seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, remainder, utf8
from maskwright.llm.subwords import subword_counts
from maskwright.llm.training import hashed_sample, labels_of

BUCKETS = 1 << 18
#: One in APART documents only sets the bias, whichever sample it is in; samples smaller than LEAST are used for both.
APART, LEAST = 3, 50
#: Bounds of the training sample: texts confirmed toxic, and unlabelled ones.
POSITIVES, UNLABELLED = 1500, 3500
#: Least number of steps, also for small samples; step size, decay, texts of a step.
STEPS, RATE, DECAY, POSITIVE_BATCH, BATCH, SEED = 600, 0.3, 1e-4, 32, 128, 0


class Model:
    """weight: by bucket, with the inverse document frequency in it; idf: for the norm."""

    def __init__(self, weight: np.ndarray, idf: np.ndarray, bias: float):
        self.weight, self.idf, self.bias = weight.astype(np.float32), idf.astype(np.float32), float(bias)

    def score(self, texts: list[bytes]) -> list[float]:
        out = []
        for k, c in subword_counts(texts, BUCKETS, True):
            x = np.log1p(c) * self.idf[k]
            z = self.bias + float(x @ self.weight[k]) / max(1e-9, float(np.sqrt(x @ x)))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The score with the least balanced error: the share of toxic texts below it and that of clean texts from it on.

    With the class prior p, unlabelled texts from a score on are p of the toxic ones and 1 - p of the clean ones, so
    balanced error is (missed + called - p) / (1 - p), and the prior doesn't move its least place.
    """
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    missed = np.searchsorted(positive, positive) / len(positive)
    called = 1 - np.searchsorted(unlabelled, positive) / len(unlabelled)
    at = positive[np.argmin(missed + called)]
    below = np.concatenate([positive, unlabelled])
    below = below[below < at]
    return float((at + below.max()) / 2 if len(below) else at)


def fit(positive: list, unlabelled: list, prior: float) -> Model:
    """positive, unlabelled: (whether it is set apart, buckets, counts) of texts. Without either, every text scores the prior."""
    df = np.zeros(BUCKETS)
    for _, k, _ in unlabelled:
        df[k] += 1
    idf = np.log((len(unlabelled) + 1) / (df + 1)) + 1e-3
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not positive or not unlabelled:
        return Model(np.zeros(BUCKETS), idf, np.log(prior / (1 - prior)))

    def scaled(rows):
        out = ([], [])
        for apart, k, c in rows:
            x = np.log1p(c.astype(np.float32)) * idf[k]
            out[apart].append((k, (x / max(1e-9, np.sqrt(x @ x))).astype(np.float32)))
        return out if len(rows) >= LEAST and all(out) else (out[0] + out[1],) * 2

    (p, p_apart), (u, u_apart) = scaled(positive), scaled(unlabelled)
    w, seen, bias, rng = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), -1.0, np.random.default_rng(SEED)
    mean, passes = np.zeros(BUCKETS), -(-STEPS // -(-len(u) // BATCH))
    out = lambda rows: np.array([w[k] @ x + bias for k, x in rows])
    for n in range(passes):
        order = rng.permutation(len(u))
        for at in range(0, len(order), BATCH):
            us, ps = [u[i] for i in order[at : at + BATCH]], [p[i] for i in rng.integers(0, len(p), POSITIVE_BATCH)]
            fu, fp = out(us), out(ps)
            clean_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if clean_risk >= 0:
                gu, gp = _sigmoid(fu) / len(us), np.full(len(ps), -prior / len(ps))
            else:
                gu, gp = -_sigmoid(fu) / len(us), prior * _sigmoid(fp) / len(ps)
            keys = np.concatenate([k for k, _ in us + ps])
            grads = np.concatenate([x * g for (_, x), g in zip(us + ps, np.concatenate([gu, gp]), strict=True)])
            hit, inverse = np.unique(keys, return_inverse=True)
            g = np.bincount(inverse, grads) + DECAY * w[hit]
            seen[hit] += g * g
            w[hit] -= RATE * g / np.sqrt(seen[hit])
            bias -= 0.3 * RATE * (gu.sum() + gp.sum())
        if n >= passes // 2:
            mean += w / (passes - passes // 2)
    w, bias = mean, 0.0  # the mean of the later passes
    return Model(w, idf, -_cut(out(p_apart), out(u_apart)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a sample in the order of a hash of the ids: confirmed toxic texts, and texts of any label, of the folds to learn from. Labels of texts that docs doesn't hold (any more) count for nothing."""
    ids = docs.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = labels_of(labels, "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), "y").join(ids, "doc_id", "left_semi")
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    order, apart = (F.xxhash64("doc_id"), "doc_id"), (remainder("doc_id", APART) == 0).cast("int").alias("y")
    positive = known.filter("y = 1").select("doc_id", apart).orderBy(*order).limit(POSITIVES)
    unlabelled = ids.select("doc_id", apart).orderBy(*order).limit(UNLABELLED)
    p, u = (hashed_sample(docs, chosen, BUCKETS, True) for chosen in (positive, unlabelled))
    return fit(p, u, (toxic or 0) / n if n else 0.0)


def score_documents(docs: DataFrame, model, threshold: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null texts score as empty ones; repeated rows score alike."""
    configure(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    parts, made = docs.sparkSession.sparkContext.broadcast(vars(model)), type(model)

    def run(batches):
        m = made.__new__(made)
        vars(m).update(parts.value)
        for b in batches:
            s = np.array(m.score([t.as_py() for t in b.column(2)]), np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_column, "held_out", "score", "predicted"])

    rows = docs.select(id_column, (remainder(id_column, 5) == 0).alias("held_out"), utf8(text_column).alias("text"))
    return mapped(rows, run, f"`{id_column}` {kind}, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, model, threshold: float, keep: int, text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose predicted class is `keep`; nothing is shuffled."""
    configure(docs.sparkSession)
    parts, made, at = docs.sparkSession.sparkContext.broadcast(vars(model)), type(model), docs.columns.index(text_column)

    def run(batches):
        m = made.__new__(made)
        vars(m).update(parts.value)
        for b in batches:
            s = np.array(m.score([(t.as_py() or "").encode() for t in b.column(at)]), np.float64)
            yield b.filter(pa.array((s >= threshold).astype(np.int32) == keep))

    return mapped(docs, run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Trains on docs and labels and scores every document. No labels give every text the score of the least prior."""
    return score_documents(docs, train(docs, labels), threshold)


