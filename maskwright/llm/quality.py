"""Quality by supervised subword embeddings: vectors of hashed words and character n-grams are learnt by stochastic gradient descent, averaged for a document and put through a softmax."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.subwords import cut_texts, subword_buckets
from maskwright.llm.toxicity import score_documents
from maskwright.llm.training import hashed_sample, labels_of

BUCKETS, WIDTH = 1 << 17, 8
#: Bound of the labelled sample; passes, documents of a step, step size.
SAMPLE, EPOCHS, BATCH, RATE, SEED = 3500, 12, 32, 0.1, 0
#: One in APART sampled texts only sets the bias: there the score is CUT a third of the way from the worst bad to the worst good texts (quantiles of the two classes).
APART, CUT, BAD, GOOD = 5, 0.3, 0.95, 0.01


class Model:
    """vectors: an embedding by bucket; output: its two classes; the score is the softmax of class 1."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        # the mean is linear, so the classes' difference can be taken before it
        self.slope = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, texts: list[bytes]) -> list[float]:
        n, z = np.zeros(len(texts)), np.zeros(len(texts))
        for own, part in cut_texts(texts):
            bucket, at = subword_buckets(part, BUCKETS, False)
            np.add.at(n, own, np.bincount(at, minlength=len(part))[: len(part)])
            np.add.at(z, own, np.bincount(at, self.slope[bucket], minlength=len(part))[: len(part)])
        return (1 / (1 + np.exp(-np.clip(z / np.maximum(n, 1) + self.bias, -30, 30)))).tolist()


def fit(rows: list) -> Model:
    """rows: (y, buckets, counts). None leaves every score at one half."""
    rng = np.random.default_rng(SEED)
    vectors, output, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)), rng.normal(0, 1, (WIDTH, 2)), np.zeros(2)
    seen, seen_output = np.full(BUCKETS, 1e-8), np.full(output.shape, 1e-8)
    rows = [(y, k, (c / c.sum()).astype(np.float32)) for y, k, c in rows if len(k)]
    rows, apart = (rows, []) if len(rows) < 20 * APART else ([r for i, r in enumerate(rows) if i % APART], rows[::APART])
    often = np.bincount([y for y, _, _ in rows], minlength=2)
    weigh = len(rows) / (2 * np.maximum(often, 1))  # either class weighs alike
    for _ in range(EPOCHS if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            y = np.array([r[0] for r in part])
            mean = np.stack([x @ vectors[k] for _, k, x in part])
            z = mean @ output + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weigh[y][:, None] / len(y)
            back = p @ output.T
            keys = np.concatenate([k for _, k, _ in part])
            hit, inverse = np.unique(keys, return_inverse=True)
            share = np.concatenate([x for _, _, x in part])
            who = np.repeat(np.arange(len(part)), [len(k) for _, k, _ in part])
            g = np.stack([np.bincount(inverse, share * back[who, d]) for d in range(WIDTH)], 1)
            seen[hit] += (g * g).mean(1)
            vectors[hit] -= RATE * g / np.sqrt(seen[hit])[:, None]
            go = mean.T @ p
            seen_output += go * go
            output -= RATE * go / np.sqrt(seen_output)
            bias -= RATE * p.sum(0)
    model = Model(vectors, output, bias)
    if len({y for y, _, _ in apart}) == 2:
        z = np.array([x @ model.slope[k] + model.bias for _, k, x in apart])
        y = np.array([y for y, _, _ in apart])
        low, high = np.quantile(z[y == 0], BAD), np.quantile(z[y == 1], GOOD)
        model.bias += np.log(CUT / (1 - CUT)) - ((2 * low + high) / 3 if low < high else (low + high) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the first SAMPLE labelled documents, in the order of a hash of their ids."""
    chosen = labels_of(labels, "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return fit(hashed_sample(docs, chosen, BUCKETS, False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Null and empty texts score by the bias alone; no labels give one half."""
    return score_documents(docs, train(docs, labels), threshold)
