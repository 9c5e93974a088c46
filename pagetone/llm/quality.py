"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are trigrams of character classes and a few repetition measures, weighted by tf-idf; a truncated singular
value decomposition of labelled rows gives the latent space. The labelled vectors are broadcast (bounded number),
every document is compared with all of them in exact blocked cosine products, and its nearest neighbours vote
with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.llm.common import bounded_sample

#: Bound of the labelled rows a model is fitted on (and broadcasts), latent dimensions, voters.
MAX_LABELLED, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 24, 15, 8.0
THRESHOLD = 0.3
REFERENCE_BLOCK = 1024
ITERATIONS = 12

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|",
           "&", "%$#*@^~", "\"'`()[]{}", "-_/\\", "<>=+:;"]
_CLASS = np.full(256, 15, dtype=np.uint16)  # 15: control characters
_CLASS[128:] = 0  # bytes of letters beyond ASCII count as lower-case letters
for _k, _chars in enumerate(_GROUPS):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_TRIGRAMS = 16 ** 3
_EXTRA = 4
TERMS = _TRIGRAMS + _EXTRA


def _terms(text: str | None) -> np.ndarray:
    """Square roots of relative term frequencies of the whole text; zero for an empty one."""
    out = np.zeros(TERMS, dtype=np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return out
    c = _CLASS[raw]
    if len(c) >= 3:
        out[:_TRIGRAMS] = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=_TRIGRAMS) / (len(c) - 2)
    tokens = text.split()
    n = len(tokens)
    if n > 1:
        pairs = n - 1
        same = sum(map(str.__eq__, tokens, tokens[1:]))
        out[_TRIGRAMS] = same / pairs
        out[_TRIGRAMS + 1] = 1 - len(set(zip(tokens, tokens[1:], strict=False))) / pairs
        lines = text.split("\n")
        out[_TRIGRAMS + 2] = 1 - len(set(lines)) / len(lines)
        out[_TRIGRAMS + 3] = 1.0 if n < 8 else 0.0
    return np.sqrt(out)


@dataclass(frozen=True)
class Model:
    """Projection (terms x dims, idf included), labelled unit vectors, their labels, and the share of ones."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def fit_rows(texts: list[str | None], labels: list[int], dims: int = DIMENSIONS) -> Model:
    y = np.array(labels, dtype=np.float32)
    if not len(y):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.array([_terms(t) for t in texts])
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))) + 0.1
    x *= idf.astype(np.float32)
    # Leading right singular vectors by subspace iteration from a fixed start: no table of terms by terms.
    basis = np.random.default_rng(0).normal(size=(TERMS, dims + 8)).astype(np.float32)
    for _ in range(ITERATIONS):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    basis = basis @ turn.T[:, :max(1, min(dims, len(y)))]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])  # one sign for each axis
    projection = (basis * idf[:, None]).astype(np.float32)
    return Model(projection, _unit(x @ basis).astype(np.float32), y, float(y.mean()))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", at_most: int = MAX_LABELLED) -> Model:
    """Fit on about ``at_most`` labelled rows chosen by hash (all rows, if fewer). Rows without a label are left out."""
    rows = bounded_sample(labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
                          .filter("label in (0, 1)"), F.col("text"), at_most)
    kept = sorted(((r["text"] or "", r["label"]) for r in rows.collect()))
    return fit_rows([t for t, _ in kept], [v for _, v in kept])


def vote(model: Model, texts: list[str | None], k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of ones among the k nearest labelled vectors of each text."""
    out = np.full(len(texts), model.prior)
    if not len(model.labels) or not texts:
        return out
    vectors = _unit(np.array([_terms(t) for t in texts]) @ model.projection).astype(np.float32)
    best_s = np.full((len(texts), 0), -2.0, dtype=np.float32)
    best_y = np.zeros((len(texts), 0), dtype=np.float32)
    for a in range(0, len(model.labels), REFERENCE_BLOCK):
        sims = np.hstack([best_s, vectors @ model.vectors[a:a + REFERENCE_BLOCK].T])
        ys = np.hstack([best_y, np.broadcast_to(model.labels[a:a + REFERENCE_BLOCK], (len(texts), len(
            model.labels[a:a + REFERENCE_BLOCK])))])
        if sims.shape[1] > k:
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            sims, ys = np.take_along_axis(sims, top, 1), np.take_along_axis(ys, top, 1)
        best_s, best_y = sims, ys
    weight = np.maximum(best_s.astype(np.float64), 0) ** SHARPNESS
    total = weight.sum(axis=1)
    seen = (total > 0) & vectors.any(axis=1)
    out[seen] = (weight * best_y).sum(axis=1)[seen] / total[seen]
    return np.clip(out, 0.0, 1.0)


def quality_score(model: Model, text: Column, spark) -> Column:
    """Score of each whole text, 0 to 1. Null and empty texts, which have no vector, get the share of ones."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([vote(shared.value, texts[i:i + 512]) for i in range(0, len(texts), 512)])
                            if texts else np.array([], dtype=float), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "label", score_col: str = "score",
             threshold: float = THRESHOLD, predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score and a prediction (1 from ``threshold`` on). No labelled rows: every score is 0.5.

    Documents stay where they are: one pass over the text, nothing is shuffled. What is broadcast is bounded by
    MAX_LABELLED vectors of DIMENSIONS numbers. Columns named like the new ones are replaced.
    """
    model = fit(labelled, text, label)
    scored = docs.withColumn(score_col, quality_score(model, F.col(f"`{text}`"), docs.sparkSession))
    return scored.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
