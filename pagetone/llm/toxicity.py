"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums over all subsequences of three characters within a window of SPAN characters;
each is weighted by DECAY to the power of the length it spans, so inserted and dropped characters cost a little
instead of everything. Strings are the white-space separated tokens of a sentence, and runs of single characters
joined. Landmarks are strings chosen from labelled sentences. Labels belong to whole texts, so training picks a
witness string in each sentence of a toxic text that looks toxic (multiple-instance learning) and learns again.
With landmarks, the decision is linear in a string's subsequences: one table of weights scores any string.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.llm.common import bounded_sample

SPAN, DECAY = 6, 0.6
LANDMARKS, BACKGROUND = 288, 48
#: Bounds of the labelled rows a model is fitted on.
MAX_TOXIC, MAX_CLEAN = 1200, 2000
MAX_STRINGS = 16_000
#: Witnesses that are also shown with inserted characters; training turns, hard negatives of each, weight of the
#: ridge, and the standard errors from which a string of a clean text may still be a witness.
TWISTED = 40
TURNS, HARD, PENALTY, SUSPECT = 6, 3000, 0.5, 8.0
THRESHOLD = 0.7
#: Scores a worker remembers; beyond, it starts anew (memory, not results).
REMEMBERED = 300_000

_ALPHABET = 40
_CODES = _ALPHABET ** 3
_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def strings_of(text: str | None) -> list[str]:
    """Lower-case tokens without punctuation at their ends, and joined runs of three or more single characters."""
    low = (text or "").lower()
    found = [t for t in (x.strip(_EDGE) for x in low.split()) if t]
    found += ["".join(m.group().split()).strip(_EDGE) for m in _SINGLES.finditer(low)]
    return found


def _symbols(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbols, with a boundary on both sides."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)
    symbols = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 12)
    edge = np.full((len(words), 1), 39, dtype=symbols.dtype)
    return np.hstack([edge, symbols, edge]).astype(np.int64)


_STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words grouped by length: (positions in ``words``, subsequence codes, unit-norm weights), one row a word."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, rows in by_length.items():
        for a in range(0, len(rows), max(1, 400_000 // (10 * length + 10))):
            at = np.array(rows[a:a + max(1, 400_000 // (10 * length + 10))])
            s = _symbols([words[i] for i in at])
            n = s.shape[1]
            codes, weights = [], []
            for j, k in _STEPS:
                if k < n:
                    codes.append((s[:, :n - k] * _ALPHABET + s[:, j:n - k + j]) * _ALPHABET + s[:, k:])
                    weights.append(np.full(n - k, DECAY ** (k + 1)))
            if not codes:
                continue
            code, weight = np.hstack(codes), np.concatenate(weights)
            order = np.argsort(code, axis=1, kind="stable")
            code, w = np.take_along_axis(code, order, 1), weight[order]
            new = np.ones(code.shape, dtype=bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            group = np.cumsum(new.ravel()) - 1  # equal codes of a word are one feature
            total = np.bincount(group, weights=w.ravel())
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(at)), code.shape[1])[new.ravel()], weights=total ** 2,
                                       minlength=len(at)))
            yield at, code, w / norm[:, None]


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word with each landmark; ``landmarks`` is codes x landmarks."""
    out = np.zeros((len(words), landmarks.shape[1]), dtype=np.float32)
    for at, code, weight in subsequences(words):
        width = 4096  # bounds the gathered block for very long strings
        step = max(1, width // code.shape[1])
        for r in range(0, len(at), step):
            for c in range(0, code.shape[1], width):
                out[at[r:r + step]] += np.einsum("rs,rsm->rm", weight[r:r + step, c:c + width].astype(np.float32),
                                                 landmarks[code[r:r + step, c:c + width]])
    return out


def _features(words: list[str]) -> np.ndarray:
    out = np.zeros((_CODES, len(words)), dtype=np.float32)
    for at, code, weight in subsequences(words):
        np.add.at(out, (code, np.broadcast_to(at[:, None], code.shape)), weight)
    return out


@dataclass(frozen=True)
class Model:
    """Weight of every subsequence code, and the logistic curve from a text's highest string to its score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps in the primal; last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(30):
        now = y * (x @ w.astype(x.dtype)) < 1
        if active is not None and (now == active).all():
            break
        active = now
        left, right = ridge.copy(), np.zeros(x.shape[1])
        rows = np.flatnonzero(active)
        for a in range(0, len(rows), 4096):  # in blocks: the matrix stays in single precision, the sums do not
            block = x[rows[a:a + 4096]].astype(np.float64)
            weighted = block * weight[rows[a:a + 4096], None]
            left += weighted.T @ block
            right += weighted.T @ y[rows[a:a + 4096]]
        w = np.linalg.solve(left, right)
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with smoothed targets and equal class weights."""
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    c = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
        g = np.array([(c * (p - t) * f).sum(), (c * (p - t)).sum()])
        h = c * p * (1 - p)
        hess = np.array([[(h * f * f).sum(), (h * f).sum()], [(h * f).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit_rows(texts: list[str | None], labels: list[int]) -> Model:
    """Fit on these rows. Without rows of both classes every text scores 0.5."""
    one: dict[str, str] = {}  # a string is held once, however often it occurs
    sentences = [[[one.setdefault(w, w) for w in strings_of(s)] for s in re.split(r"[.!?\n]+", t or "")] for t in texts]
    bags = [{w for s in doc for w in s} for doc in sentences]
    toxic = [i for i, y in enumerate(labels) if y == 1]
    clean = [i for i, y in enumerate(labels) if y == 0]
    nothing = Model(np.zeros(_CODES, np.float32), 0.0, 0.0, 0.0)
    if not toxic or not clean:
        return nothing
    seen_t, seen_c = Counter(w for i in toxic for w in bags[i]), Counter(w for i in clean for w in bags[i])
    if not seen_t or not seen_c:
        return nothing

    def strength(w: str) -> float:  # how much more often in toxic texts, in standard errors
        p, q = seen_t[w] / len(toxic), seen_c[w] / len(clean)
        mean = (seen_t[w] + seen_c[w] + 1) / (len(toxic) + len(clean) + 2)
        return (p - q) / (mean * (1 - mean) * (1 / len(toxic) + 1 / len(clean))) ** 0.5

    ranked = sorted(seen_t, key=lambda w: (-strength(w), w))
    marks = [w for w in ranked if len(w) > 1 and strength(w) > 0][:LANDMARKS - BACKGROUND]
    marks += [w for w, _ in sorted(seen_c.items(), key=lambda x: (-x[1], x[0])) if w not in set(marks)][:BACKGROUND]
    phi = _features(marks)
    gram = phi.T @ phi
    values, basis = np.linalg.eigh(gram.astype(np.float64))
    keep = values > 1e-4
    nystrom = basis[:, keep] / np.sqrt(values[keep])

    # Strings of clean texts are negatives: the frequent ones, an even spread of the others, and in each turn
    # those that score highest by then. In toxic texts only witnesses are used.
    # A string much more frequent in toxic texts stays a possible witness even if a clean text holds it.
    suspect = {w for w in seen_t if w in seen_c and strength(w) > SUSPECT}
    clean_words = sorted(set(seen_c) - suspect)
    frequent = [w for w in sorted(seen_c, key=lambda w: (-seen_c[w], w)) if w not in suspect][:2000]
    negatives = sorted(set(clean_words[::max(1, len(clean_words) // MAX_STRINGS)]) | set(frequent))
    z_neg = (kernel(negatives, phi) @ nystrom).astype(np.float32)
    toxic_words = sorted(set(seen_t) - set(clean_words))
    if not toxic_words:
        return nothing
    place = {w: k for k, w in enumerate(toxic_words)}
    score = np.array([strength(w) for w in toxic_words])
    known_negatives = set(negatives)
    for turn in range(TURNS):
        chosen: Counter = Counter()
        for i in toxic:
            tops = []
            for s in sentences[i]:
                best = max((w for w in s if w in place), key=lambda w: (score[place[w]], w), default=None)
                if best is not None:
                    tops.append((score[place[best]], best))
            tops.sort(reverse=True)
            # the best sentence in any case, and every other one that looks toxic by now
            floor = max(5.0, 0.5 * tops[0][0]) if turn == 0 and tops else 0.5
            chosen.update({w for k, (v, w) in enumerate(tops) if k == 0 or v > floor})
        if not chosen:
            return nothing
        pos = sorted(chosen)
        # the best supported witnesses also with a character put in between, at one place or at all
        twisted = [(v, max(3.0, n ** 1.5 / 100))
                   for w, n in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:TWISTED] if n >= 3 and len(w) >= 4
                   for v in (*[w[:k] + c + w[k:] for k in range(1, len(w)) for c in ("x", "-")], "-".join(w), ".".join(w))]
        x = np.vstack([(kernel(pos, phi) @ nystrom).astype(np.float32), z_neg,
                       (kernel([v for v, _ in twisted], phi) @ nystrom).astype(np.float32)])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(negatives)), np.ones(len(twisted))])
        # a witness counts by its texts; one that a single text names counts little
        weight = np.concatenate([np.array([chosen[w] ** 1.5 / 2 for w in pos]), np.ones(len(negatives)), np.array([n for _, n in twisted])])
        solution = _svm(x, y, weight, penalty=PENALTY)
        table = (phi @ (nystrom @ solution[:-1])).astype(np.float32)
        score = _values(table, float(solution[-1]), toxic_words)
        if turn < TURNS - 1:
            values = _values(table, float(solution[-1]), clean_words)
            hard = [clean_words[k] for k in np.argsort(-values, kind="stable")[:HARD] if clean_words[k] not in known_negatives]
            known_negatives.update(hard)
            negatives += hard
            z_neg = np.vstack([z_neg, (kernel(hard, phi) @ nystrom).astype(np.float32)])
    table = (phi @ (nystrom @ solution[:-1])).astype(np.float32)
    model = Model(table, float(solution[-1]), 1.0, 0.0)
    tops = _tops(model, [" ".join(sorted(b)) for b in bags], {})
    rows = [i for i in range(len(texts)) if labels[i] in (0, 1)]
    slope, offset = _logistic(tops[rows], np.array([labels[i] for i in rows], float))
    return Model(table, float(solution[-1]), slope, offset)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", max_toxic: int = MAX_TOXIC,
        max_clean: int = MAX_CLEAN) -> Model:
    """Fit on about ``max_toxic`` and ``max_clean`` labelled rows chosen by hash (all rows of a class, if fewer)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    kept = []
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = bounded_sample(rows.filter(F.col("label") == value), F.col("text"), most)
        kept += [(r["text"] or "", value) for r in part.collect()]
    kept.sort()
    return fit_rows([t for t, _ in kept], [v for _, v in kept])


_LOWEST = -4.0


def _values(table: np.ndarray, bias: float, words: list[str]) -> np.ndarray:
    """Decision value of each string: its weighted subsequences against the table."""
    values = np.full(len(words), bias)
    for at, code, weight in subsequences(words):
        values[at] += (table[code] * weight).sum(axis=1)
    return values


def _tops(model: Model, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
    """Highest decision value among the strings of each text; a low constant for texts without strings."""
    found = [strings_of(t) for t in texts]
    missing = list({w for ws in found for w in ws if w not in known})
    if missing:
        values = _values(model.weights, model.bias, missing)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing_all = list({w for ws in found for w in ws})
            if len(missing_all) > len(missing):
                return _tops(model, texts, known)
        known.update(zip(missing, values.tolist(), strict=True))
    return np.array([max((known[w] for w in ws), default=_LOWEST) for ws in found], dtype=np.float64)


def toxicity_score(model: Model, text: Column, spark) -> Column:
    """Score of each whole text, 0 to 1. Null and empty texts score like a text without any suspicious string."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        m = shared.value
        for batch in batches:
            texts = batch.tolist()
            tops = [_tops(m, texts[i:i + 256], known) for i in range(0, len(texts), 256)]
            f = np.concatenate(tops) if tops else np.array([], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(m.slope * f + m.offset, -35, 35))), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "label", score_col: str = "score",
             threshold: float = THRESHOLD, predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score and a prediction (1 from ``threshold`` on).

    One pass over the whole texts, no shuffle. What is broadcast is one table of 64**3 weights. Rows without
    a label, or with another label than 0 and 1, teach nothing. Columns named like the new ones are replaced.
    """
    model = fit(labelled, text, label)
    scored = docs.withColumn(score_col, toxicity_score(model, F.col(f"`{text}`"), docs.sparkSession))
    return scored.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
