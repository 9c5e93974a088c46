"""Phrase collocations against counting every phrase, with and without hot words, and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagetone.llm import phrases as P

SCHEMA = "lang string, text string"


def by_hand(rows, least=P.LEAST, top=P.TOP, hidden_by=P.HIDDEN_BY):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= hidden_by * a and p in (q[:2], q[1:]) for q, b in f.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(n, seed):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "é", "ÉA", "x\x00", "日本"]
    rows = []
    for _ in range(n):
        body = " ".join(chance.choice(words[:chance.choice([3, 10, 45])]) + chance.choice(["", "", "", ".", ",\t", "\n", "\r\n", " \x0b"])
                        for _ in range(chance.randrange(60)))
        rows.append((chance.choice(["en", "de", None]), body))
    return rows


@pytest.mark.parametrize("part_size", [P.PART_SIZE, 50])
def test_like_counting(spark, monkeypatch, part_size):
    """With a small part size almost every word and pair is hot and dealt by its second and third word."""
    monkeypatch.setattr(P, "PART_SIZE", part_size)
    rows = texts(300, 3)
    got = P.collocations(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows)


def test_top_and_ties(spark):
    rows = texts(200, 5)
    got = P.collocations(spark.createDataFrame(rows, SCHEMA), top=5, least=3)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, least=3, top=5)


@pytest.mark.parametrize("small", [P.SMALL, 8])
def test_quicksort_like_counting(monkeypatch, small):
    monkeypatch.setattr(P, "SMALL", small)
    chance = np.random.default_rng(2)
    suffixes = chance.integers(0, 6, (5000, 3))
    suffixes[:, 0] += 1
    suffixes[suffixes[:, 1] == 0, 2] = 0
    n, partial = chance.integers(1, 4, 5000), np.zeros(5000, dtype=int)
    want = Counter()
    for row, c in zip(suffixes.tolist(), n.tolist()):
        for d in range(1, 4):
            if row[d - 1]:
                want[tuple(row[:d])] += c
    got = P.multikey_counts(list(suffixes.T), n, 30, partial)
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if v >= 30}


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(None, None), ("en", ""), ("en", " \t.,"), ("en", None)] + [("en", "a b")] * 12 + [(None, "a b c")] * 12
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "3 AS phrase", "4 AS words")
    assert sorted(tuple(r) for r in P.collocations(df).collect()) == by_hand(rows)
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_very_long_text(spark):
    rows = [("en", "ab cd ef gh " * 300_000)]
    assert sorted(tuple(r) for r in P.collocations(spark.createDataFrame(rows, SCHEMA)).collect()) == by_hand(rows)
