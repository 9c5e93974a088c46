"""MinHash near-duplicates against all pairs, on the whole table and on odd rows."""

import random
from collections import defaultdict

import pytest

from pagetone.llm import minhash as M
from pagetone.llm.queries import op11_minhash

SCHEMA = "doc_id bigint, text string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def by_hand(rows, percent=85):
    """(doc_id, n, component) per row, by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for found in holders.values():
        for x, i in enumerate(found):
            for j in found[x + 1:]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(s), least.get(root(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))),
                  key=str)


def collected(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


def edited(words, chance, edits):
    words = list(words)
    for _ in range(edits):
        at = chance.randrange(len(words))
        words[at:at + chance.randrange(2)] = [f"x{chance.randrange(10**6)}"] * chance.randrange(2)
    return words


def families(n_families, copies, seed, words=120):
    """Texts with copies of many similarities around the limit: edited, cut, appended, exact."""
    chance = random.Random(seed)
    rows = []
    for _ in range(n_families):
        base = [f"w{chance.randrange(2000)}" for _ in range(words)]
        rows.append(" ".join(base))
        for _ in range(copies):
            kind = chance.randrange(4)
            text = (edited(base, chance, chance.randrange(1, 8)) if kind == 0 else base[chance.randrange(25):] if kind == 1
                    else base + [f"y{chance.randrange(10**6)}" for _ in range(chance.randrange(25))] if kind == 2 else base)
            rows.append(" ".join(text).upper() if chance.random() < 0.3 else " \t".join(text))
    chance.shuffle(rows)
    return list(enumerate(rows))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_minhash(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collected(got) == by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_recall_around_the_limit(spark):
    rows = families(60, 8, 5)
    assert collected(M.minhash_components(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


@pytest.mark.parametrize("chunk", [M.CHUNK, 50])
def test_one_large_family_over_many_ranges(spark, monkeypatch, chunk):
    """Every range is one region and is met in chunks; links are around the limit, so components are many."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    rows = families(1, 400, 9)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert collected(M.minhash_components(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " tail"),
            (None, long), (None, "alone without a key at all"), (9, "same text here twice now"), (9, "same text here twice now"),
            (9, "another text under that same id"), (10, "a b c d e f"), (11, "a b c d e f"), (12, "É è à ù ç")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS node", "3 AS hash", "4 AS n", "5 AS set")
    assert collected(M.minhash_components(df)) == by_hand(rows)
    assert M.minhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tests_before_confirmation_lose_nothing():
    import numpy as np

    chance = np.random.default_rng(3)
    for _ in range(200):
        a = chance.integers(0, 1 << 63, chance.integers(1, 300)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: int(len(a) * chance.uniform(0.8, 1))], chance.integers(0, 1 << 63, chance.integers(0, 20)).astype(np.uint64)]))
        a = np.unique(a)
        n = np.array([len(a), len(b)])
        parity = np.array([M.parities(a), M.parities(b)]).view(np.uint64)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(M._near(n, parity, 0, np.array([1]), 85)) == 1
