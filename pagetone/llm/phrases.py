"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word occurrence starts a suffix: up to ``LONGEST`` words, cut at the end of its piece. Suffixes are routed by
their leading words, so one task holds all suffixes that begin alike, and sorted there by multikey quicksort: a
partition is split by the word at one depth into less, equal and greater; the size of an equal partition is the
count of a phrase, and it is sorted on at the next depth. Partitions lighter than the least count are abandoned
unsorted, as no phrase in them can be frequent.

Suffixes that are equal within a batch of texts travel once, with their number. A leading word with more suffixes
than a task should hold is dealt by the second word too, such a pair by the third: counts of these prefixes are
summed up over their parts, which are never abandoned for being small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetone.session import cut_lineage

#: Production parameters: longest phrase, least count, share (in percent) of a longer phrase that hides a shorter one,
#: and phrases reported per language.
LONGEST, LEAST, HIDDEN_BY, TOP = 3, 10, 50, 2000
#: Leading words and pairs are counted in this many buckets, and dealt into one part per PART_SIZE suffixes.
ROUTE_BUCKETS, ROUTE_SLICE, PART_SIZE = 1 << 18, 1 << 12, 1 << 20
#: Bytes of text that are cut together, suffixes that are sorted together, and partitions sorted at once.
BATCH_BYTES, SORTED_AT_ONCE, SMALL = 1 << 23, 1 << 19, 1 << 14

# Ends of pieces, and the blank between words.
_TO_BREAK = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_BREAK = b"\n"
UNKNOWN = "und"


# --- texts to suffixes ----------------------------------------------------------------------------

def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of all words in order (0 ends a piece) and the words by number."""
    words = b"\n".join(texts).lower().translate(_TO_BREAK).replace(_BREAK, b" \n ").split(b" ")
    number = {_BREAK: 0}
    for w in words:
        if w not in number:
            number[w] = len(number)
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    blank = number.get(b"")
    if blank is not None:
        ids = ids[ids != blank]
    return ids, list(number)


def _texts_by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    langs = batch.column("lang").to_pylist()
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, batch.column("text").to_pylist()):
        if text:
            found.setdefault(lang, []).append(text)
    yield from found.items()


def _small_batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size in bytes; a single longer text stays whole."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * 1_000_003 + second * 7_919 + 12_345) >> 3


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of leading words (first half) and leading pairs (second half) by bucket of their hash."""
    total = np.zeros(2 * ROUTE_BUCKETS, dtype=np.int64)
    for batch in _small_batches(batches):
        for _, texts in _texts_by_language(batch):
            ids, words = _word_ids(texts)
            h = _hash(words)[ids]
            start = ids > 0
            total[:ROUTE_BUCKETS] += np.bincount(h[start] % ROUTE_BUCKETS, minlength=ROUTE_BUCKETS)
            pair = start[:-1] & start[1:]
            total[ROUTE_BUCKETS:] += np.bincount(_pair_hash(h[:-1][pair], h[1:][pair]) % ROUTE_BUCKETS, minlength=ROUTE_BUCKETS)
    slices = total.reshape(-1, ROUTE_SLICE)
    for i in np.flatnonzero(slices.any(axis=1)):
        yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([slices[i].astype("<i8").tobytes()])})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(x, dtype="<i8")
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()),
                                      "counts": pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())})


def prefix_counts(texts: DataFrame) -> np.ndarray:
    """Counts of leading words and pairs by bucket, over all texts: a fixed number of them, whatever the data.

    They only route suffixes; words that share a bucket are routed alike.
    """
    schema = "slice int, counts binary"
    found = np.zeros((2 * ROUTE_BUCKETS // ROUTE_SLICE, ROUTE_SLICE), dtype=np.int64)
    for r in texts.mapInArrow(_prefix_counts, schema).repartition("slice").mapInArrow(_added, schema).collect():
        found[r["slice"]] = np.frombuffer(r["counts"], dtype="<i8")
    return found.ravel()


_SUFFIXES = "lang string, word binary, route int, rest binary, n array<int>"


def _suffixes(parts):
    """(lang, first word, route, the second and third words of all its suffixes, their numbers) of each batch of texts.

    ``route`` is 0, or positive where the second word decides it (a hot first word), or negative where the third
    does too (a hot pair).
    """
    types = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("route", pa.int32()), ("rest", pa.binary()),
                       ("n", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word, of_pair = parts.value
        for batch in _small_batches(batches):
            for lang, texts in _texts_by_language(batch):
                ids, words = _word_ids(texts)
                ids = np.append(ids, [0, 0, 0])
                size = len(words) + 1
                at = np.flatnonzero(ids)
                if not len(at):
                    continue
                second = ids[at + 1]
                key, n = np.unique((ids[at] * size + second) * size + np.where(second > 0, ids[at + 2], 0), return_counts=True)
                first, second, third = key // (size * size), key // size % size, key % size
                h = _hash(words)
                of_first = of_word[h[first] % ROUTE_BUCKETS]
                of_both = of_pair[_pair_hash(h[first], h[second]) % ROUTE_BUCKETS]
                route = np.where(of_first > 1, 1 + h[second] % of_first, 0)
                route = np.where((of_first > 1) & (of_both > 1) & (second > 0), -1 - (h[second] + h[third]) % of_both, route)
                order = np.lexsort((route, first))
                first, second, third, route, n = first[order], second[order], third[order], route[order], n[order]
                starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (route[1:] != route[:-1])])
                names = pa.array([b"", *words[1:]], pa.binary())
                rest = pc.binary_join_element_wise(names.take(pa.array(second)), names.take(pa.array(third)), pa.scalar(b" ", pa.binary()))
                ends = pa.array(np.append(starts, len(first)).astype(np.int32))
                joined = pc.binary_join(pa.ListArray.from_arrays(ends, rest), pa.scalar(b" ", pa.binary()))
                counts = pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(starts), pa.string()), names.take(pa.array(first[starts])),
                     pa.array(route[starts].astype(np.int32)), joined, counts], schema=types)

    return run


# --- multikey three-way quicksort -----------------------------------------------------------------

def multikey_counts(columns: list[np.ndarray], n: np.ndarray, least: int, partial: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(word numbers, count) of every prefix that occurs at least ``least`` times.

    ``columns[d]`` holds the word numbers at depth d (0: the suffix has ended), ``n`` how often each suffix occurs. Prefixes
    of up to ``partial`` words have more suffixes elsewhere, so they come out whatever their count here.
    """
    found: list[tuple[tuple[int, ...], int]] = []

    def light(p: np.ndarray, depth: int) -> bool:
        return n[p].sum() < least and not (partial[p] > depth).any()

    def equal_run(p: np.ndarray, depth: int, count: int) -> None:
        found.append((tuple(int(c[p[0]]) for c in columns[:depth + 1]), count))
        if depth + 1 < len(columns):
            stack.append((p, depth + 1))

    stack = [(np.arange(len(n)), 0)]
    while stack:
        p, depth = stack.pop()
        if not len(p) or light(p, depth):
            continue
        key = columns[depth][p]
        if len(p) <= SMALL:  # small partitions are split into all their equal runs at once
            order = np.argsort(key, kind="stable")
            p, key = p[order], key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            weight = np.add.reduceat(n[p], starts)
            stays = (weight >= least) | np.logical_or.reduceat(partial[p] > depth, starts)
            ends = np.append(starts[1:], len(p))
            for i in np.flatnonzero(stays & (key[starts] > 0)):
                equal_run(p[starts[i]:ends[i]], depth, int(weight[i]))
            continue
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        stack += [(p[key < pivot], depth), (p[key > pivot], depth)]
        equal = p[key == pivot]
        if pivot > 0 and not light(equal, depth):
            equal_run(equal, depth, int(n[equal].sum()))
    return found


_COUNTS = "lang string, phrase string, words int, n bigint"


def _sorted_counts(least: int):
    """Counts of frequent prefixes among sorted rows of ``_SUFFIXES``; an empty phrase counts all words."""
    types = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def counted(lang: str, rows: list[tuple[bytes, int, bytes, np.ndarray]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {b"": 0}
        for word, *_ in rows:
            number.setdefault(word, len(number))
        rest = b" ".join(r[2] for r in rows).split(b" ")
        for w in rest:
            if w not in number:
                number[w] = len(number)
        later = np.fromiter(map(number.__getitem__, rest), dtype=np.int32, count=len(rest))
        sizes = [len(r[3]) for r in rows]
        first = np.repeat(np.array([number[r[0]] for r in rows], dtype=np.int32), sizes)
        n = np.concatenate([r[3] for r in rows]).astype(np.int64)
        partial = np.repeat(np.array([0 if r[1] == 0 else 1 if r[1] > 0 else 2 for r in rows]), sizes)
        names = list(number)
        found = multikey_counts([first, later[0::2], later[1::2]], n, least, partial)
        phrases = [b" ".join(names[i] for i in w) for w, _ in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(found) + 1), pa.string()), pa.array([*phrases, b""], pa.binary()).cast(pa.string()),
             pa.array([len(w) for w, _ in found] + [0], pa.int32()), pa.array([c for _, c in found] + [int(n.sum())], pa.int64())], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, rows, held = None, [], 0
        for batch in batches:
            counts = batch.column("n")
            offsets, values = counts.offsets.to_numpy(), counts.values.to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("lang", "word", "route", "rest")]
            for i, (l, word, route, rest) in enumerate(zip(*columns)):
                if rows and (l != lang or (held >= SORTED_AT_ONCE and (word, route) != rows[-1][:2])):
                    yield counted(lang, rows)
                    rows, held = [], 0
                lang = l
                rows.append((word, route, rest, values[offsets[i]:offsets[i + 1]].copy()))
                held += int(offsets[i + 1] - offsets[i])
        if rows:
            yield counted(lang, rows)

    return run


# --- phrases --------------------------------------------------------------------------------------

def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): words and phrases of up to three words with ``n >= least``, and n of all words as ''."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    counts = prefix_counts(texts)
    parts = spark.sparkContext.broadcast(np.maximum(1, -(-counts // PART_SIZE)).reshape(2, -1))
    routed = (texts.mapInArrow(_suffixes(parts), _SUFFIXES).repartition("lang", "word", "route")
              .sortWithinPartitions("lang", "word", "route"))
    found = routed.mapInArrow(_sorted_counts(least), _COUNTS)
    return (found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
            .filter((F.col("n") >= least) | (F.col("words") == 0)))


def _part(phrase: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), start, size), " ")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, hidden_by: int = HIDDEN_BY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    A null lang is ``und``, a null text empty. Words are cut at blanks and tabs, pieces at sentence marks and line ends. The
    score of a cut is floor(10**6 a**2 / (l r)) in 38-digit decimals (exact up to counts of 10**15); the lowest cut counts, ties to
    the shorter first part. Phrases inside a longer one that has ``hidden_by`` percent of their count are dropped.
    Ties of score are broken by count, then by the phrase's bytes. Repeated rows count again; other columns are
    ignored; no rows give no rows.
    """
    counts = cut_lineage(phrase_counts(docs.select("lang", "text"), least))
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", _part(F.col("phrase"), 1, F.col("k")).alias("left"), _part(F.col("phrase"), F.col("k") + 1, F.lit(LONGEST)).alias("right"))
    left = counts.filter("words > 0").select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = left.select("lang", F.col("left").alias("right"), F.col("l").alias("r"))

    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) "
                   "div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = (cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
              .groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"))
    longer = phrases.filter(F.col("words") == LONGEST)
    inner = [longer.select("lang", _part(F.col("phrase"), start, F.lit(2)).alias("phrase"), "a") for start in (1, 2)]
    hidden = inner[0].unionByName(inner[1]).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(hidden, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < hidden_by * F.col("a")))
    total = counts.filter("words = 0").select("lang", F.col("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= top).join(total, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
