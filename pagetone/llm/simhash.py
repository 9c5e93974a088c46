"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked when few bits differ. Bits that vary together share a partition; each
partition gets its own threshold, chosen by dynamic programming on estimated candidates, so that the
thresholds sum to ``radius - partitions + 1``. Two fingerprints within the radius then agree in at least one
partition to within its threshold, so probing every partition loses no link. Every candidate is verified.

Near-duplicate texts, which the pipeline drops, are found without fingerprints: by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.llm.graph import components
from pagetone.llm.minhash import between_components, confirm, parities, shingles
from pagetone.session import cut_lineage

BITS = 64
SEED = 42
#: Buckets above this size are searched in chunks of CHUNK fingerprints instead of by a join.
HOT_BUCKET, CHUNK = 128, 1024


def _fingerprint(text: str | None, width: int) -> int:
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(tokens)
    line = b" ".join(tokens)
    starts = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=starts[1:])
    at, to = starts[:max(1, n - width + 1)].tolist(), (starts[min(width, n):] - 1).tolist()
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(at, to, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash of ``width``-word shingles, as a signed bigint. Null and blank texts have fingerprint 0."""

    @F.pandas_udf("bigint")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_fingerprint(t, width) for t in batch], dtype="int64")

    return of_texts(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the plan: partitions of bits and their thresholds --------------------------------------------

@dataclass(frozen=True)
class Plan:
    """Bits and threshold of each partition; threshold -1 leaves a partition out."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count, and how often each pair of bits is set together, over all fingerprints (64 by 64 numbers)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            raw = batch["fp"].to_numpy(dtype="<i8", copy=True)
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(raw)
        if n:
            yield pd.DataFrame({"i": np.append(np.arange(BITS * BITS), -1),
                                "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = (fps.select("fp").mapInPandas(partial, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n"))
            .collect())  # at most 64 * 64 + 1 rows
    found = {r["i"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """``m`` partitions of almost equal width; each grows from the strongest free pair by mean correlation."""
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strength = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, parts = list(range(BITS)), []
    for p in range(m):
        width = BITS // m + (p < BITS % m)
        sub = strength[np.ix_(free, free)]
        first = free[int(np.argmax(sub.max(axis=1)))]
        part = [first]
        free.remove(first)
        while len(part) < width:
            best = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def _within(n: int, together: np.ndarray, part: tuple[int, ...], most: int) -> list[float]:
    """Estimated pairs that differ in at most t bits of the partition, for t = 0..most (independent bits)."""
    p = np.array([together[b, b] / max(n, 1) for b in part])
    differ = 2 * p * (1 - p)
    dist = np.zeros(len(part) + 1)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return [float(dist[:t + 1].sum()) * n * n for t in range(most + 1)]


def allocate(costs: list[list[float]], radius: int) -> tuple[float, tuple[int, ...]]:
    """Cheapest thresholds with sum ``radius - m + 1``; ``costs[p][t + 1]`` is the cost of threshold t."""
    m = len(costs)
    need = radius + 1  # sum of (threshold + 1)
    best: list[dict[int, tuple[float, tuple[int, ...]]]] = [{0: (0.0, ())}]
    for p in range(m):
        row: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (cost, chosen) in best[-1].items():
            for step, more in enumerate(costs[p]):
                total = (cost + more, (*chosen, step - 1))
                if have + step <= need and (have + step not in row or total < row[have + step]):
                    row[have + step] = total
        best.append(row)
    return best[-1][need]


def make_plan(n: int, together: np.ndarray, radius: int, probe_cost: float = 20.0) -> Plan:
    """Try several numbers of partitions and keep the cheapest allocation. Any plan gives the same links."""
    options = []
    for m in range(2, min(8, radius + 2) + 1):
        parts = group_bits(n, together, m)
        most = min(radius, 3)
        costs = []
        for part in parts:
            pairs = _within(n, together, part, most)
            probes = np.cumsum([comb(len(part), t) for t in range(most + 1)])
            costs.append([0.0, *[pairs[t] + probe_cost * n * float(probes[t]) for t in range(most + 1)]])
        if m * (most + 1) >= radius + 1:
            options.append((*allocate(costs, radius), parts))
    _, thresholds, parts = min(options)
    return Plan(parts, thresholds)


# --- candidates and links -------------------------------------------------------------------------

def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _entries(part: int, own: Column, flips: list[Column]) -> Column:
    return F.transform(F.array(*flips), lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("key")))


def _signatures(fps: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """(part, key, fp): the partition's bits of each fingerprint, and with ``probing`` all keys in its ball."""
    entries = []
    for p, (part, threshold) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if threshold < 0:
            continue
        mask = F.lit(_signed(sum(1 << b for b in part)))
        flips = [0]
        if probing:
            flips = [sum(1 << b for b in bits) for t in range(threshold + 1) for bits in combinations(part, t)]
        own = F.col("fp").bitwiseAND(mask)
        entries.append(_entries(p, own, [F.lit(_signed(x)) for x in flips]))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("s")).select("s.part", "s.key", "fp")


def _forest(radius: int):
    """Spanning forest of the links among the fingerprints of one group of bounded size."""

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(group["fp"].to_numpy(dtype="int64")).view(np.uint64)
        left = np.ones(len(fps), dtype=bool)
        out: list[tuple[int, int]] = []
        signed = fps.view(np.int64)
        for root in range(len(fps)):
            if not left[root]:
                continue
            left[root] = False
            queue = [root]
            while queue:
                u = queue.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(fps[rest] ^ fps[u]) <= radius]
                left[near] = False
                queue.extend(near.tolist())
                out.extend((int(signed[u]), int(signed[v])) for v in near)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return edges


def link_fingerprints(fps: DataFrame, radius: int = 3, hot: int = HOT_BUCKET, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within ``radius`` do.

    ``fps`` holds distinct fingerprints (fp). Ordinary buckets emit each verified pair. A bucket with more
    than ``hot`` fingerprints is dealt into chunks, every two chunks meet in a group of bounded size, and only
    a spanning forest of its verified links comes out: the same components without all pairs.
    """
    n, together = bit_statistics(fps)
    plan = make_plan(n, together, radius)
    index, probes = _signatures(fps, plan, False), _signatures(fps, plan, True)
    large = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    large = cut_lineage(large.withColumn("chunks", F.ceil(F.col("n") / F.lit(chunk)).cast("int")))
    some_hot = not large.isEmpty()
    keys = ["part", "key"]
    cold = index.join(large, keys, "left_anti") if some_hot else index
    i, q = cold.alias("i"), probes.alias("q")
    pairs = i.join(q, (F.col("i.part") == F.col("q.part")) & (F.col("i.key") == F.col("q.key"))
                   & (F.col("i.fp") < F.col("q.fp"))
                   & (F.bit_count(F.col("i.fp").bitwiseXOR(F.col("q.fp"))) <= radius))
    links = pairs.select(F.col("i.fp").alias("a"), F.col("q.fp").alias("b"))
    # The probe is symmetric, so the pair is also met with the sides exchanged; the smaller side as index is enough.
    if not some_hot:
        return links.distinct()
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    stored = index.join(large, keys).select(*keys, "fp", own.alias("ci"), every.alias("cj"))
    asked = probes.join(large, keys).select(*keys, "fp", every.alias("ci"), own.alias("cj"))
    forest = (stored.unionByName(asked).groupBy(*keys, "ci", "cj")
              .applyInPandas(_forest(radius), "a bigint, b bigint"))
    return links.unionByName(forest).distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
                       radius: int = 3) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the smallest key of its linked group.

    Null or blank texts have fingerprint 0 and are linked like others. Rows with the same key each keep their
    row. A null key keeps its row; the smallest key of a group ignores nulls. No rows give no rows.
    Equal fingerprints are one node, so large groups of exact copies cost one row; the labels come back by one
    join on the fingerprint, whose other side is unique, so that AQE can split a hot one.
    """
    marked = cut_lineage(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), width).alias("fp")))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("least")))
    found = components(link_fingerprints(nodes.select("fp"), radius))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component"))
    labels = placed.join(roots, "root").select("fp", "component")
    return marked.join(labels, "fp").select(F.col("key").alias(key), "fp", "component")


# --- near-duplicate texts: shared rare shingles propose, all shingles decide ------------------------

#: Production parameters of the pipeline's stage: the decision is made by the share of common five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Texts of one rare shingle that meet in one go; more meet in pairs of such chunks.
TEXT_CHUNK = 4096
#: Shingles of every COUNTED-th text are counted in COUNT_BUCKETS buckets. Counts only order shingles: any order gives the same links.
COUNTED, COUNT_BUCKETS, COUNT_SLICE = 4, 1 << 18, 1 << 12
#: A rare shingle of more texts than this proposes a star first, not all pairs.
HOT_SHINGLE = 32
#: Bits of the table that tells texts which surely are not asked for. Its size is fixed; where it fills up, more texts are shuffled.
TABLE_BITS = 1 << 23


def shingle_counts(texts: DataFrame, width: int = SHINGLE_WORDS, every: int = COUNTED) -> np.ndarray:
    """Occurrences of shingles by bucket (hash modulo COUNT_BUCKETS) in every ``every``-th of ``texts`` (hash, text)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        for batch in batches:
            for t in batch["text"]:
                np.add.at(total, (shingles(bytes(t), width) % np.uint64(COUNT_BUCKETS)).astype(np.int64), 1)
        yield pd.DataFrame({"slice": np.arange(COUNT_BUCKETS // COUNT_SLICE),
                            "counts": [x.tobytes() for x in total.astype("<i4").reshape(-1, COUNT_SLICE)]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNT_SLICE, dtype=np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, dtype="<i4")
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    schema = "slice int, counts binary"
    rows = (texts.filter(F.pmod("hash", F.lit(every)) == 0).select("text").mapInPandas(partial, schema)
            .groupBy("slice").applyInPandas(added, schema).collect())  # COUNT_BUCKETS numbers, whatever the data
    counts = np.zeros(COUNT_BUCKETS, dtype=np.int32)
    for r in rows:
        counts[r["slice"] * COUNT_SLICE:(r["slice"] + 1) * COUNT_SLICE] = np.frombuffer(r["counts"], dtype="<i4")
    return counts


def _rarest(s: np.ndarray, order: np.ndarray, share: float) -> np.ndarray:
    """32 bits of each of a set's rarest shingles.

    Sets whose Jaccard similarity is at least ``share`` have that share of the larger one in common. Of n
    shingles in an order that all texts share, the first n - ceil(share * n) + 1 are therefore enough: similar
    texts have at least one of them in common.
    """
    first = np.lexsort((s, order[(s % np.uint64(COUNT_BUCKETS)).astype(np.int64)]))
    first = first[:len(s) - int(np.ceil(share * len(s) - 1e-9)) + 1]
    return np.unique((s[first] >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _marked_texts(key_type: pa.DataType, counts, width: int, share: float):
    import xxhash

    types = pa.schema([("key", key_type), ("hash", pa.int64()), ("set", pa.binary()), ("n", pa.int32()),
                       ("parity", pa.binary()), ("rare", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), parities(s).tobytes(), _rarest(s, order, share) if len(s) else []))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), *[
                pa.array([r[i] for r in rows], types.field(i + 2).type) for i in range(4)]], schema=types)

    return run


def _possible(percent: int):
    """Whether two sets can be similar, by their sizes and parities. Nothing similar is lost."""

    @F.pandas_udf("boolean")
    def test(n1: pd.Series, n2: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.Series:
        if not len(n1):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(p), dtype=np.uint64).reshape(len(p), -1) for p in (p1, p2))
        differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return pd.Series((100 + percent) * differ <= (100 - percent) * (n1.to_numpy(np.int64) + n2.to_numpy(np.int64)))

    return test


def _tested(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be similar."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("parity").alias("p1"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("parity").alias("p2"))
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return both.filter(_possible(percent)("n1", "n2", "p1", "p2")).select(*pairs.columns)


def _met_between(percent: int):
    """Candidates between components within one chunk pair of a frequent rare shingle's texts.

    Texts that have several such shingles in common meet under each; the first of these reports the pair.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop_duplicates("node")
        token, own = int(rows["token"].iloc[0]), dict(zip(rows["node"], map(frozenset, rows["tokens"]), strict=True))
        parity = np.frombuffer(b"".join(rows["parity"]), dtype=np.uint64).reshape(len(rows), -1)
        pairs = between_components(rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy().astype(np.int64), parity, 0, len(rows), percent)
        return pd.DataFrame([(a, b) for a, b in pairs if min(own[a] & own[b]) == token], columns=["a", "b"], dtype="int64")

    return run


def _within_table(hashes: DataFrame):
    """A test of hashes against a table of TABLE_BITS bits: false only for those that are not among ``hashes``.

    The table is broadcast, whatever the data: its size is fixed.
    """
    size = TABLE_BITS // 8

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(TABLE_BITS, dtype=bool)
        for batch in batches:
            bits[batch["hash"].to_numpy(dtype=np.int64) % TABLE_BITS] = True
        packed = np.packbits(bits).reshape(-1, size // 64)
        some = np.flatnonzero(packed.any(axis=1))
        yield pd.DataFrame({"slice": some.astype(np.int32), "bits": [packed[i].tobytes() for i in some]})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch["slice"], batch["bits"], strict=True):
                total[i] = total.get(i, np.uint8(0)) | np.frombuffer(b, dtype=np.uint8)
        yield pd.DataFrame({"slice": pd.Series(list(total), dtype="int32"), "bits": [x.tobytes() for x in total.values()]})

    table = np.zeros((64, size // 64), dtype=np.uint8)
    schema = "slice int, bits binary"
    for r in hashes.select("hash").mapInPandas(partial, schema).repartition("slice").mapInPandas(joined, schema).collect():
        table[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    held = hashes.sparkSession.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        place = h.to_numpy(dtype=np.int64) % TABLE_BITS
        return pd.Series((held.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1)

    return test


def _alike(a: Column, b: Column) -> Column:
    """Null-safe equality that is no join key, so that rows stay dealt by the hash beside it."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
                          share: float = SIMILARITY, chunk: int = TEXT_CHUNK, hot: int = HOT_SHINGLE) -> DataFrame:
    """(key, hash, first_key, first_hash): every row and the row with the smallest key of its group.

    ``hash`` is xxhash64 of key and text. Two texts are linked if their sets of five-word shingles have a Jaccard
    similarity of at least ``share``; groups are what links connect. Equal sets are one node, so copies cost one row. No
    pair is lost: texts that have one of their rarest shingles in common are candidates (see ``_rarest``), unless
    the sizes or the parities of their sets rule them out. Nothing is merged before it is confirmed on the full
    sets: first one candidate a node, and a star per frequent shingle, give components; then every candidate between
    different components is confirmed. Texts without words are alike and form one group.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    spark, percent = docs.sparkSession, round(100 * share)
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("words")).select(
        "key", F.xxhash64("key", "words").alias("hash"), F.col("words").cast("binary").alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(slim.select("hash", "text"), width))
    key_type = docs.schema[key].dataType
    schema = StructType([StructField("key", key_type), *StructType.fromDDL("hash bigint, set binary, n int, parity binary, rare array<int>")])
    marked = cut_lineage(slim.mapInArrow(_marked_texts(to_arrow_type(key_type), counts, width, share), schema))
    first = F.min(F.struct(F.col("key").isNull().alias("unset"), "key", "hash")).alias("first")
    nodes = cut_lineage(marked.groupBy("set").agg(first, *[F.first(c).alias(c) for c in ("n", "parity", "rare")]).select(
        F.monotonically_increasing_id().alias("node"), "set", "first.key", "first.hash", "n", "parity", "rare"))

    entries = nodes.select("node", "n", F.explode("rare").alias("token"))
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("centre")).filter("times > 1")
    shared = cut_lineage(entries.join(often, "token"))
    cold = shared.filter(F.col("times") <= hot)
    x, y = cold.alias("x"), cold.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                 & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    crowd = shared.filter(F.col("times") > hot)
    stars = crowd.filter(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = cut_lineage(_tested(met.withColumn("star", F.lit(False)).union(stars.withColumn("star", F.lit(True))), nodes, percent))
    pairs = tested.filter("NOT star").select("a", "b")
    # One candidate a node, the smallest, and all stars.
    asked = cut_lineage(tested.groupBy("b", F.when(F.col("star"), F.col("a")).alias("centre")).agg(F.min("a").alias("a")).select("a", "b").distinct())

    members = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct()
    own = nodes.join(members, "node", "left_semi").select("node", F.col("key").alias("k"), F.col("hash").alias("h"))
    same = (F.col("hash") == F.col("h")) & _alike(F.col("key"), F.col("k"))
    wanted = slim.filter(_within_table(own.select(F.col("h").alias("hash")))("hash"))
    texts = cut_lineage(wanted.join(own, same).dropDuplicates(["hash", "node"]).select("node", "text"))
    links = cut_lineage(confirm(asked, texts, percent, width))
    found = cut_lineage(components(links))

    comp = cut_lineage(nodes.join(found, "node", "left").select("node", "n", "parity", F.coalesce("component", "node").alias("comp")))
    left, right = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    apart = pairs.join(left, "a").join(right, "b").filter("ca <> cb").select("a", "b")
    places = crowd.select("token", "node").join(comp.select("node", "comp"), "node")
    mixed = (places.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"))
             .filter("low <> high").select("token", F.ceil(F.col("size") / F.lit(chunk)).cast("int").alias("chunks")))
    places = cut_lineage(places.join(mixed, "token"))
    lists = places.groupBy("node").agg(F.collect_set("token").alias("tokens"))
    dealt = (places.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("token", "node", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj")))
    between = dealt.join(comp.join(lists, "node"), "node").groupBy("token", "ci", "cj").applyInPandas(_met_between(percent), "a bigint, b bigint")
    later = cut_lineage(apart.union(between).distinct().join(asked, ["a", "b"], "left_anti"))
    if not later.isEmpty():
        more = confirm(later, texts, percent, width).join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(more)  # links between components
        comp = comp.join(joined, comp["comp"] == joined["node"], "left").select(
            comp["node"], F.coalesce("component", "comp").alias("comp"))

    rooted = nodes.select("node", "set", "key", "hash").join(comp.select("node", F.col("comp").alias("root")), "node").drop("node")
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("unset"), "key", "hash")).alias("v"))
    labels = rooted.join(least, "root").select("set", F.col("v.key").alias("first_key"), F.col("v.hash").alias("first_hash"))
    return marked.select("key", "hash", "set").join(labels, "set").select("key", "hash", "first_key", "first_hash")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts: the one with the smallest key; all columns stay.

    Of rows with equal key and text one stays. Null keys come last: such a row stays only if its group has no other
    key. Null and blank texts form one group. No rows give no rows.

    Only rows that go, or that are there more than once, are looked up; a small table of bits lets the others pass
    without a shuffle.
    """
    found = near_duplicate_groups(docs, key, text, **how)
    stays = (F.col("hash") == F.col("first_hash")) & F.col("key").eqNullSafe(F.col("first_key"))
    counted = found.groupBy(F.col("key").alias("__key"), F.col("hash").alias("__hash")).agg(
        F.first(stays).alias("__stays"), F.count(F.lit(1)).alias("__n"))
    special = cut_lineage(counted.filter("NOT __stays OR __n > 1").drop("__n"))
    rows = docs.withColumn("__row", F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    asked = _within_table(special.select(F.col("__hash").alias("hash")))(F.col("__row"))
    rows = rows.withColumn("__asked", asked)
    passed = rows.filter("NOT __asked").drop("__asked", "__row")
    met = rows.filter("__asked").drop("__asked").join(
        special, (F.col("__row") == F.col("__hash")) & _alike(F.col(f"`{key}`"), F.col("__key")), "left").filter("__stays IS NULL OR __stays")
    return passed.unionByName(met.dropDuplicates(["__row", key]).select(*passed.columns))
