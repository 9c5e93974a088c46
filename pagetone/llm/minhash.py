"""MinHash near-duplicates by an LSH forest.

Every different set of five-word shingles is a node. Each tree of the forest is one order of the nodes, by a
signature of ``DEPTH`` MinHash values; nodes with a long common prefix lie next to each other in it. A region is a run
of nodes that share a prefix, and its depth adapts: a run is cut by the next value until it holds at most ``REGION``
nodes, so sparse regions are compared under short prefixes and dense ones under long ones. Trees are cut into
ranges, not into regions, so a dense region is many tasks; runs that a range border may cut are put together
again and met in chunks.

Candidates of a region must pass two tests that lose nothing: the sizes of the sets, and the parities of hashed
shingles, which differ in at most as many places as the sets. First each region proposes a spanning forest of these;
it is confirmed on the full sets and gives components. Then each region proposes every candidate between different
components, and those are confirmed too. So large groups of copies cost a few comparisons a member, and no
candidate is left out because of a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetone.llm.graph import components
from pagetone.session import cut_lineage

#: Production parameters: words of a shingle, percent of the union that must be shared.
WORDS, PERCENT = 5, 85
#: Trees, values of a signature, shortest prefix of a region, and nodes under which a region is not cut further.
TREES, DEPTH, SHORTEST, REGION = 16, 5, 3, 256
#: Bits of parity, nodes of a chunk of a cut region, and links that are confirmed in one go.
PARITY, CHUNK, STAR = 512, 4096, 256
SEED = 42
_DICE = np.random.default_rng(SEED)
_FACTORS = _DICE.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_MASKS = _DICE.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted different hashes of a text's shingles; fewer words give one, none give none."""
    import xxhash

    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    digest, n = xxhash.xxh64_intdigest, len(tokens)
    if n <= width:
        return np.array([digest(b" ".join(tokens), SEED)], dtype=np.uint64)
    line = b" ".join(tokens)
    starts = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=starts[1:])
    at, to = starts[:n - width + 1].tolist(), (starts[width:] - 1).tolist()
    return np.unique(np.array([digest(line[i:j], SEED) for i, j in zip(at, to)], dtype=np.uint64))


def signature(s: np.ndarray) -> np.ndarray:
    """Two bytes of each MinHash value, all trees in turn."""
    low = s.astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(least, ((low[k:k + 2048, None] * _FACTORS) ^ _MASKS).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def parities(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) % 2 == 1)


_MARKED = "hash bigint, set binary, n int, signature binary, parity binary"


def _marked(key_type: pa.DataType):
    import xxhash

    types = pa.schema([("key", key_type), ("hash", pa.int64()), ("set", pa.binary()), ("n", pa.int32()),
                       ("signature", pa.binary()), ("parity", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingles(text or b"")
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), signature(s).tobytes(), parities(s).tobytes()) if len(s)
                            else (None, 0, None, None))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), *[
                pa.array(c, types.field(i + 2).type) for i, c in enumerate(columns)]], schema=types)

    return run


# --- regions of a tree ----------------------------------------------------------------------------

def _near(n: np.ndarray, parity: np.ndarray, u: int, others: np.ndarray, percent: int) -> np.ndarray:
    """The others whose sets can share ``percent`` of the union with that of ``u``. Nothing that does is lost."""
    small, large = np.minimum(n[others], n[u]), np.maximum(n[others], n[u])
    others = others[100 * small >= percent * large]
    differ = np.bitwise_count(parity[others] ^ parity[u]).sum(axis=1, dtype=np.int64)
    return others[(100 + percent) * differ <= (100 - percent) * (n[others] + n[u])]


def _forest(node, n, parity, lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the candidates of one region, from the smallest node on."""
    order = lo + np.argsort(node[lo:hi], kind="stable")
    left = np.zeros(hi, dtype=bool)
    left[order] = True
    out = []
    for root in order:
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            rest = order[left[order]]
            if not len(rest):
                return out
            near = _near(n, parity, u, rest, percent)
            left[near] = False
            queue.extend(near.tolist())
            out.extend((int(node[u]), int(node[v])) for v in near)
    return out


def between_components(node, comp, n, parity, lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """Every candidate of one region whose nodes are in different components."""
    at = np.arange(lo, hi)
    names, number = np.unique(comp[lo:hi], return_counts=True)
    if len(names) < 2:
        return []
    most = names[np.argmax(number)]
    main, others = at[comp[lo:hi] == most], at[comp[lo:hi] != most]
    out = []
    for i, u in enumerate(others):
        rest = np.concatenate([main, others[i + 1:]])
        near = _near(n, parity, u, rest[comp[rest] != comp[u]], percent)
        out.extend((int(min(node[u], node[v])), int(max(node[u], node[v]))) for v in near)
    return out


def region_pairs(prefix: np.ndarray, node, comp, n, parity, percent: int, between: bool) -> list[tuple[int, int]]:
    """Candidates of rows sorted by prefix: runs are cut at greater depth until they are small enough."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(node), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        if depth >= SHORTEST and (hi - lo <= REGION or depth == DEPTH):
            out += between_components(node, comp, n, parity, lo, hi, percent) if between else _forest(node, n, parity, lo, hi, percent)
            continue
        column = prefix[lo:hi, depth]
        cuts = lo + np.flatnonzero(column[1:] != column[:-1]) + 1
        starts, ends = np.r_[lo, cuts], np.r_[cuts, hi]
        several = ends - starts > 1
        stack.extend((int(a), int(b), depth + 1) for a, b in zip(starts[several], ends[several]))
    return out


_ENTRY = ("tree", "prefix", "node", "comp", "n", "parity")
_FOUND = "a bigint, b bigint, tree int, prefix binary, node bigint, comp bigint, n int, parity binary"


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    prefix = np.frombuffer(b"".join(rows["prefix"]), dtype=">u2").reshape(-1, DEPTH)
    parity = np.frombuffer(b"".join(rows["parity"]), dtype=np.uint64).reshape(len(rows), -1)
    return prefix, rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy().astype(np.int64), parity


def _scan(percent: int, between: bool):
    """Candidates in a sorted range; the first and the last run of the shortest prefix come out as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]  # one range of bounded size
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        prefix, node, comp, n, parity = _arrays(rows)
        start = np.c_[rows["tree"].to_numpy(), prefix[:, :SHORTEST]]
        cuts = np.flatnonzero((start[1:] != start[:-1]).any(axis=1)) + 1
        first, last = (int(cuts[0]), int(cuts[-1])) if len(cuts) else (len(rows), len(rows))
        tree, pairs = rows["tree"].to_numpy(), []
        for t in np.unique(tree[first:last]):
            lo, hi = first + np.searchsorted(tree[first:last], [t, t + 1])
            pairs += region_pairs(prefix[lo:hi], node[lo:hi], comp[lo:hi], n[lo:hi], parity[lo:hi], percent, between)
        found = pd.DataFrame(pairs, columns=["a", "b"], dtype="Int64")
        opened = rows.drop(index=range(first, last))[list(_ENTRY)]
        yield pd.concat([found, opened], ignore_index=True).reindex(columns=["a", "b", *_ENTRY]).astype(
            {c: "Int64" for c in ("a", "b", "tree", "node", "comp", "n")})

    return run


def _met(percent: int, between: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop_duplicates("node").sort_values(["prefix", "node"], ignore_index=True)
        pairs = region_pairs(*_arrays(rows), percent, between)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


def candidates(nodes: DataFrame, percent: int, between: bool) -> DataFrame:
    """(a, b): candidates of ``nodes`` (node, comp, n, signature, parity), see the module's text; each once."""
    width = 2 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("tree"), F.substring("signature", t * width + 1, F.lit(width)).alias("prefix")))
    entries = nodes.select("node", "comp", "n", "parity", F.explode(trees).alias("t")).select("t.tree", "t.prefix", "node", "comp", "n", "parity")
    order = ["tree", "prefix", "node"]
    found = cut_lineage(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_scan(percent, between), _FOUND))
    region = F.substring("prefix", 1, 2 * SHORTEST)
    opened = found.filter("a IS NULL").select("tree", region.alias("region"), "prefix", "node", "comp", "n", "parity")
    sizes = (opened.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
             .select("tree", "region", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (opened.join(sizes, ["tree", "region"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("ci", F.least("own", "other")).withColumn("cj", F.greatest("own", "other")))
    met = dealt.groupBy("tree", "region", "ci", "cj").applyInPandas(_met(percent, between), "a bigint, b bigint")
    return found.filter("a IS NOT NULL").select("a", "b").unionByName(met).distinct()


# --- confirmation on full sets --------------------------------------------------------------------

def _confirmed(percent: int, width: int):
    """Links among rows sorted by (a, deal, not centre): the centre's set stays, the others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        at, centre = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for a, deal, node, text in zip(*[batch.column(c).to_pylist() for c in ("a", "deal", "node", "text")]):
                s = shingles(text or b"", width)
                if (a, deal) != at and a == node:
                    at, centre = (a, deal), s
                elif (a, deal) == at:
                    common = len(np.intersect1d(s, centre, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(centre) - common):
                        out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], schema=types)

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full sets share ``percent`` of their union. ``texts``: (node, text).

    Pairs with the same ``a`` meet its text in lots of about ``STAR``.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).cast("int").alias("lots"))
    deal = F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")
    members = pairs.join(lots, "a").select("a", deal.alias("deal"), F.col("b").alias("node"), F.lit(1).alias("later"))
    centres = lots.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("deal"), F.col("a").alias("node"), F.lit(0).alias("later"))
    asked = members.unionByName(centres).join(texts, "node").select("a", "deal", "later", "node", "text")
    return asked.repartition("a", "deal").sortWithinPartitions("a", "deal", "later").mapInArrow(_confirmed(percent, width), "a bigint, b bigint")


def minhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component, kept): every row with the smallest key of the group that links connect.

    Links join rows whose shingle sets share at least ``percent`` of their union. Null, blank and wordless texts have
    an empty set and are linked with nothing; their component is their own key. Every row is kept as it comes, also with
    a repeated key; a null key is never a component unless its group has no other. No rows give no rows. Other columns
    are ignored.

    Rows with equal sets are one node, so exact copies cost one row; smallest keys come back by a join whose other
    side is unique, which AQE can split. Texts travel only for nodes that have a candidate.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    key_type = docs.schema[key].dataType
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("words")).select(
        "key", F.xxhash64("key", "words").alias("hash"), F.col("words").cast("binary").alias("text"))
    schema = StructType([StructField("key", key_type), *StructType.fromDDL(_MARKED)])
    marked = cut_lineage(slim.mapInArrow(_marked(to_arrow_type(key_type)), schema))
    first = F.min(F.struct(F.col("key").isNull().alias("unset"), "key", "hash")).alias("first")
    nodes = cut_lineage(marked.filter("n > 0").groupBy("set").agg(first, *[F.first(c).alias(c) for c in ("n", "signature", "parity")])
                        .select(F.monotonically_increasing_id().alias("node"), "set", "first.key", "first.hash", "n", "signature", "parity"))

    pairs = cut_lineage(candidates(nodes.withColumn("comp", F.col("node")), percent, between=False))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(asked, "node", "left_semi")
    own = wanted.select("node", F.col("key").alias("k"), F.col("hash").alias("h"))
    same = (F.col("hash") == F.col("h")) & F.col("key").eqNullSafe(F.col("k"))
    texts = cut_lineage(slim.join(own, same).dropDuplicates(["hash", "node"]).select("node", "text"))
    links = cut_lineage(confirm(pairs, texts, percent))
    found = cut_lineage(components(links))
    placed = wanted.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    more = cut_lineage(confirm(candidates(placed.select("node", "comp", "n", "signature", "parity"), percent, between=True), texts, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    rooted = nodes.select("node", "set", "key").join(found, "node", "left").select("set", "key", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("key").alias("component"))
    labels = rooted.join(least, "root").select("set", "component")
    out = marked.select("key", "set", "n").join(labels, "set", "left").select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component")))
