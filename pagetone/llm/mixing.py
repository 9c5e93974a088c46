"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled by hash and laid end to end; the line is cut into blocks of equal token
counts, and repeats as often as needed. The mix has as many slots as the targets have blocks. Slot i asks the
golden-ratio point frac(i / phi) of a circle of equally spaced points which source it belongs to, through the cumulative
targets; its rank among the slots of that source is the block it takes. Blocks without a slot are not taken, and the
mix is written in slot order, so every stretch of it is near the weights.
"""

from __future__ import annotations

from math import ceil, floor, gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetone.llm.common import SPACED_WORD
from pagetone.session import cut_lineage

BLOCK_TOKENS = 32
MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Points of the circle at most; a longer schedule goes round again.
CIRCLE = (1 << 31) - 1
SLOTS_PER_CHUNK = 1 << 16
DOCS_PER_BUCKET = 1 << 12


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = MAX_REPEATS) -> dict:
    """Share the sum of sizes by weight; no target exceeds ``most`` times its size, the excess is shared anew."""
    total = float(sum(sizes.values()))
    fixed: dict[str | None, float] = {}
    free = [s for s in sizes]
    while free:
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / weight for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}
        free = [s for s in free if s not in fixed]
    return fixed


def golden_step(points: int) -> int:
    """The step nearest to points / phi that visits every one of ``points`` equally spaced points."""
    near = round(points * 0.6180339887498949)
    return next(g for d in range(points + 1) for g in (near - d, near + d) if g > 0 and gcd(g, points) == 1)


def schedule(takes: dict[int, int], block: int, spark) -> DataFrame:
    """(src, rank, slot): the source of every slot, and the slot's rank among those of its source.

    ``takes``: words to take by source number. A source's slots are within one of its share, since the points of
    the circle are equally spaced and each is visited once; any stretch of slots is near it, as consecutive points
    lie a golden section apart. Slots are generated and ranked in chunks: counts per chunk and
    source are small, their running sums give each chunk's first rank, so no source is ranked in one task.
    """
    total = sum(takes.values())
    schema = "src int, rank bigint, slot bigint"
    if not total:
        return spark.createDataFrame([], schema)
    n_slots = ceil(total / block)
    circle = min(n_slots, CIRCLE)
    edges, run = [], 0
    for s, t in takes.items():
        run += t
        edges.append((s, (2 * run * circle + total) // (2 * total)))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(circle)) * F.lit(golden_step(circle)), F.lit(circle))
    src = F.coalesce(*[F.when(point < F.lit(edge), F.lit(s)) for s, edge in edges])
    slots = spark.range(n_slots, numPartitions=max(1, min(4096, ceil(n_slots / SLOTS_PER_CHUNK)))).select(
        F.col("id").alias("slot"), (F.col("id") / F.lit(SLOTS_PER_CHUNK)).cast("bigint").alias("chunk")).select(
        "slot", "chunk", src.alias("src"))
    per_chunk = slots.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_chunk.select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("src", "chunk").orderBy("slot")
    return slots.join(firsts, ["src", "chunk"]).withColumn("rank", F.row_number().over(within) - 1 + F.col("first")).select("src", "rank", "slot")


def _source_stats(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))


def _order(key: str, text: str, source: str) -> Column:
    """Place of a document in its source's shuffled order."""
    return F.xxhash64(F.col(f"`{key}`"), F.lit("mix"), F.col(f"`{text}`"), F.col(f"`{source}`"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: dict[str | None, float] | None = None, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """One row per document (key, size, source_size, target, taken, first_slot, order), and the slots it fills.

    ``order`` is the hash that shuffles a source's documents, ``first_slot`` the first place of the mix that takes some of it.

    Second table: (key, order, source, pass, slot, rank, words): which slots take how many words of each document. Sizes
    are word counts, null texts have none. Without ``weights`` the sources in code-point order (null last) weigh
    5, 2, 1, repeating. Each source takes the blocks that have a slot, so up to a block less than its target, and
    never more; a document is taken at most three times, because a target never exceeds three times its source.
    Documents of size 0 are taken 0 times. Rows with equal keys are separate documents. No rows give no rows.

    The only table at the driver is one row per source. Running sums are two-level: hash buckets of a bounded
    number of documents, then within buckets; so a hot source is dealt over many tasks.
    """
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                                    size_of(F.col(text)).alias("size"), _order(key, text, source).alias("order")))
    stats = {r["source"]: (r["source_size"], r["n"]) for r in _source_stats(sized).collect()}
    names = sorted((s for s in stats if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in stats if s is None]
    if weights is None:
        weights = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    sizes = {s: stats[s][0] for s in names}
    target = targets(sizes, weights)
    number = {s: i for i, s in enumerate(names)}
    takes = {number[s]: floor(target[s]) for s in names}
    info = spark.createDataFrame(
        [(s, number[s], sizes[s], float(target[s]), takes[number[s]], max(1, ceil(stats[s][1] / DOCS_PER_BUCKET)))
         for s in names], "name string, src int, source_size bigint, target double, take bigint, buckets int")
    joined = sized.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "bucket", F.pmod(F.col("order"), F.col("buckets")))

    per_bucket = joined.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    running = (Window.partitionBy("src", "bucket").orderBy("order", F.col("key").asc_nulls_first(), "size")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut_lineage(joined.withColumn("until", F.sum("size").over(running)).join(base, ["src", "bucket"])
                         .withColumn("start", F.col("base") + F.col("until") - F.col("size"))
                         .withColumn("row", F.monotonically_increasing_id())
                         .select("row", "key", "source", "src", "size", "source_size", "target", "take", "start", "order"))

    # Where the document lies on the repeated line, in each pass that is taken at all, cut at block borders.
    passes = F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))
    laid = (placed.filter("size > 0").select("row", "key", "order", "source", "src", "take", "size", "start", "source_size",
                                             passes.alias("pass"))
            .withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
            .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).filter(F.col("from") < F.col("to")))
    first, last = F.floor(F.col("from") / F.lit(block)), F.floor((F.col("to") - 1) / F.lit(block))
    pieces = laid.withColumn("rank", F.explode(F.sequence(first, last))).withColumn(
        "words", F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block))
    filled = pieces.join(schedule(takes, block, spark), ["src", "rank"])
    taken = filled.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.join(taken, "row", "left").select(
        F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "first_slot", "order")
    return out, filled.select(F.col("key").alias(key), "order", "source", "pass", "slot", "rank", "words")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the order of the slots; all columns stay.

    Every taking of a row stands at the first slot that takes some of it. A row that is taken in part appears whole.
    Rows without words are not taken. Rows that are equal in key, text and source are taken alike: as often as the one
    that is taken most. Rows are laid out in ranges of slots and sorted in them, so the files of the result are
    stretches of the schedule.
    """
    slots = mix(docs, key, text, source, weights)[1]
    places = slots.groupBy(F.col("order").alias("__order"), "pass").agg(F.min("slot").alias("__slot")).drop("pass")
    marked = docs.withColumn("__order", _order(key, text, source))
    mixed = marked.join(places, "__order")
    return mixed.repartitionByRange("__slot", "__order").sortWithinPartitions("__slot", "__order").drop("__order", "__slot")
