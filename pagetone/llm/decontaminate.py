"""Benchmark decontamination: windows of an item's size that hold enough of the item's shingles.

A window of a document is compared with a benchmark item of the same number of words. It holds the item if it has
at least SIMILARITY of the item's five-word shingles, repeats counted. The places of the shingles that a document
shares with an item tell which windows hold enough of them; their share is then counted exactly. No window that
passes is left out. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.llm.common import let, words
from pagetone.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: Up to so many pairs of benchmark shingle and item text the hashes are broadcast (about 25 MB); beyond, they are joined by shuffle,
#: and only the documents' shingles that a bitmap of the benchmark's lets through are shuffled.
BROADCAST_SHINGLES = 250_000
#: Binary logarithm of the words of the largest bitmap (16 MB).
_BITMAP_LOG = 21
_LANES = 16


def simhash(tokens: Column) -> Column:
    """64-bit SimHash of an array of words. A bit is set if more than half of the words' hashes have it.

    Counts are kept in lanes of 16 bits, four to a bigint, so that a word costs 16 additions, not 64.
    """
    lane_mask = F.lit(0x0001000100010001)

    def counted(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(_LANES - 1)), lambda s: F.aggregate(
            hashes, F.lit(0).cast("bigint"), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, s).bitwiseAND(lane_mask)))

    def assembled(sums: Column) -> Column:
        half = F.size(tokens) / F.lit(2)
        bits = [F.when(F.shiftrightunsigned(sums[s], 16 * lane).bitwiseAND(F.lit(0xFFFF)) > half, F.lit(_signed(1 << (s + 16 * lane))))
                .otherwise(F.lit(0).cast("bigint")) for s in range(_LANES) for lane in range(4)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(counted(h), assembled))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _shingle_hashes(tokens: Column) -> Column:
    """Hash of every run of SHINGLE words, in order; empty for fewer words."""
    last = F.size(tokens) - SHINGLE
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))


def benchmark_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, id, n, hashes): items of at least SHINGLE words with the hashes of their shingles, in order.

    Shorter, empty and null ones are no evidence and left out, as are items without a key. Items of equal
    words have the same ``id``, so that they are looked for once.
    """
    return (benchmark.select(F.col(key).alias("item"), words(F.col(text)).alias("words"))
            .filter(F.col("item").isNotNull() & (F.size("words") >= SHINGLE)).distinct()
            .select("item", F.xxhash64("words").alias("id"), F.size("words").alias("n"), _shingle_hashes(F.col("words")).alias("hashes")))


def _share(held: Column, wanted: Column) -> Column:
    """Share of the hashes ``wanted`` that are among ``held``, repeats counted."""
    plain = F.size(F.array_distinct(wanted)) == F.size(wanted)
    repeated = F.aggregate(F.array_distinct(wanted), F.lit(0), lambda acc, x: acc + F.least(
        F.size(F.filter(held, lambda y: y == x)), F.size(F.filter(wanted, lambda y: y == x))))
    return F.when(plain, F.size(F.array_distinct(held))).otherwise(repeated) / F.size(wanted)


def _among(h: Column, shingles: DataFrame, count: int) -> Column:
    """Whether ``h`` may be one of the hashes of ``shingles``, by a bitmap of about 16 bits for each of them."""
    log = min(max((count >> 2).bit_length(), 10), _BITMAP_LOG)
    word = lambda x: F.shiftrightunsigned(x, 64 - log).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    held = shingles.groupBy(word(F.col("h")).alias("w")).agg(F.bit_or(bit(F.col("h"))).alias("m"))
    every = shingles.sparkSession.range(1 << log).select(F.col("id").cast("int").alias("w")).join(held, "w", "left").select(
        "w", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"))
    blocks = every.groupBy(F.shiftright("w", 10).alias("b")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("m"))
    bitmap = blocks.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: x["m"]))).scalar()
    return F.get(bitmap, word(h)).bitwiseAND(bit(h)) != 0


def _shared(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, id, total, places): where each row has shingles of an item text, as (pos, h) in order.

    Rows that hold fewer than ``need`` places or ``kinds`` different shingles of a text are left out: no window can hold enough.
    """
    shingles = cut_lineage(wanted.select(F.struct("id", "need", "kinds").alias("to"), F.explode("hashes").alias("h"))
                           .groupBy("h").agg(F.collect_set("to").alias("to")))
    count, pairs = shingles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("to")), F.lit(0))).first()
    hashed = texts.select("row", words(F.col("text")).alias("words")).select(
        "row", F.size("words").alias("total"), F.posexplode(_shingle_hashes(F.col("words"))).alias("pos", "h"))
    if pairs <= BROADCAST_SHINGLES:
        met = hashed.join(F.broadcast(shingles), "h")
    else:
        met = hashed.filter(_among(F.col("h"), shingles, count)).join(shingles.hint("merge"), "h")
    found = (met.select("row", "total", "pos", "h", F.explode("to").alias("to"))
             .groupBy("row", "to.id", "total", "to.need", "to.kinds")
             .agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("places")))
    different = F.size(F.array_distinct(F.transform("places", lambda p: p["h"])))
    return found.filter((F.size("places") >= F.col("need")) & (different >= F.col("kinds"))).select("row", "id", "total", "places")


def _best_window() -> Column:
    """(similarity, -start) of the most similar window of a row, first if tied; NULL if none is similar enough.

    The k-th place and the one ``need`` places on lie in one window: all windows over both are looked at, each once, by its
    first place: later starts than that belong to the next place.
    """
    places, need, span = F.col("places"), F.col("need"), F.col("span")
    pos = lambda k: F.get(places, k)["pos"]

    def windows(k: Column) -> Column:
        def window(start: Column) -> Column:
            near = F.filter(F.sequence(k, F.least(k + span, F.size(places)) - 1), lambda i: pos(i) < start + span)
            return F.struct(let(F.transform(near, lambda i: F.get(places, i)["h"]), lambda held: _share(held, F.col("hashes"))).alias("similarity"),
                            (-start).alias("m"))

        low = F.greatest(pos(k + need - 1) - span + 1, F.when(k > 0, pos(k - 1) + 1).otherwise(0), F.lit(0))
        high = F.least(pos(k), F.col("last"))
        return let(F.struct(low.alias("low"), high.alias("high")), lambda ends: F.when(
            ends["low"] <= ends["high"], F.array_max(F.transform(F.sequence(ends["low"], ends["high"]), window))))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size(places) - need), windows))
    return let(best, lambda b: F.when(b["similarity"] >= SIMILARITY, b))


def find_items(texts: DataFrame, benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, item, start, n, similarity): each item found in a row, with its most similar window (first, if tied).

    ``texts`` has row and text; rows with the same key have the same text, and their windows are kept once.
    """
    items = cut_lineage(benchmark_items(benchmark, item_key, item_text))
    size = F.size("hashes")
    need = size - F.floor(size * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int")
    wanted = (items.select("id", "n", "hashes").distinct().withColumn("span", size).withColumn("need", need)
              .withColumn("kinds", F.size(F.array_distinct("hashes")) - F.col("span") + F.col("need")))
    both = _shared(texts, wanted).join(wanted, "id").withColumn("last", F.greatest(F.col("total") - F.col("n"), F.lit(0)))
    found = both.select("row", "id", "n", _best_window().alias("b")).filter("b IS NOT NULL")
    best = found.join(items.select("id", "item"), "id").groupBy("row", "item").agg(
        F.max(F.struct("b.similarity", "b.m", "n")).alias("b"))
    return best.select("row", "item", (-F.col("b.m")).alias("start"), F.col("b.n").alias("n"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, contaminated, n_items, items, similarity): one row per document.

    ``items`` lists the keys of the items found, ascending and comma-joined; ``similarity`` is the largest, or 0.
    Null texts are empty and clean; rows with equal key and text give equal rows, one each; null keys are keys.
    An empty benchmark leaves every document clean. No rows give no rows.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "row", F.xxhash64("key", "text"))
    found = find_items(texts.select("row", "text"), benchmark, item_key, item_text)
    per_row = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("ids"), F.max("similarity").alias("similarity"))
    return texts.select("key", "row").join(per_row, "row", "left").select(
        F.col("key").alias(key), F.col("ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("items"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay."""
    marked = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    texts = marked.select(F.col("__row").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bad = cut_lineage(find_items(texts, benchmark, item_key, item_text).select(F.col("row").alias("__row")).distinct())
    return marked.join(bad, "__row", "left_anti").drop("__row")
