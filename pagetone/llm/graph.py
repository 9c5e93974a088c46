"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetone.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of a link with the smallest node it can reach.

    ``links`` has bigint columns a and b. Each round points nodes at smaller ones and keeps at most as many
    links as there were; it ends when a round changes nothing (about log2 of the longest path). Minima are
    combined before the shuffle and a hot node is one side of a plain equi-join, which AQE can split.
    Self-links and repeated links are ignored; no links give no rows.
    """
    links = cut_lineage(links.select("a", "b").filter("a != b").distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        links = cut_lineage(_small_star(_large_star(links)))
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
