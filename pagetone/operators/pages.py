"""Page classes, print quotes and page edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a page is gray when at most this many of a million pixels are coloured.
COLOR_PARTS_PER_MILLION = 1


def is_color_pixel(r: Column, g: Column, b: Column, tol: int = 0) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b) > tol


def page_class(pixels: DataFrame, tol: int = 0) -> DataFrame:
    """Colour or gray, per page. Counts stay integers, so a page exactly on the limit is gray."""
    color = is_color_pixel(F.col("r"), F.col("g"), F.col("b"), tol)
    return (pixels.groupBy("doc_id", "page_no")
            .agg(F.count_if(color).alias("color_px"), F.count(F.lit(1)).alias("total_px"))
            .withColumn("is_gray", F.col("color_px") * 1000000 <= F.col("total_px") * COLOR_PARTS_PER_MILLION))


def doc_color_summary(classes: DataFrame) -> DataFrame:
    """Colour and gray pages per document."""
    return classes.groupBy("doc_id").agg(F.count_if(~F.col("is_gray")).alias("n_color"),
                                         F.count_if(F.col("is_gray")).alias("n_gray"))


def print_quote(summary: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per document: each count times its unit price. The two prices are scalar subqueries."""
    def price(kind: str) -> Column:
        return prices.filter(F.col("kind") == kind).select(F.max("unit_price")).scalar()

    cost = F.col("n_color") * price("color") + F.col("n_gray") * price("gray")
    return summary.select("doc_id", "n_color", "n_gray", cost.cast("decimal(18,2)").alias("cost"))


def fold_page_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages after all edits.

    The last of delete and undo decides, rotations add up, the last move sets the place, and every insert
    is a blank page of its own. The result is ordered by (order_key, page_no, blank_seq); sort where it is
    shown, so a long document never has to meet in one task.
    """
    action, seq = F.col("action"), F.col("seq")
    folded = edits.filter(action != "insert").groupBy("doc_id", "page_no").agg(
        F.max_by(F.when(action.isin("delete", "undo"), action), F.when(action.isin("delete", "undo"), seq))
         .alias("last_state"),
        F.sum(F.when(action == "rotate", F.col("degrees")).otherwise(0)).alias("turn"),
        F.max_by(F.when(action == "move", F.col("order_key")), F.when(action == "move", seq)).alias("moved_to"))
    kept = (pages.join(folded, ["doc_id", "page_no"], "left")
            .filter(F.coalesce(F.col("last_state") != "delete", F.lit(True)))
            .select("doc_id", "page_no", F.lit(None).cast("bigint").alias("blank_seq"),
                    F.coalesce("moved_to", F.col("page_no").cast("double")).alias("order_key"),
                    F.pmod(F.coalesce("turn", F.lit(0)), F.lit(360)).cast("int").alias("rotation")))
    documents = pages.select("doc_id").distinct()
    blanks = (edits.filter(action == "insert").join(documents, "doc_id", "left_semi")
              .select("doc_id", F.lit(None).cast("int").alias("page_no"), seq.alias("blank_seq"), "order_key",
                      F.lit(0).alias("rotation")))
    return kept.unionByName(blanks)
