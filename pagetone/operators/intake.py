"""Document intake, page selection and stream eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted extensions by family.
FAMILIES = {
    "pdf": ("pdf",),
    "hwp": ("hwp", "hwpx"),
    "word": ("doc", "docx"),
    "excel": ("xls", "xlsx"),
    "powerpoint": ("ppt", "pptx"),
}
ACCEPTED = tuple(ext for exts in FAMILIES.values() for ext in exts)
FLATE_FILTERS = ("/FlateDecode", "/Fl")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def intake(paths: DataFrame) -> DataFrame:
    """Documents with one of the accepted extensions."""
    return (paths.withColumn("name", base_name(F.col("path"))).withColumn("ext", extension(F.col("path")))
            .filter(F.col("ext").isin(*ACCEPTED)))


def route_format(paths: DataFrame) -> DataFrame:
    """Family of every document; an unknown extension is a row with an error, not a failure."""
    ext = extension(F.col("path"))
    family = F.lit(None).cast("string")
    for name, exts in FAMILIES.items():
        family = F.when(ext.isin(*exts), name).otherwise(family)
    return (paths.withColumn("ext", ext).withColumn("family", family)
            .withColumn("error", F.when(F.col("family").isNull(),
                                        F.concat(F.lit("unsupported format: ."), "ext"))))


def intake_census(paths: DataFrame) -> DataFrame:
    """Number and bytes of documents per family."""
    return (route_format(paths).groupBy("family")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")))


def _requested(requests: DataFrame) -> DataFrame:
    number = F.trim(F.col("item")).try_cast("int")
    return (requests.select("*", F.explode(F.split("page_list", ",", -1)).alias("item"))
            .withColumn("page_no", number).drop("page_list"))


def select_pages(requests: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Requested pages inside the document; with ``pages``, only those that exist there."""
    kept = _requested(requests).filter("page_no BETWEEN 1 AND page_count").drop("item")
    return kept if pages is None else kept.join(pages, ["doc_id", "page_no"])


def skipped_pages(requests: DataFrame) -> DataFrame:
    """Requests that give no page, with the reason: not a page number, or outside the document."""
    outside = F.coalesce(~F.col("page_no").between(1, F.col("page_count")), F.lit(True))
    return _requested(requests).filter(outside).withColumn(
        "reason", F.when(F.col("page_no").isNull(), "no page number").otherwise("outside the document"))


def missing_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested pages that the page table does not hold."""
    return _requested(requests).filter("page_no IS NOT NULL").drop("item").join(pages, ["doc_id", "page_no"], "left_anti")


def artifact_name(path: Column, page_no: Column) -> Column:
    """File name of one rendered page: word characters and Hangul stay, others become ``_``."""
    base = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    safe = F.regexp_replace(base, r"(?U)[^\w가-힣]", "_")
    return F.concat(safe, F.lit("_p"), page_no.cast("string"), F.lit(".png"))


def stream_readability(filters: Column) -> Column:
    """flate, raw or unreadable, by the first filter."""
    first = F.get(filters, F.lit(0))
    return (F.when(first.isNull(), "raw").when(first.isin(*FLATE_FILTERS), "flate")
             .otherwise("unreadable"))


def stream_eligibility(filters: Column) -> Column:
    """Rewriter rule: no filter, or exactly one inflatable filter; anything else is skipped."""
    return (F.when(filters.isNull(), "raw")
             .when((F.size(filters) == 1) & F.get(filters, F.lit(0)).isin(*FLATE_FILTERS), "flate")
             .otherwise("skipped"))


def readable(streams: DataFrame) -> DataFrame:
    return streams.filter(stream_readability(F.col("filter")) != "unreadable")


def contents_flatten(pages: DataFrame) -> DataFrame:
    """One row per stream of a page, in order; a page without content keeps one empty row."""
    return pages.select(*[c for c in pages.columns if c != "contents"],
                        F.posexplode_outer("contents").alias("ordinal", "stream_id"))
