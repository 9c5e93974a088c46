"""Findings of the left-over colour audit, and the report drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetone.operators.inventory import nongray_images, nongray_shading_patterns, nongray_shadings
from pagetone.operators.intake import contents_flatten, readable
from pagetone.operators.scan import summarize_ops
from pagetone.operators.walk import MAX_DEPTH, PREFIXES
from pagetone.session import unguessed

# Pages in a report, and messages per page.
REPORT_PAGES = 40
REPORT_MESSAGES = 8
FINDING = ("doc_id", "page_no", "seq", "where", "kind", "message")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _count(with_sample: bool) -> Column:
    text = _text(F.col("kind"), " x", F.col("n").cast("string"))
    return _text(text, " (e.g. ", F.col("sample"), ")") if with_sample else text


def page_stream_findings(streams: DataFrame, contents: DataFrame) -> DataFrame:
    """Findings in the content streams of pages, in the order in which a page's contents name them.

    Streams are summed up where they lie; only their findings meet the pages. A stream that several pages name, or one
    page more than once, is reported at each place; unreadable and lost streams have no findings.
    """
    found = summarize_ops(readable(streams), keys=("doc_id", "stream_id"))
    uses = contents_flatten(contents.select("doc_id", "page_no", "contents")).filter("stream_id IS NOT NULL")
    seq = F.array(F.lit(0), F.col("ordinal"), F.col("stage"), F.col("first_idx")).cast("array<bigint>")
    return uses.join(unguessed(found), ["doc_id", "stream_id"]).select(
        "doc_id", "page_no", seq.alias("seq"), F.lit("").alias("where"), "kind",
        _text("page stream ", _count(True)).alias("message"))


def container_findings(walk: DataFrame, object_streams: DataFrame) -> DataFrame:
    """Operators found in the streams of containers, once per visit, with the ``role`` of the container.

    One scan of the streams serves all roles; a stream met in two roles is reported as either.
    """
    titles = {"form": "Form ", "tiling": "TilingPattern ", "softmask": "SMask "}
    found = summarize_ops(readable(object_streams), keys=("doc_id", "obj_no"))
    visits = walk.filter(F.col("role").isin(*PREFIXES)).select("doc_id", "obj_no", "page_no", "path", "where", "role")
    role, inner, title = F.col("role"), F.lit(0), F.lit("")
    for name, prefix in PREFIXES.items():
        inner, title = F.when(role == name, len(prefix)).otherwise(inner), F.when(role == name, titles[name]).otherwise(title)
    outside = F.substring("where", F.lit(1), F.length("where") - inner)
    seq = F.concat(F.array(F.lit(1).cast("bigint")), "path",
                   F.array(F.lit(-1), F.col("stage"), F.col("first_idx")).cast("array<bigint>"))
    message = _text(outside, title, F.when(role == "form", _count(True)).otherwise(_count(False)))
    return visits.join(unguessed(found), ["doc_id", "obj_no"]).select(
        "doc_id", "page_no", seq.alias("seq"), outside.alias("where"), "kind", message.alias("message"), "role")


def container_ops(walk: DataFrame, object_streams: DataFrame, role: str) -> DataFrame:
    """Findings in the streams of one kind of container."""
    return container_findings(walk.filter(F.col("role") == role), object_streams).drop("role")


def form_ops(walk: DataFrame, object_streams: DataFrame) -> DataFrame:
    return container_ops(walk, object_streams, "form")


def tiling_pattern_ops(walk: DataFrame, object_streams: DataFrame) -> DataFrame:
    return container_ops(walk, object_streams, "tiling")


def softmask_ops(walk: DataFrame, object_streams: DataFrame) -> DataFrame:
    return container_ops(walk, object_streams, "softmask")


def _place(found: DataFrame, walk: DataFrame, kind: str, message: Column) -> DataFrame:
    """Put findings on the pages whose opened dictionaries hold them."""
    opened = walk.filter(F.col("depth") <= MAX_DEPTH).select(
        "doc_id", F.col("obj_no").alias("parent_obj"), "page_no", "path", "where")
    seq = F.concat(F.array(F.lit(1).cast("bigint")), "path", F.array("rank"))
    return (found.join(unguessed(opened), ["doc_id", "parent_obj"])
            .select("doc_id", "page_no", seq.alias("seq"), "where", F.lit(kind).alias("kind"),
                    _text(F.col("where"), message).alias("message")))


def resource_findings(walk: DataFrame, entries: DataFrame, objects: DataFrame, labels: DataFrame,
                      object_streams: DataFrame) -> DataFrame:
    """Findings in the resources of pages, at any depth the walk opens."""
    image = _text("image ", F.col("name"), " CS=", F.col("label"), " Filter=", F.col("first_filter"),
                  " obj#", F.col("obj_no").cast("string"))
    shaded = _text(F.col("name"), " Type=", _shown(F.col("shading_type")), " CS=", F.col("label"))
    return (_place(nongray_images(entries, labels), walk, "image", image)
            .unionByName(_place(nongray_shadings(entries, labels), walk, "shading", _text("Shading ", shaded)))
            .unionByName(_place(nongray_shading_patterns(entries, objects, labels), walk,
                                "shading_pattern", _text("ShadingPattern ", shaded)))
            .unionByName(container_findings(walk, object_streams).drop("role")))


def residual_findings(page_findings: DataFrame, found_in_resources: DataFrame) -> DataFrame:
    """All findings; page streams come before resources."""
    return page_findings.select(*FINDING).unionByName(found_in_resources.select(*FINDING))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """The same message twice on a page counts once, at its first position."""
    return findings.groupBy("doc_id", "page_no", "message").agg(F.min("seq").alias("seq"))


def suspect_pages(findings: DataFrame) -> DataFrame:
    """Pages with any finding, per document: distinct pages first, so no document is one group."""
    return (findings.select("doc_id", "page_no").distinct()
            .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")))


def report_topk(distinct: DataFrame, pages: int = REPORT_PAGES, per_page: int = REPORT_MESSAGES) -> DataFrame:
    """First pages of each document, first messages of each page.

    Both ranks are limited by a constant, so each task drops all but the leading rows of a group before the
    shuffle: at most eight messages a page and forty pages a document leave any task.
    """
    by_position = Window.partitionBy("doc_id", "page_no").orderBy("seq", "message")
    by_page = Window.partitionBy("doc_id").orderBy("page_no")
    return (distinct.withColumn("message_rank", F.row_number().over(by_position))
            .filter(F.col("message_rank") <= per_page)
            .withColumn("page_rank", F.dense_rank().over(by_page)).filter(F.col("page_rank") <= pages)
            .select("doc_id", "page_no", "page_rank", "message_rank", "message"))


def report_overflow(findings: DataFrame, pages: int = REPORT_PAGES) -> DataFrame:
    """Pages a report leaves out, per document."""
    return suspect_pages(findings).select(
        "doc_id", F.greatest(F.col("n_pages") - pages, F.lit(0)).alias("n_more"))


def conversion_counts(status: DataFrame) -> DataFrame:
    """Streams done and streams in error, per document."""
    return status.groupBy("doc_id").agg(
        F.count_if(F.col("error").isNull()).alias("n_done"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"))
