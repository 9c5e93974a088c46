"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetone.functions import color
from pagetone.operators import intake, inventory, pages, raster, report, rewrite, scan, tokens, walk
from pagetone.plans import audit as jobs
from pagetone.session import shared_folder
from pagetone.sources import derived as D
from pagetone.sources.files import read_findings, write_findings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return add


def _joined(seq: str) -> Column:
    return F.array_join(F.transform(seq, lambda x: x.cast("string")), ".")


# --- A: intake, selection, sinks ---------------------------------------------------------------

@query("A1_intake")
def _(spark, sf):
    return intake.intake(D.intake(spark, sf)).select("doc_id", "path", "name", "ext")


@query("A2_route_format")
def _(spark, sf):
    return intake.route_format(D.intake(spark, sf)).select("doc_id", "ext", "family", "error")


@query("A3_intake_census")
def _(spark, sf):
    return intake.intake_census(D.intake(spark, sf))


@query("A4_select_pages")
def _(spark, sf):
    return intake.select_pages(D.page_requests(spark, sf)).select("doc_id", "page_no")


@query("A5_skipped_pages")
def _(spark, sf):
    return intake.skipped_pages(D.page_requests(spark, sf)).select("doc_id", "item", "page_no", "reason")


@query("A6_artifact_name")
def _(spark, sf):
    page = F.col("doc_id") % 7 + 1
    return D.intake(spark, sf).select("doc_id", intake.artifact_name(F.col("path"), page).alias("artifact"))


@query("A7_stream_readability")
def _(spark, sf):
    kind = intake.stream_readability(F.col("filter"))
    return D.streams(spark, sf).select("doc_id", "stream_id", kind.alias("readability"))


@query("A8_stream_eligibility")
def _(spark, sf):
    kind = intake.stream_eligibility(F.col("filter"))
    return D.streams(spark, sf).select("doc_id", "stream_id", kind.alias("eligibility"))


# --- B: text and tokens ------------------------------------------------------------------------

@query("B1_stream_text")
def _(spark, sf):
    text = tokens.stream_text(F.col("bytes"))
    return (D.rasters(spark, sf, dealt=True).filter("bytes IS NOT NULL").withColumn("text", text).select(
        "image_id", F.length("text").alias("n_chars"), F.ascii("text").alias("first_char"),
        F.ascii(F.substring("text", -1, 1)).alias("last_char"),
        (tokens.stream_bytes(F.col("text")) == F.col("bytes")).alias("same_bytes")))


@query("B2_mask_literals")
def _(spark, sf):
    clean = tokens.mask_literals(F.col("text"))
    return D.streams(spark, sf).select("doc_id", "stream_id", F.md5(clean).alias("clean_md5"))


@query("B3_protected_regions")
def _(spark, sf):
    return tokens.protected_regions(D.streams(spark, sf)).select("doc_id", "stream_id", "ordinal", "region", "kind")


@query("B4_tokenize")
def _(spark, sf):
    return (tokens.tokenize(D.streams(spark, sf)).groupBy("tok", "is_literal", "is_space", "is_number")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("bigint").alias("sum_pos")))


@query("B5_with_operands")
def _(spark, sf):
    first = F.round(F.get("args", F.lit(0)) * 100).cast("bigint")
    last = F.round(F.get("args", F.col("n_args") - 1) * 100).cast("bigint")
    return (tokens.with_operands(D.streams(spark, sf)).groupBy("doc_id", "op", "n_args", "name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("sum_first"), F.sum(last).alias("sum_last")))


@query("B6_contents_flatten")
def _(spark, sf):
    return intake.contents_flatten(D.contents(spark, sf)).select("doc_id", "page_no", "ordinal", "stream_id")


# --- C: left-over colour per operator --------------------------------------------------------------

def _ops(spark, sf, *stages):
    return scan.color_ops(D.streams(spark, sf), stages=stages)


_HIT = ("doc_id", "page_no", "stream_id", "op", "sample")


@query("C1_nongray_rgb")
def _(spark, sf):
    return scan.nongray_rgb(_ops(spark, sf, "rgb")).select(*_HIT)


@query("C2_nongray_cmyk")
def _(spark, sf):
    return scan.nongray_cmyk(_ops(spark, sf, "cmyk")).select(*_HIT)


@query("C3_nongray_generic3")
def _(spark, sf):
    return scan.nongray_generic3(_ops(spark, sf, "generic")).select(*_HIT)


@query("C4_nongray_generic4")
def _(spark, sf):
    return scan.nongray_generic4(_ops(spark, sf, "generic")).select(*_HIT)


@query("C5_colorspace_uses")
def _(spark, sf):
    return scan.colorspace_uses(_ops(spark, sf, "space")).select("doc_id", "stream_id", "name", "n")


@query("C6_pattern_uses")
def _(spark, sf):
    return scan.pattern_uses(_ops(spark, sf, "pattern")).select("doc_id", "stream_id", "name", "n")


@query("C7_inline_image_flag")
def _(spark, sf):
    return scan.inline_image_flag(D.streams(spark, sf)).select("doc_id", "stream_id", "n", "sample")


@query("C8_shading_op_flag")
def _(spark, sf):
    return scan.shading_op_flag(D.streams(spark, sf)).select("doc_id", "stream_id", "n", "sample")


@query("C9_summarize_ops")
def _(spark, sf):
    return scan.summarize_ops(D.streams(spark, sf)).select("doc_id", "page_no", "stream_id", "kind", "n", "sample")


# --- D: objects, colour spaces, graph ----------------------------------------------------------------

def _labels(spark, sf):
    return inventory.colorspace_label(D.cs_defs(spark, sf))


def _entries(spark, sf):
    return walk.resource_entries(D.edges(spark, sf), D.objects(spark, sf))


def _roots(spark, sf):
    return walk.page_roots(D.object_page_tree(spark, sf))


def _walk(spark, sf):
    return walk.resource_walk(_roots(spark, sf), _entries(spark, sf))


@query("D1_deref")
def _(spark, sf):
    objects = D.objects(spark, sf)
    return inventory.deref(objects.select("doc_id", "obj_no", "cs_obj"),
                           "cs_obj", objects.select("doc_id", "obj_no", "kind"), "kind")


@query("D2_colorspace_label")
def _(spark, sf):
    return _labels(spark, sf)


@query("D3_is_gray_space")
def _(spark, sf):
    return _labels(spark, sf).select("doc_id", "cs_obj", inventory.is_gray_space(F.col("label")).alias("is_gray"))


@query("D4_image_inventory")
def _(spark, sf):
    return inventory.image_inventory(D.objects(spark, sf), _labels(spark, sf))


@query("D4_page_images")
def _(spark, sf):
    images = inventory.image_inventory(D.objects(spark, sf), _labels(spark, sf))
    return inventory.page_images(_roots(spark, sf), _entries(spark, sf), images)


@query("D5_nongray_images")
def _(spark, sf):
    return inventory.nongray_images(_entries(spark, sf), _labels(spark, sf)).select(
        "doc_id", "parent_obj", "name", "label", "first_filter", "obj_no")


@query("D6_nongray_shadings")
def _(spark, sf):
    return inventory.nongray_shadings(_entries(spark, sf), _labels(spark, sf)).select(
        "doc_id", "parent_obj", "name", "label", "shading_type")


@query("D7_nongray_shading_patterns")
def _(spark, sf):
    return inventory.nongray_shading_patterns(
        _entries(spark, sf), D.objects(spark, sf), _labels(spark, sf)).select(
        "doc_id", "parent_obj", "name", "label", "shading_type")


def _container(role: str) -> Query:
    def run(spark, sf):
        return report.container_ops(_walk(spark, sf), D.object_streams(spark, sf), role).select(
            "doc_id", "page_no", _joined("seq").alias("seq"), "where", "kind", "message")
    return run


QUERIES["D8_tiling_pattern_ops"] = _container("tiling")
QUERIES["D9_form_ops"] = _container("form")
QUERIES["D10_softmask_ops"] = _container("softmask")


@query("D11_resource_reach")
def _(spark, sf):
    reach = walk.resource_reach(_roots(spark, sf), _entries(spark, sf))
    return reach.groupBy("doc_id", "obj_no").agg(
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"),
        F.count_distinct("depth").alias("n_depths"))


@query("D12_first_visit")
def _(spark, sf):
    return walk.first_visit(_walk(spark, sf)).select("doc_id", "role", "obj_no", "page_no", _joined("path").alias("path"))


@query("D13_inherited_resources")
def _(spark, sf):
    return walk.inherited_resources(D.page_tree(spark, sf))


@query("D14_images_to_convert")
def _(spark, sf):
    return inventory.images_to_convert(D.objects(spark, sf), D.cs_defs(spark, sf))


@query("D15_where_label")
def _(spark, sf):
    return _walk(spark, sf).select("doc_id", "page_no", "obj_no", "role", "depth", "where",
                                   _joined("path").alias("path"))


# --- E: report ---------------------------------------------------------------------------------------

def _audit(spark, sf):
    return jobs.audit(D.streams(spark, sf), D.page_contents(spark, sf), D.object_page_tree(spark, sf),
                      D.edges(spark, sf), D.objects(spark, sf), D.cs_defs(spark, sf), D.object_streams(spark, sf))


@query("E1_residual_findings")
def _(spark, sf):
    return _audit(spark, sf).select("doc_id", "page_no", _joined("seq").alias("seq"), "where", "kind", "message")


@query("E2_distinct_findings")
def _(spark, sf):
    return report.distinct_findings(_audit(spark, sf)).select(
        "doc_id", "page_no", "message", _joined("seq").alias("seq"))


@query("E3_suspect_pages")
def _(spark, sf):
    return report.suspect_pages(_audit(spark, sf))


@query("E4_report_topk")
def _(spark, sf):
    return report.report_topk(report.distinct_findings(_audit(spark, sf)))


@query("E5_report_overflow")
def _(spark, sf):
    return report.report_overflow(_audit(spark, sf))


@query("E6_conversion_counts")
def _(spark, sf):
    return report.conversion_counts(D.status(spark, sf))


# --- F: colour maths -----------------------------------------------------------------------------------

def _at(i: int) -> Column:
    return F.get("args", F.lit(i))


def _rgb_luma(spark, sf):
    return _ops(spark, sf, "rgb").select("doc_id", "stream_id", "sample", color.luma_rgb(_at(0), _at(1), _at(2)).alias("luma"))


@query("F1_luma_rgb")
def _(spark, sf):
    return _rgb_luma(spark, sf)


@query("F2_luma_cmyk")
def _(spark, sf):
    return _ops(spark, sf, "cmyk").select(
        "doc_id", "stream_id", "sample", color.luma_cmyk(_at(0), _at(1), _at(2), _at(3)).alias("luma"))


def _row_sums(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("image_id", "y").agg(
        F.sum(value).cast("bigint").alias("total"),
        F.sum(F.col(value) * (F.col("x") + 1)).cast("bigint").alias("weighted"))


def _raw_pixels(spark, sf):
    return raster.unpack_pixels(D.rasters(spark, sf, dealt=True))


def _raw_gray(spark, sf):
    return raster.pixels_to_gray(_raw_pixels(spark, sf))


@query("F3_luma_rgb8")
def _(spark, sf):
    gray = color.luma_rgb8(F.col("c1"), F.col("c2"), F.col("c3"))
    return _row_sums(_raw_pixels(spark, sf).filter("c4 IS NULL").withColumn("gray", gray), "gray")


@query("F4_luma_cmyk8")
def _(spark, sf):
    gray = color.luma_cmyk8(F.col("c1"), F.col("c2"), F.col("c3"), F.col("c4"))
    return _row_sums(_raw_pixels(spark, sf).filter("c4 IS NOT NULL").withColumn("gray", gray), "gray")


@query("F5_dot_gain")
def _(spark, sf):
    luma = F.col("luma")
    return _rgb_luma(spark, sf).select(
        "doc_id", "stream_id", "sample", *[color.dot_gain(luma, g).alias(f"gain{g}") for g in (0, 10, 20, 25)])


@query("F6_dot_gain_lut")
def _(spark, sf):
    tables = color.dot_gain_lut(spark, 0)
    for gain in (20, 25):
        tables = tables.unionByName(color.dot_gain_lut(spark, gain))
    levels = _raw_gray(spark, sf).groupBy(F.col("gray").alias("v_in")).agg(F.count(F.lit(1)).alias("n"))
    return tables.join(levels, "v_in", "left").select("gain", "v_in", "v_out", F.coalesce("n", F.lit(0)).alias("n"))


@query("F7_apply_lut")
def _(spark, sf):
    return _row_sums(color.apply_lut(_raw_gray(spark, sf), color.dot_gain_lut(spark, 20)), "gray")


@query("F8_compose_luts")
def _(spark, sf):
    tint = F.col("id").cast("int")
    info = F.struct(F.lit(2.0).alias("fn_n"), F.array(F.lit(0.0)).alias("c0"), F.array(F.lit(1.0)).alias("c1"),
                    F.lit("/DeviceGray").alias("alt"))
    table = spark.range(256).select(tint.alias("v_in"), color.round_half_up(
        color.tint_to_gray(tint / F.lit(255.0), info) * F.lit(255.0)).alias("v_out"))
    both = color.compose_luts(table, color.dot_gain_lut(spark, 25))
    return _row_sums(color.apply_lut(_raw_gray(spark, sf), both), "gray")


@query("F8_tint_tables")
def _(spark, sf):
    return color.tint_tables(D.colorspaces(spark, sf)).select(
        "doc_id", "space", _array_sum(F.col("tint"), False).alias("total"), _array_sum(F.col("tint"), True).alias("weighted"))


def _tints(spark, sf):
    """Every named space at eleven tints."""
    return (D.colorspaces(spark, sf).filter("c0 IS NOT NULL")
            .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(10))))
            .withColumn("t", F.col("step") / F.lit(10.0)))


@query("F9_tint_channels")
def _(spark, sf):
    channels = color.tint_channels(F.col("t"), F.col("fn_n"), F.col("c0"), F.col("c1"))
    return (_tints(spark, sf).select("doc_id", "name", "step", F.posexplode(channels).alias("ch", "v"))
            .select("doc_id", "name", "step", "ch", color.gray4_text(F.col("v")).alias("v")))


@query("F10_tint_to_gray")
def _(spark, sf):
    info = F.struct("fn_n", "c0", "c1", "alt")
    return _tints(spark, sf).select(
        "doc_id", "name", "step",
        *[color.gray4_text(color.tint_to_gray(F.col("t"), info, g)).alias(f"gain{g}") for g in (0, 20)])


@query("F11_gray4")
def _(spark, sf):
    return _rgb_luma(spark, sf).select("doc_id", "stream_id", "sample", color.gray4_text(F.col("luma")).alias("text"),
                                       color.gray4(F.col("luma")).alias("value"))


# --- G: gray rewrite -----------------------------------------------------------------------------------

def _calls(spark, sf, mode="segment"):
    return rewrite.current_colorspace(D.streams(spark, sf), mode)


@query("G1_current_colorspace")
def _(spark, sf):
    return _calls(spark, sf).select("doc_id", "stream_id", "segment", "ordinal", "call", "space")


@query("G1_current_colorspace_position")
def _(spark, sf):
    return _calls(spark, sf, "position").select("doc_id", "stream_id", "call", "space")


@query("G2_rewrite_fixed")
def _(spark, sf):
    return rewrite.rewrite_fixed(_calls(spark, sf), 20).select("doc_id", "stream_id", "call", "gray", "gray_op")


@query("G3_rewrite_generic")
def _(spark, sf):
    return rewrite.rewrite_generic(_calls(spark, sf)).select("doc_id", "stream_id", "call", "gray", "gray_op")


@query("G4_tint_lookup")
def _(spark, sf):
    return rewrite.tint_lookup(_calls(spark, sf), D.colorspaces(spark, sf), 25).select(
        "doc_id", "stream_id", "call", "space", "gray", "gray_op")


@query("G5_drop_colorspace_ops")
def _(spark, sf):
    return rewrite.drop_colorspace_ops(rewrite.colorspace_ops(D.streams(spark, sf)), D.colorspaces(spark, sf)).select(
        "doc_id", "stream_id", "segment", "ordinal", "name", "op")


@query("G6_rewrite_streams")
def _(spark, sf):
    streams = rewrite.attach_colorspaces(D.streams(spark, sf), D.colorspaces(spark, sf))
    return rewrite.rewrite_streams(streams, 20).select(
        "doc_id", "stream_id", F.md5("gray_text").alias("gray_md5"), "n_rewritten", "error")


@query("G7_inline_image_table")
def _(spark, sf):
    return rewrite.inline_image_table(D.streams(spark, sf)).select(
        "doc_id", "stream_id", "ordinal", "w", "h", "bpc", "space", "image_filter")


@query("G8_inline_image_route")
def _(spark, sf):
    return rewrite.inline_image_route(rewrite.inline_image_table(D.streams(spark, sf))).select(
        "doc_id", "stream_id", "ordinal", "channels", "route", "payload_bytes")


@query("G9_rewrite_audit")
def _(spark, sf):
    return jobs.rewrite_audit(jobs.gray_streams(D.streams(spark, sf), D.colorspaces(spark, sf)))


# --- H: rasters --------------------------------------------------------------------------------------

@query("H1_raster_status")
def _(spark, sf):
    return raster.raster_status(D.rasters(spark, sf, with_bytes=False)).select("image_id", "expected_len", "status")


@query("H2_pad_rule")
def _(spark, sf):
    return raster.pad_rule(D.rasters(spark, sf, with_bytes=False)).select("image_id", "fill", "n_missing")


@query("H3_unpack_pixels")
def _(spark, sf):
    samples = raster.unpack_samples(_raw_pixels(spark, sf))
    return samples.groupBy("image_id", "y", "ch").agg(
        F.max("tag").alias("tag"), F.count(F.lit(1)).alias("n"), F.sum("v").cast("bigint").alias("total"),
        F.sum(F.col("v") * (F.col("x") + 1)).cast("bigint").alias("weighted"))


def _tiles(spark, sf):
    return raster.unpack_tiles(D.rasters(spark, sf, dealt=True))


def _array_sum(values: Column, weighted: bool) -> Column:
    """Sum of an array, each value times its place from 1 if ``weighted``."""
    terms = F.transform(values, lambda v, i: (v * (i + 1 if weighted else F.lit(1))).cast("bigint"))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def _gray_row_sums(tiles: DataFrame, value: str = "g") -> DataFrame:
    """Sums of every gray row, taken where the row lies."""
    return tiles.select("image_id", F.explode("rows").alias("r")).select(
        "image_id", "r.y", _array_sum(F.col(f"r.{value}"), False).alias("total"), _array_sum(F.col(f"r.{value}"), True).alias("weighted"))


def _channel_sums(rows: DataFrame, *further: str) -> DataFrame:
    """Weighted sums of every channel of a row, taken where the row lies."""
    def channel(k: int) -> Column:
        own = F.filter("v", lambda x, i: i % F.col("channels") == k)
        return F.when(F.col("channels") > k, _array_sum(own, True))

    return rows.select("image_id", "y", *[channel(k).alias(c) for k, c in enumerate(raster.CHANNELS)], *further)


@query("H4_pixels_to_gray")
def _(spark, sf):
    return _gray_row_sums(raster.gray_tiles(raster.decode_tiles(_tiles(spark, sf)), 25))


@query("H5_delta_decode")
def _(spark, sf):
    return _channel_sums(raster.tile_rows(raster.delta_decode(_tiles(spark, sf).filter("filter_mode = 'tiff'"))))


@query("H6_delta_encode")
def _(spark, sf):
    return _gray_row_sums(raster.delta_encode(raster.gray_tiles(raster.decode_tiles(_tiles(spark, sf)))))


@query("H7_row_delta_decode")
def _(spark, sf):
    return _channel_sums(raster.row_delta_decode(D.rasters(spark, sf, dealt=True)), "error")


@query("H8_gray_histogram")
def _(spark, sf):
    return raster.gray_histogram(jobs.gray_rasters(D.rasters(spark, sf, dealt=True)))


def _shown_images(images: DataFrame) -> DataFrame:
    return images.select("image_id", "w", "h", F.length("gray").alias("n_bytes"), F.md5(F.hex("gray").cast("binary")).alias("gray_md5"), "error")


@query("H9_gray_images")
def _(spark, sf):
    """Every raster as it is written back, or why not."""
    return _shown_images(jobs.gray_images(D.rasters(spark, sf, dealt=True), 20))


@query("H10_tinted_images")
def _(spark, sf):
    return _shown_images(jobs.gray_images(D.tint_rasters(spark, sf), 25, D.colorspaces(spark, sf)))


# --- I: page classes, quote, edits ----------------------------------------------------------------------

def _classes(spark, sf):
    image = F.col("image_id")
    return pages.page_class(raster.tile_pixels(raster.decode_tiles(_tiles(spark, sf))).select(
        F.floor(image / 16).alias("doc_id"), (F.floor(image % 16 / 2) + 1).alias("page_no"),
        F.col("c1").alias("r"), F.col("c2").alias("g"), F.col("c3").alias("b")))


@query("I1_page_class")
def _(spark, sf):
    return _classes(spark, sf)


@query("I2_doc_color_summary")
def _(spark, sf):
    return pages.doc_color_summary(_classes(spark, sf))


@query("I3_print_quote")
def _(spark, sf):
    return pages.print_quote(pages.doc_color_summary(_classes(spark, sf)), D.prices(spark))


@query("I4_fold_page_edits")
def _(spark, sf):
    return pages.fold_page_edits(D.editable_pages(spark, sf), D.page_edits(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages still print in colour, and why."""
    return QUERIES["C9_summarize_ops"](spark, sf_dir)


@query("A9_write_findings")
def _(spark, sf):
    """All findings of the audit, written and read again."""
    path = f"{shared_folder(spark).rstrip('/')}/findings-{uuid.uuid4()}"
    write_findings(_audit(spark, sf).select("doc_id", "page_no", "where", "kind", "message"), path)
    return read_findings(spark, path).groupBy("where", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("message").alias("n_messages"))
