"""Indirect objects, colour spaces and the images, shadings and patterns that use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.session import cut_lineage, unguessed

# Labels that count as gray, and the plain names that need no conversion.
NO_SPACE, UNKNOWN_SPACE = "(none)", "(?)"
GRAY_LABELS = ("/DeviceGray", "/CalGray", "[/ICCBased N=1]", NO_SPACE)
GRAY_NAMES = ("/DeviceGray", "/CalGray")
TINTED = ("/Separation", "/DeviceN")


def deref(df: DataFrame, column: str, objects: DataFrame, value: str) -> DataFrame:
    """Add ``<column>_value``: the value of the object referred to, or the reference when there is none."""
    target = objects.select("doc_id", F.col("obj_no").alias(column), F.col(value).alias("_value"))
    return (df.join(unguessed(target), ["doc_id", column], "left")
            .withColumn(f"{column}_value", F.coalesce(F.col("_value"), F.col(column).cast("string")))
            .drop("_value"))


def follow_links(nodes: DataFrame, key: str, link: str,
                 merge: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]],
                 ) -> DataFrame:
    """Resolve chains of links inside each document by pointer doubling.

    Every round joins the open rows to what they point at and doubles the distance covered, so a chain of
    length n takes log2(n) rounds and no depth limit is needed. A row is closed when its link is NULL. As
    long as one finite chain is open some row closes in the next round, so a round without progress means
    that only cycles are left; their link stays set.
    """
    state = cut_lineage(nodes)
    is_open = F.col(link).isNotNull()
    pending = state.filter(is_open).count()
    while pending:
        target = state.select("doc_id", F.col(key).alias(link),
                              *[F.col(c).alias(f"_to_{c}") for c in state.columns if c != "doc_id"])
        merged = merge(F.col, lambda c: F.col(f"_to_{c}"))
        step = (state.filter(is_open).join(unguessed(target), ["doc_id", link], "left")
                .select(*[merged[c].alias(c) if c in merged else F.col(c) for c in state.columns]))
        state = cut_lineage(state.filter(~is_open).unionByName(step))
        left = state.filter(is_open).count()
        if left == pending:
            break
        pending = left
    return state


def colorspace_label(cs_defs: DataFrame) -> DataFrame:
    """Readable label of every colour-space definition; base and alternate are labelled inside it.

    A definition inside a reference cycle has a NULL label.
    """
    family, n, size = F.col("family"), F.col("n"), F.col("size")
    inner = F.when(family == "/Indexed", F.col("base_obj")).when(family.isin(*TINTED), F.col("alt_obj"))
    nested = (size > 0) & family.isin("/Indexed", *TINTED)
    opening = F.when(family == "/Indexed", "[/Indexed base=").otherwise(F.concat(F.lit("["), family, F.lit(" alt=")))
    prefix = (F.when(size.isNull(), F.coalesce(family, F.lit(NO_SPACE)))
               .when(size <= 0, UNKNOWN_SPACE)
               .when(nested & inner.isNotNull(), opening)
               .when(nested, F.concat(opening, F.lit(NO_SPACE)))
               .when(family == "/ICCBased", F.concat(F.lit("[/ICCBased N="),
                                                     F.coalesce(n.cast("string"), F.lit("null")), F.lit("]")))
               .otherwise(F.concat(F.lit("["), F.coalesce(family, F.lit("?")), F.lit(" size="),
                                   size.cast("string"), F.lit("]"))))
    nodes = cs_defs.select("doc_id", "cs_obj", prefix.alias("prefix"),
                           F.when(nested, "]").otherwise("").alias("suffix"),
                           F.when(nested, inner).alias("link"))

    def merge(own, to):
        return {"prefix": F.concat(own("prefix"), F.coalesce(to("prefix"), F.lit(UNKNOWN_SPACE))),
                "suffix": F.concat(F.coalesce(to("suffix"), F.lit("")), own("suffix")),
                "link": to("link")}

    return follow_links(nodes, "cs_obj", "link", merge).select(
        "doc_id", "cs_obj", F.when(F.col("link").isNull(), F.concat("prefix", "suffix")).alias("label"))


def is_gray_space(label: Column) -> Column:
    """Gray labels; an Indexed space on a gray base is not one of them."""
    return label.isin(*GRAY_LABELS)


def with_label(df: DataFrame, labels: DataFrame, column: str = "cs_obj") -> DataFrame:
    """Add ``label``: no reference is ``(none)``, a reference to nothing ``(?)``."""
    found = labels.select("doc_id", F.col("cs_obj").alias(column), F.col("label").alias("_label"),
                          F.lit(True).alias("_known"))
    return (df.join(unguessed(found), ["doc_id", column], "left")
            .withColumn("label", F.when(F.col(column).isNull(), NO_SPACE)
                                  .when(F.col("_known").isNull(), UNKNOWN_SPACE).otherwise(F.col("_label")))
            .drop("_label", "_known"))


def _first_filter(filters: Column) -> Column:
    return F.coalesce(F.get(filters, F.lit(0)), F.lit(""))


def image_inventory(objects: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, colour space, filters and flags of every image."""
    shown = (F.when(F.col("filter").isNull(), "none")
              .otherwise(F.concat(F.lit("["), F.array_join("filter", ","), F.lit("]"))))
    images = objects.filter(F.col("subtype") == "/Image")
    return with_label(images, labels).select(
        "doc_id", "obj_no", "w", "h", "label", shown.alias("filters"),
        F.coalesce("is_mask", F.lit(False)).alias("is_mask"), "has_smask", "has_decode", "length")


def page_images(roots: DataFrame, entries: DataFrame, images: DataFrame) -> DataFrame:
    """The image inventory by page and resource name: the images that a page's own dictionary names.

    An image under two names, or on two pages, is one row at each. ``roots``: (doc_id, page_no, resources_obj).
    """
    named = entries.filter("role = 'image'").select("doc_id", F.col("parent_obj").alias("resources_obj"), "obj_no", "name")
    return (roots.join(unguessed(named), ["doc_id", "resources_obj"]).drop("resources_obj")
            .join(unguessed(images), ["doc_id", "obj_no"]).select("doc_id", "page_no", "name", *[c for c in images.columns if c != "doc_id"]))


def nongray_images(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Image entries in a space that is not gray and without an ImageMask entry of any value."""
    images = entries.filter((F.col("role") == "image") & F.col("is_mask").isNull())
    return (with_label(images, labels).filter(~is_gray_space(F.col("label")))
            .withColumn("first_filter", _first_filter(F.col("filter"))))


def nongray_shadings(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Shading entries in a space that is not gray."""
    shadings = entries.filter(F.col("role") == "shading")
    return with_label(shadings, labels).filter(~is_gray_space(F.col("label")))


def nongray_shading_patterns(entries: DataFrame, objects: DataFrame, labels: DataFrame) -> DataFrame:
    """Pattern entries that paint a shading in a space that is not gray; a lost shading shows as ``?``."""
    target = objects.select("doc_id", F.col("obj_no").alias("target_obj"),
                            F.col("shading_type").alias("_type"), F.col("cs_obj").alias("_cs"),
                            F.lit(True).alias("_found"))
    painted = (entries.filter(F.col("role") == "shading_pattern")
               .join(unguessed(target), ["doc_id", "target_obj"], "left")
               .withColumn("shading_type", F.col("_type")).withColumn("cs_obj", F.col("_cs")))
    return (with_label(painted, labels)
            .withColumn("label", F.when(F.col("_found").isNull(), "?").otherwise(F.col("label")))
            .drop("_type", "_cs", "_found").filter(~is_gray_space(F.col("label"))))


def images_to_convert(objects: DataFrame, cs_defs: DataFrame) -> DataFrame:
    """All images with a colour space other than the two plain gray names."""
    plain = cs_defs.select("doc_id", "cs_obj", F.when(F.col("size").isNull(), F.col("family")).alias("plain"))
    images = objects.filter((F.col("subtype") == "/Image") & F.col("cs_obj").isNotNull())
    return (images.join(unguessed(plain), ["doc_id", "cs_obj"], "left")
            .filter(~F.coalesce(F.col("plain").isin(*GRAY_NAMES), F.lit(False)))
            .select("doc_id", "obj_no", "cs_obj"))
