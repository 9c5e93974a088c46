"""Walk of nested page resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.operators.inventory import follow_links
from pagetone.session import cut_lineage, unguessed

# Deepest level of nesting that is inspected, and the prefix each container adds.
MAX_DEPTH = 5
PREFIXES = {"form": "Form>", "tiling": "Tile>", "softmask": "SMask>"}
# Order in which the resources of one dictionary are read.
CATEGORY_RANK = {"XObject": 0, "Shading": 1, "Pattern": 2, "ExtGState": 3}
CONTAINERS = tuple(PREFIXES)
VISITED_ONCE = ("form", "softmask")


def resource_entries(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries of resource dictionaries with the object they lead to, its role and its place in the order.

    A graphics state leads to the group of its soft mask, over two more references.
    """
    rank = F.lit(None).cast("bigint")
    for category, number in CATEGORY_RANK.items():
        rank = F.when(F.col("category") == category, F.lit(number << 32)).otherwise(rank)
    ranked = edges.withColumn("rank", rank + F.col("ordinal")).select(
        "doc_id", "parent_obj", F.col("child_obj").alias("obj_no"), "category", "name", "rank")
    attributes = ["kind", "subtype", "cs_obj", "filter", "is_mask", "shading_type", "pattern_type", "target_obj"]
    lookup = objects.select("doc_id", "obj_no", *attributes)
    category = F.col("category")
    role = (F.when((category == "XObject") & (F.col("subtype") == "/Image"), "image")
             .when((category == "XObject") & (F.col("subtype") == "/Form"), "form")
             .when(category == "Shading", "shading")
             .when((category == "Pattern") & (F.col("pattern_type") == 2), "shading_pattern")
             .when((category == "Pattern") & (F.col("pattern_type") == 1), "tiling"))
    direct = (ranked.filter(category != "ExtGState").join(unguessed(lookup), ["doc_id", "obj_no"])
              .withColumn("role", role).filter(F.col("role").isNotNull()))

    state = objects.filter("kind = 'ExtGState' AND target_obj IS NOT NULL").select(
        "doc_id", "obj_no", F.col("target_obj").alias("mask_obj"))
    mask = objects.filter("kind = 'SMask' AND target_obj IS NOT NULL").select(
        "doc_id", F.col("obj_no").alias("mask_obj"), F.col("target_obj").alias("group_obj"))
    group = lookup.withColumnRenamed("obj_no", "group_obj")
    masked = (ranked.filter(category == "ExtGState").join(unguessed(state), ["doc_id", "obj_no"])
              .join(unguessed(mask), ["doc_id", "mask_obj"]).join(unguessed(group), ["doc_id", "group_obj"])
              .withColumn("obj_no", F.col("group_obj")).withColumn("role", F.lit("softmask")))
    columns = ["doc_id", "parent_obj", "obj_no", "category", "name", "rank", "role", *attributes]
    return direct.select(*columns).unionByName(masked.select(*columns))


_ROW = ("page_no", "path", "where", "anchor_role", "anchor_obj", "anchor_path", "up_role", "up_obj", "up_path")


def _expand(roots: DataFrame, containers: DataFrame, max_depth: int, first: DataFrame | None) -> DataFrame:
    """Resource dictionaries level by level, and one level more: containers there are seen, not opened.

    Pages that share a dictionary start as one row, with the first of them as ``page_no``; ``_on_every_page`` brings
    the others back. A container that is visited once keeps, per level and document, only its smallest (page, path), and
    only the smallest place of a dictionary is joined with its entries; a tiling keeps one path per page, label and
    anchor. The anchor is the nearest container that is visited once, ``up`` the anchor of the container above.
    With ``first``, only the given first visits are opened. Every level is cut off the plan, so each is
    computed once.
    """
    level = roots.groupBy("doc_id", F.col("resources_obj").alias("obj_no")).agg(F.min("page_no").alias("page_no")).select(
        "doc_id", "obj_no", "page_no",
        F.array().cast("array<bigint>").alias("path"), F.lit("").alias("where"),
        F.lit(None).cast("string").alias("anchor_role"), F.lit(None).cast("int").alias("anchor_obj"),
        F.array().cast("array<bigint>").alias("anchor_path"), F.lit(None).cast("string").alias("up_role"),
        F.lit(None).cast("int").alias("up_obj"), F.array().cast("array<bigint>").alias("up_path"),
        F.lit("page").alias("role"))
    levels = [level.withColumn("depth", F.lit(0))]
    links = containers.select("doc_id", F.col("parent_obj").alias("_parent"), F.col("obj_no").alias("_obj"),
                              F.col("rank"), F.col("role").alias("_role"))
    once = F.col("_role").isin(*VISITED_ONCE)
    place = ("page_no", "path", "where", "anchor_role", "anchor_obj", "anchor_path")

    def step(source: DataFrame, children: DataFrame) -> DataFrame:
        path = F.concat("path", F.array("rank"))
        return source.withColumnRenamed("obj_no", "_parent").join(children, ["doc_id", "_parent"]).select(
            "doc_id", F.col("_obj").alias("obj_no"), F.col("_role").alias("role"), "page_no",
            path.alias("path"), where_label(F.col("_role"), F.col("where")).alias("where"),
            F.when(once, F.col("_role")).otherwise(F.col("anchor_role")).alias("anchor_role"),
            F.when(once, F.col("_obj")).otherwise(F.col("anchor_obj")).alias("anchor_obj"),
            F.when(once, path).otherwise(F.col("anchor_path")).alias("anchor_path"),
            F.col("anchor_role").alias("up_role"), F.col("anchor_obj").alias("up_obj"), F.col("anchor_path").alias("up_path"),
            F.when(~once, F.struct("page_no", "where", "anchor_role", "anchor_obj", "anchor_path")).alias("_apart"))

    for depth in range(1, max_depth + 2):
        source = levels[-1]
        if first is not None:
            source = _keep_first(source, first)
        nearest = source.groupBy("doc_id", "obj_no").agg(F.min(F.struct(*place)).alias("v")).select("doc_id", "obj_no", "v.*")
        found = step(nearest, links.filter(once)).unionByName(step(source, links.filter(~once)))
        level = cut_lineage(found.groupBy("doc_id", "obj_no", "role", "_apart")
                            .agg(F.min(F.struct(*_ROW)).alias("v")).select("doc_id", "obj_no", "role", "v.*"))
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels)


def _on_every_page(reach: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows that hang under no first visit, on every page that shares their root dictionary."""
    first = roots.groupBy("doc_id", "resources_obj").agg(F.min("page_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    pages = (roots.join(first.filter("_n > 1"), ["doc_id", "resources_obj"])
             .select("doc_id", F.col("_first").alias("page_no"), F.col("page_no").alias("_page")))
    shown = reach.join(pages, (reach["doc_id"] == pages["doc_id"]) & (reach["page_no"] == pages["page_no"])
                       & reach["anchor_obj"].isNull(), "left")
    return shown.select(*[F.coalesce("_page", reach["page_no"]).alias(c) if c == "page_no" else reach[c] for c in reach.columns])


def first_visit(reach: DataFrame) -> DataFrame:
    """First (page, path) of every container that is visited once per document and role.

    An object that serves as a form and as a group is met once as either.
    """
    return (reach.filter(F.col("role").isin(*VISITED_ONCE)).groupBy("doc_id", "role", "obj_no")
            .agg(F.min(F.struct("page_no", "path", "up_role", "up_obj", "up_path")).alias("v"))
            .select("doc_id", "role", "obj_no", "v.*"))


def _keep_first(reach: DataFrame, first: DataFrame) -> DataFrame:
    """Rows that hang under pages or under first visits."""
    seen = first.select("doc_id", F.col("role").alias("anchor_role"), F.col("obj_no").alias("anchor_obj"),
                        F.col("page_no").alias("_page"), F.col("path").alias("_path"))
    at_first = (F.col("page_no") == F.col("_page")) & (F.col("anchor_path") == F.col("_path"))
    return (reach.join(seen, ["doc_id", "anchor_role", "anchor_obj"], "left")
            .filter(F.col("anchor_obj").isNull() | at_first).select(*reach.columns))


def resource_reach(roots: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All reachable dictionaries, before the once-per-document rule; of pages that share one, the first is shown."""
    containers = entries.filter(F.col("role").isin(*CONTAINERS))
    return _expand(roots, containers, max_depth, None).filter(F.col("depth") <= max_depth)


def resource_walk(roots: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Containers in the order a depth-first reader meets them, forms and groups once per document each.

    Rows with ``depth`` up to ``max_depth`` are dictionaries it opens; deeper ones it only scans.

    The first visit in depth-first order is the smallest path over all paths, as long as every first visit
    lies under another first visit. Only the depth limit can break that, by cutting the subtree of an earlier,
    deeper visit. Then the first visits are found again, opening only first visits, until nothing changes.
    """
    containers = cut_lineage(entries.filter(F.col("role").isin(*CONTAINERS))
                             .select("doc_id", "parent_obj", "obj_no", "rank", "role"))
    roots = cut_lineage(roots.select("doc_id", "page_no", "resources_obj").filter("resources_obj IS NOT NULL").distinct())
    reach = _expand(roots, containers, max_depth, None)
    first = cut_lineage(first_visit(reach))
    above = first.select("doc_id", F.col("role").alias("up_role"), F.col("obj_no").alias("up_obj"),
                         F.col("page_no").alias("_page"), F.col("path").alias("_path"))
    stray = first.join(above, ["doc_id", "up_role", "up_obj"]).filter(
        (F.col("page_no") != F.col("_page")) | (F.col("up_path") != F.col("_path")))
    settled = stray.isEmpty()
    same = ["doc_id", "role", "obj_no", "page_no", "path"]
    while not settled:
        reach = _expand(roots, containers, max_depth, first)
        again = cut_lineage(first_visit(reach))
        settled = first.count() == again.count() and again.join(first, same, "left_anti").isEmpty()
        first = again
    return cut_lineage(_on_every_page(_keep_first(reach, first), roots))


def where_label(role: Column, parent: Column) -> Column:
    """Label of what lies inside a container."""
    prefix = F.lit("")
    for name, text in PREFIXES.items():
        prefix = F.when(role == name, text).otherwise(prefix)
    return F.concat(parent, prefix)


def inherited_resources(page_tree: DataFrame) -> DataFrame:
    """Resources of every page: its own, else those of the nearest ancestor that has some; further columns stay.

    Only inner nodes are followed up the tree; pages then join their resolved parent once.
    """
    inner = page_tree.filter(~F.col("is_page")).select(
        "doc_id", "node_id", "resources_obj",
        F.when(F.col("resources_obj").isNull(), F.col("parent_id")).alias("link"))

    def merge(own, to):
        return {"resources_obj": to("resources_obj"), "link": to("link")}

    resolved = follow_links(inner, "node_id", "link", merge).select(
        "doc_id", F.col("node_id").alias("parent_id"), F.col("resources_obj").alias("_inherited"))
    further = [c for c in page_tree.columns if c not in ("doc_id", "node_id", "parent_id", "is_page", "resources_obj")]
    return (page_tree.filter("is_page").join(resolved, ["doc_id", "parent_id"], "left")
            .select("doc_id", "node_id", *further, F.coalesce("resources_obj", "_inherited").alias("resources_obj"),
                    F.col("resources_obj").isNull().alias("is_inherited")))


def page_roots(page_tree: DataFrame) -> DataFrame:
    """(doc_id, page_no, resources_obj): where the walk starts, own or inherited; pages without any are left out."""
    return inherited_resources(page_tree).filter("resources_obj IS NOT NULL").select("doc_id", "page_no", "resources_obj")
