"""Resource walk against a depth-first reader, also where the depth limit cuts earlier visits."""

import random

from pagetone.operators import inventory, walk


def _entries(spark, edges):
    rows = [(1, p, c, rank, role) for p, c, rank, role in edges]
    return spark.createDataFrame(rows, "doc_id bigint, parent_obj int, obj_no int, rank bigint, role string")


def _read(roots, edges, max_depth):
    """Visits of a depth-first reader that meets forms and groups once per document."""
    by_parent = {}
    for parent, child, rank, role in edges:
        by_parent.setdefault(parent, []).append((rank, child, role))
    seen, visits = set(), []

    def open_(node, page, path, depth):
        if depth > max_depth:
            return
        for rank, child, role in sorted(by_parent.get(node, [])):
            if role != "tiling":
                if (role, child) in seen:
                    continue
                seen.add((role, child))
            visits.append((page, child, role, tuple(path + [rank])))
            open_(child, page, path + [rank], depth + 1)

    for page, root in roots:
        open_(root, page, [], 0)
    return visits


def test_walk_matches_depth_first_reader(spark):
    rng = random.Random(5)
    for case in range(4):
        n, max_depth = 14, 2 if case % 2 else 5
        kinds = {i: rng.choice(["form", "form", "softmask", "tiling"] if case < 2 else ["form", "softmask"]) for i in range(n)}
        edges, ranks = [], {}
        for child in range(n):
            for parent in {rng.choice([100, 101] + list(range(n))) for _ in range(3)}:
                if kinds[child] == "tiling" and kinds.get(parent) == "tiling" and parent <= child:
                    continue
                ranks[parent] = ranks.get(parent, 0) + 1
                edges.append((parent, child, ranks[parent], kinds[child]))
        roots = [(1, 100), (2, 101), (3, 100), (4, 101)][:4 if case % 2 else 2]
        expected = _read(roots, edges, max_depth)
        frame = spark.createDataFrame([(1, p, r) for p, r in roots], "doc_id bigint, page_no bigint, resources_obj int")
        got = walk.resource_walk(frame, _entries(spark, edges), max_depth).filter("role <> 'page'").collect()
        once = {(r.page_no, r.obj_no, r.role, tuple(r.path)) for r in got if r.role != "tiling"}
        assert once == {v for v in expected if v[2] != "tiling"}, case
        # A tiling shows once per page and prefix, at its first place.
        prefix = {"form": "F", "tiling": "T", "softmask": "S"}
        assert {(r.page_no, r.obj_no) for r in got if r.role == "tiling"} == {
            (v[0], v[1]) for v in expected if v[2] == "tiling"}, (case, prefix)


def test_depth_limit_cuts_the_first_visit(spark):
    # 1 is first met two levels down, where its child 9 is out of reach; the direct entry comes later.
    edges = [(100, 5, 1, "form"), (5, 1, 1, "form"), (100, 1, 2, "form"), (1, 9, 1, "form")]
    frame = spark.createDataFrame([(1, 1, 100)], "doc_id bigint, page_no bigint, resources_obj int")
    got = walk.resource_walk(frame, _entries(spark, edges), 1).filter("role <> 'page'").collect()
    assert {r.obj_no for r in got} == {v[1] for v in _read([(1, 100)], edges, 1)} == {5, 1}


def test_one_object_as_form_and_as_group(spark):
    edges = [(100, 5, 1, "form"), (100, 5, 2, "softmask"), (5, 6, 1, "form"), (101, 5, 1, "softmask"), (101, 5, 2, "form")]
    roots = [(1, 100), (2, 101)]
    frame = spark.createDataFrame([(1, p, r) for p, r in roots], "doc_id bigint, page_no bigint, resources_obj int")
    got = walk.resource_walk(frame, _entries(spark, edges)).filter("role <> 'page'").collect()
    assert {(r.page_no, r.obj_no, r.role, tuple(r.path)) for r in got} == set(_read(roots, edges, 5)) == {
        (1, 5, "form", (1,)), (1, 6, "form", (1, 1)), (1, 5, "softmask", (2,))}


def test_label_chains_and_cycles(spark):
    rows = [(1, i, "/Separation", None, None, i + 1, 4) for i in range(40)] + [
        (1, 40, "/DeviceRGB", None, None, None, None), (1, 50, "/Indexed", None, 51, None, 4),
        (1, 51, "/Indexed", None, 50, None, 4), (1, 60, "/ICCBased", None, None, None, 2),
        (1, 61, "/Indexed", None, 99, None, 4), (1, 62, "/DeviceN", None, None, None, 4)]
    defs = spark.createDataFrame(rows, "doc_id bigint, cs_obj int, family string, n int, base_obj int, alt_obj int, size int")
    label = {r.cs_obj: r.label for r in inventory.colorspace_label(defs).collect()}
    assert label[0] == "[/Separation alt=" * 40 + "/DeviceRGB" + "]" * 40
    assert label[50] is None and label[51] is None
    assert label[60] == "[/ICCBased N=null]"
    assert label[61] == "[/Indexed base=(?)]" and label[62] == "[/DeviceN alt=(none)]"


def test_inherited_resources_follow_long_chains(spark):
    rows = [(1, i, i + 1 if i < 30 else None, False, 77 if i == 30 else None) for i in range(1, 31)]
    rows += [(1, 100, 1, True, None), (1, 101, 1, True, 5), (1, 102, None, True, None)]
    tree = spark.createDataFrame(rows, "doc_id bigint, node_id bigint, parent_id bigint, is_page boolean, resources_obj int")
    assert {r.node_id: r.resources_obj for r in walk.inherited_resources(tree).collect()} == {100: 77, 101: 5, 102: None}


def test_pages_that_share_a_dictionary_start_as_one_row(spark):
    """A hundred pages, one dictionary: its entries are met once; tilings come back on every page."""
    edges = [(100, 5, 1, "form"), (100, 7, 2, "tiling"), (7, 8, 1, "tiling"), (7, 5, 2, "form"), (5, 9, 1, "tiling")]
    roots = [(page, 100) for page in range(1, 101)]
    frame = spark.createDataFrame([(1, p, r) for p, r in roots], "doc_id bigint, page_no bigint, resources_obj int")
    reach = walk.resource_reach(frame, _entries(spark, edges))
    assert reach.groupBy("depth").count().rdd.map(tuple).collectAsMap() == {0: 1, 1: 2, 2: 3, 3: 1}
    got = walk.resource_walk(frame, _entries(spark, edges)).collect()
    expected = _read(roots, edges, 5)
    assert {(r.page_no, r.obj_no, r.role, tuple(r.path)) for r in got if r.role != "page"} == set(expected)
    assert {r.page_no for r in got if r.role == "page"} == set(range(1, 101))


def test_walk_starts_at_inherited_resources(spark):
    rows = [(1, 20, None, False, None, 77), (1, 21, 20, False, None, None), (1, 1, 21, True, 1, None), (1, 2, 21, True, 2, 55),
            (1, 3, 20, True, 3, None), (2, 1, 9, True, 1, None)]
    tree = spark.createDataFrame(rows, "doc_id bigint, node_id bigint, parent_id bigint, is_page boolean, page_no bigint, resources_obj int")
    roots = walk.page_roots(tree)
    assert {tuple(r) for r in roots.collect()} == {(1, 1, 77), (1, 2, 55), (1, 3, 77)}
    edges = [(77, 5, 1, "tiling"), (55, 6, 1, "form"), (5, 6, 1, "form")]
    got = walk.resource_walk(roots, _entries(spark, edges)).filter("role <> 'page'").collect()
    assert {(r.page_no, r.obj_no, tuple(r.path)) for r in got} == {(1, 5, (1,)), (1, 6, (1, 1)), (3, 5, (1,))}
