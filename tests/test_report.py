"""Findings in the order of a page's contents, and containers of several roles in one scan."""

from pagetone.operators import report, walk
from pagetone.sources import derived as D

STREAMS = "doc_id bigint, page_no bigint, stream_id bigint, filter array<string>, text string"


def test_contents_decide_place_and_order(spark):
    streams = spark.createDataFrame([
        (1, 1, 0, None, "1 0 0 rg\n"), (1, 1, 1, None, "0 1 0 rg\n/A cs\n"), (1, 2, 2, ["/DCTDecode"], "1 0 0 rg\n"),
        (1, 9, 3, None, "0 0 1 RG\n")], STREAMS)
    contents = spark.createDataFrame([
        (1, 1, [1, 0]), (1, 2, [0, 2, 0, 77]), (1, 3, None), (1, 4, []), (1, 5, [None, 1])],
        "doc_id bigint, page_no bigint, contents array<bigint>")
    found = report.page_stream_findings(streams, contents)
    rows = sorted((r.page_no, tuple(r.seq), r.kind) for r in found.collect())
    assert rows == [(1, (0, 0, 0, 0), "rgb"), (1, (0, 0, 3, 1), "space(/A)"), (1, (0, 1, 0, 0), "rgb"),
                    (2, (0, 0, 0, 0), "rgb"), (2, (0, 2, 0, 0), "rgb"), (5, (0, 1, 0, 0), "rgb"), (5, (0, 1, 3, 1), "space(/A)")]
    first = report.report_topk(report.distinct_findings(found), per_page=1).collect()
    assert {r.page_no: r.message for r in first}[1] == "page stream rgb x1 (e.g. 0 1 0 rg)"  # stream 1 is named first


def test_texts_do_not_meet_the_pages(spark, sf_dir):
    found = report.page_stream_findings(D.streams(spark, sf_dir), D.page_contents(spark, sf_dir))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text#" in line]


def test_one_scan_of_object_streams_serves_all_roles(spark):
    streams = spark.createDataFrame([(1, 5, None, "1 0 0 rg\n"), (1, 6, None, "/P scn\n"), (1, 7, [], "1 0 0 RG\n")],
                                    "doc_id bigint, obj_no int, filter array<string>, text string")
    visits = spark.createDataFrame([(1, 5, 1, [1], "Form>", "form"), (1, 5, 2, [2], "Tile>SMask>", "softmask"),
                                    (1, 6, 1, [1, 3], "Form>Tile>", "tiling"), (1, 8, 1, [4], "", "page")],
                                   "doc_id bigint, obj_no int, page_no bigint, path array<bigint>, where string, role string")
    found = report.container_findings(visits, streams)
    assert {(r.role, r.where, r.message) for r in found.collect()} == {
        ("form", "", "Form rgb x1 (e.g. 1 0 0 rg)"), ("softmask", "Tile>", "Tile>SMask rgb x1"),
        ("tiling", "Form>", "Form>TilingPattern pattern(/P) x1")}
    for role in ("form", "softmask", "tiling"):
        alone = report.container_ops(visits, streams, role).collect()
        assert {r.message for r in alone} == {r.message for r in found.collect() if r.role == role}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_sides_built_from_tables_are_not_broadcast_by_a_guess(spark, sf_dir):
    """Spark takes few columns of many rows for a small table; that broadcast filled the driver."""
    visits = spark.createDataFrame([(1, 5, 1, [1], "Form>", "form", 1)],
                                   "doc_id bigint, obj_no int, page_no bigint, path array<bigint>, where string, role string, depth int")
    entries = walk.resource_entries(D.edges(spark, sf_dir), D.objects(spark, sf_dir))
    labels = D.cs_defs(spark, sf_dir).selectExpr("doc_id", "cs_obj", "family AS label")
    found = report.resource_findings(visits, entries, D.objects(spark, sf_dir), labels, D.object_streams(spark, sf_dir))
    pages = report.suspect_pages(report.residual_findings(
        report.page_stream_findings(D.streams(spark, sf_dir), D.page_contents(spark, sf_dir)), found))
    assert "BroadcastExchange" not in pages._jdf.queryExecution().executedPlan().toString()
