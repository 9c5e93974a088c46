"""File source, streaming replies, page selection."""

from pyspark.sql import functions as F

from pagetone.operators import intake
from pagetone.sources.files import document_files, read_findings, stream_files, write_findings
from pagetone.streaming.requests import REQUEST_SCHEMA, start_replies


def test_document_files(spark, tmp_path):
    for name in ("a.pdf", "b.DOCX", "c.txt", "d", "e.hwpx"):
        (tmp_path / name).write_bytes(b"x" * 10)
    found = intake.route_format(document_files(spark, str(tmp_path))).collect()
    assert {(r.ext, r.family, r.length) for r in found} == {("pdf", "pdf", 10), ("docx", "word", 10), ("hwpx", "hwp", 10)}


def test_stream_files(spark, tmp_path):
    (tmp_path / "s1").write_bytes(bytes([0x80, 0x9F, 0x41]))
    row = stream_files(spark, str(tmp_path)).first()
    assert row.text == "\x80\x9fA"


def test_intake_names(spark):
    paths = spark.createDataFrame([("/x/Plan.PDF",), ("C:\\d\\a.b.xls",), ("/x/noext",), ("/x.pdf/y.txt",)], "path string")
    assert {(r.name, r.ext) for r in intake.intake(paths).collect()} == {("Plan.PDF", "pdf"), ("a.b.xls", "xls")}
    names = {r.n for r in paths.select(intake.artifact_name(F.col("path"), F.lit(3)).alias("n")).collect()}
    assert names == {"Plan_p3.png", "a_b_p3.png", "noext_p3.png", "y_p3.png"}
    korean = spark.createDataFrame([("/x/견적 1.pdf",)], "path string")
    assert korean.select(intake.artifact_name(F.col("path"), F.lit(1))).first()[0] == "견적_1_p1.png"


def test_page_selection(spark):
    requests = spark.createDataFrame([(1, "1, 3,x,9", 5)], "doc_id bigint, page_list string, page_count int")
    pages = spark.createDataFrame([(1, 1)], "doc_id bigint, page_no int")
    assert {r.page_no for r in intake.select_pages(requests).collect()} == {1, 3}
    assert {r.page_no for r in intake.select_pages(requests, pages).collect()} == {1}
    assert {(r.item, r.page_no, r.reason) for r in intake.skipped_pages(requests).collect()} == {
        ("x", None, "no page number"), ("9", 9, "outside the document")}
    assert {r.page_no for r in intake.missing_pages(requests, pages).collect()} == {3, 9}


def test_streaming_replies(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "/C cs 0.25 scn", {"C": ("Separation", 1.0, [1.0], [0.0], "/DeviceGray")}), (2, "1 0 0 rg", None),
            (3, "/P cs 0.5 scn", {"P": ("Pattern", None, None, None, None)})]
    spark.createDataFrame(rows, REQUEST_SCHEMA).write.parquet(source)
    requests = spark.readStream.schema(REQUEST_SCHEMA).parquet(source)
    start_replies(requests, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    got = {r.id: (r.gray_text, r.error) for r in spark.read.parquet(out).collect()}
    assert got == {1: (" 0.7500 g", None), 2: ("0.2990 g", None), 3: ("/P cs 0.5 scn", "pattern_tint")}


def test_findings_by_document(spark, tmp_path):
    found = spark.range(500).selectExpr("id % 50 AS doc_id", "id % 7 AS page_no", "concat('m', id) AS message").repartition(20)
    write_findings(found, str(tmp_path / "f"), buckets=8, files_per_bucket=2)
    assert len(list((tmp_path / "f").rglob("*.parquet"))) <= 16
    assert read_findings(spark, str(tmp_path / "f")).count() == 500
    one = read_findings(spark, str(tmp_path / "f"), [3, 11], buckets=8)
    assert {r.doc_id for r in one.collect()} == {3, 11} and one.count() == 20
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString() or "PartitionFilters: [doc_bucket" in one._jdf.queryExecution().toString() or "PartitionFilters: [(" in one._jdf.queryExecution().toString()


def test_images_are_dealt_to_all_cores(spark, tmp_path):
    from pagetone.sources import derived

    spark.range(50).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    images = derived.rasters(spark, str(tmp_path), dealt=True)
    assert images.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    raw = images.filter("image_id = 6").first()  # 7 samples of three channels a row, no predictor, two bytes short
    assert (raw.w, raw.channels, raw.predictor, len(raw.bytes)) == (7, 3, 1, 7 * 3 * 7 - 2)
    assert list(raw.bytes[:3]) == [42, 64, 86]


def test_stream_lines_for_odd_keys(spark, tmp_path):
    from pagetone.sources import derived

    spark.createDataFrame([(None, "a b"), (3, "x"), (-2, "y"), (4, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in derived.streams(spark, str(tmp_path)).collect()}
    # 3 * 31 + 7 = 100: form 4, a = 4, b = 300 % 101, c = 501 % 101; a negative value leaves operands out
    assert texts == {None: "rg\nrg", 3: "0.04 0.98 0.97 scn", -2: "rg"}
    assert "ArrowEvalPython" in derived.streams(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_streams_are_dealt_to_all_cores(spark, tmp_path):
    """A table that is one split becomes streams in every core; null, empty and wide words keep their places."""
    from pagetone.sources import derived

    rows = [(1, "a  bb \u00e9\u00e9\u00e9"), (2, ""), (3, None), (4, " ".join("x" * (i % 7) for i in range(60)))]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    streams = derived.streams(spark, str(tmp_path))
    assert streams.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {(r.doc_id, r.stream_id) for r in streams.collect()} == {(1, 0), (2, 0), (4, 0), (4, 1), (4, 2)}
    sizes = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", derived._word_sizes(F.col("text")).alias("v")).collect()
    assert {r.doc_id: r.v for r in sizes} == {1: [1, 0, 2, 3], 2: [0], 3: None, 4: [i % 7 for i in range(60)]}
