"""Input tables derived from the driver's tables (see FIXTURES.md).

No table here ships documents of the engine's own kind, so its inputs are derived: every derivation is
row by row (project, transform, explode). None groups, sorts or joins, so none has a hot key, and each
grows with the table it reads. Integer arithmetic only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_PER_STREAM = 24
WORDS_PER_PAGE = 48
OBJECTS_PER_DOC = 128
PAGES_PER_DOC = 4
OBJECT_STREAM_LINES = 6
SMASK_BASE, GROUP_BASE, ROOT_BASE = 1000, 2000, 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a table of a few short columns is few splits, while its rows become many bytes or rows."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _div(a: Column, b: int) -> Column:
    """Integer division of non-negative numbers."""
    return F.floor(a / F.lit(b))


def _int(a: Column) -> Column:
    return a.cast("int")


# --- documents, pages, prices -------------------------------------------------------------------

def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.array(*[F.lit(e) for e in ("pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx", "ppt",
                                       "pptx", "txt", "PDF")])
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.concat(F.lit("/in/"), "c_name",
                 F.when(F.col("c_custkey") % 13 == 5, "..").when(F.col("c_custkey") % 13 == 6, ".old.").otherwise("."),
                 F.get(ext, _int(F.col("c_custkey") % 11))).alias("path"),
        (F.col("c_custkey") * 37).alias("length"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("1,"), (F.col("o_custkey") % 12).cast("string"), F.lit(",9"),
                 F.when(F.col("o_orderkey") % 5 == 0, ",x").when(F.col("o_orderkey") % 5 == 1, ",99999999999").otherwise("")).alias("page_list"),
        _int(F.col("o_orderkey") % 7 + 1).alias("page_count"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("stream_id"),
        F.when(F.col("event_type") == "error", F.lit("inflate_fail")).alias("error"))


def page_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = (F.when(kind.isin("click", "view"), "rotate").when(kind == "error", "delete")
               .when((kind == "signup") & (F.col("event_id") % 2 == 0), "undo")
               .when(kind == "signup", "move").otherwise("insert"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"),
        _int(F.col("event_id") % 5 + 1).alias("page_no"), action.alias("action"),
        F.when(kind == "click", 90).when(kind == "view", -90).otherwise(0).alias("degrees"),
        (F.col("event_id") % 50 / F.lit(10.0)).alias("order_key"))


def editable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six pages for every order; the document numbers overlap those of ``page_edits``."""
    return (_spread(table(spark, sf_dir, "orders").select("o_orderkey"))
            .select(F.col("o_orderkey").alias("doc_id"),
                    F.explode(F.sequence(F.lit(1), F.lit(6))).alias("page_no")))


def prices(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('color', CAST(300.00 AS DECIMAL(18,2))), "
                     "('gray', CAST(50.00 AS DECIMAL(18,2))) AS t(kind, unit_price)")


# --- content streams ----------------------------------------------------------------------------

_HUNDREDTHS = [f"{i // 100}.{i % 100:02d}" for i in range(101)]
_IMAGES = ("BI\n/W 2 /H 2 /CS /RGB /BPC 8\nID\nabcdefghijkl\nEI",
           "BI\n/W 4 /H 4 /CS /G\nID\n\nEI 0.5 scn(a)\nz\nEI",
           "BI\n/W 2 /H 2 /CS /RGB /F /Fl\nID\nabcdefg\nEI",
           "BI\n/Width 2 /Height 2 /ColorSpace /DeviceCMYK /BitsPerComponent 8\nID\nabcdefghijklmnop\nEI",
           "BI\n/W 2 /H 2 /CS /RGB /BPC 4\nID\nabcdef\nEI")
#: 24 forms of a line: operands a to d in hundredths, e a little over a, n from 0 to 4.
_FORMS = (
    lambda a, b, c, d, e, n: f"{a} {b} {c} rg", lambda a, b, c, d, e, n: f"{a} {b} {c} RG",
    lambda a, b, c, d, e, n: f"{a} {b} {c} {d} k", lambda a, b, c, d, e, n: f"{a} {b} {c} {d} K",
    lambda a, b, c, d, e, n: f"{a} {b} {c} scn", lambda a, b, c, d, e, n: f"{a} {b} {c} {d} SCN",
    lambda a, b, c, d, e, n: f"{a[1:4]} {b} {c} sc", lambda a, b, c, d, e, n: f"{a} {b} {c} {d} SC",
    lambda a, b, c, d, e, n: f"/C{n} cs", lambda a, b, c, d, e, n: f"/C{n} CS",
    lambda a, b, c, d, e, n: f"{a} scn", lambda a, b, c, d, e, n: f"{a} SCN",
    lambda a, b, c, d, e, n: f"{a} {b} SC", lambda a, b, c, d, e, n: f"{d} {a} {b} {c} {d} scn",
    lambda a, b, c, d, e, n: f"/P{n} scn", lambda a, b, c, d, e, n: f"({a} {b} {c} rg) Tj",
    lambda a, b, c, d, e, n: f"<0A{a[2:4]}> Tj", lambda a, b, c, d, e, n: f"/S{n} sh",
    lambda a, b, c, d, e, n: f"{a} {a} {e} rg", lambda a, b, c, d, e, n: _IMAGES[n],
    lambda a, b, c, d, e, n: f"{'(' * 40 * (n == 0)}(x (y) {a} {b} {c} rg z){')' * 40 * (n == 0)} Tj",
    lambda a, b, c, d, e, n: f"q 1 0 0 1 {a} {b} cm", lambda a, b, c, d, e, n: f"{a} g",
    lambda a, b, c, d, e, n: f"{a} {b} rg",
)


def _stream_text(v: Column, first: Column, size: Column) -> Column:
    """Text of a stream: one line for each ``v``, the first with the place ``first``.

    The functions are nested so that they travel by value: executors need not have this package.
    """
    def lines_of(v: np.ndarray, idx: np.ndarray, size: np.ndarray) -> list[str]:
        """Lines of content streams, one for each ``v``."""
        high = np.fmod(np.floor(v / 24.0).astype(np.int64), 101)  # remainders have the sign of the number, as in SQL
        places = [high, np.fmod(v * 3 + idx, 101), np.fmod(v * 5 + size, 101), np.fmod(idx + size, 101),
                  np.minimum(high + np.fmod(idx, 3), 100)]
        names = np.array(_HUNDREDTHS, dtype=object)
        operands = [names[np.maximum(p, 0)].tolist() for p in places]
        lines = [_FORMS[form](a, b, c, d, e, n) for form, a, b, c, d, e, n in zip(
            np.fmod(np.maximum(v, 0), 24).tolist(), *operands, np.fmod(np.maximum(v, 0), 5).tolist())]
        for i in np.flatnonzero(v < 0).tolist():  # an operand out of the table is left out
            lines[i] = " ".join([*(names[p[i]] for p in places[:3] if p[i] >= 0), "rg"])
        return lines

    def texts(v: pa.Array, first: pa.Array, size: pa.Array) -> pa.Array:
        """Text of every stream: the line of each ``v``, the first with the place ``first``; without ``v`` a bare operator."""
        lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        idx = place + np.repeat(first.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
        values = v.flatten()
        lines = lines_of(pc.fill_null(values, 0).to_numpy(zero_copy_only=False), idx,
                       size.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        for i in np.flatnonzero(pc.is_null(values).to_numpy(zero_copy_only=False)).tolist():
            lines[i] = "rg"
        return pa.array(["\n".join(lines[end - n:end]) for end, n in zip(ends.tolist(), lengths.tolist())], pa.string())

    return F.arrow_udf(texts, "string")(v, first, size)


def _word_sizes(text: Column) -> Column:
    """Characters of every word of a text, words cut at each space."""
    def sizes(text: pa.Array) -> pa.Array:
        words = pc.split_pattern(text, " ")
        ends = pc.cast(pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)), pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, pc.utf8_length(words.flatten()), mask=pc.is_null(words))

    return F.arrow_udf(sizes, "array<int>")(text)


def _filter(k: Column) -> Column:
    names = ("/FlateDecode", "/Fl", "/DCTDecode")
    flate, short, jpeg = (F.lit(n) for n in names)
    return (F.when(k % 6 == 0, F.array(flate)).when(k % 6 == 1, F.array(short))
             .when(k % 6 == 2, F.array().cast("array<string>")).when(k % 6 == 3, F.array(jpeg))
             .when(k % 6 == 4, F.array(flate, jpeg)))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per 24 words of a document, one line per word; whole texts.

    Only the word sizes of the documents are dealt to all cores; texts of streams are built, and read, where they arrive.
    """
    doc, first = F.col("doc_id"), F.col("stream_id") * WORDS_PER_STREAM
    starts = F.sequence(F.lit(0), _int(_div(F.size("sizes") - 1, WORDS_PER_STREAM)))
    documents = _spread(table(spark, sf_dir, "documents").select("doc_id", _word_sizes(F.col("text")).alias("sizes")))
    cut = (documents.select("doc_id", F.explode(F.transform(starts, lambda k: F.struct(
        k.alias("stream_id"), F.slice("sizes", k * WORDS_PER_STREAM + 1, F.lit(WORDS_PER_STREAM)).alias("sizes")))).alias("s"))
        .select("doc_id", "s.*"))
    values = F.transform("sizes", lambda size, i: doc * 31 + (first + i) * 17 + size * 7)
    return cut.select("doc_id", (F.floor(F.col("stream_id") / 2) + 1).alias("page_no"),
                      F.col("stream_id").cast("bigint").alias("stream_id"), _filter(doc + F.col("stream_id")).alias("filter"),
                      _stream_text(values, first, F.col("sizes")).alias("text"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their content: one or two streams, or none on every seventh page."""
    n = _int(_div(F.size(F.split("text", " ", -1)) - 1, WORDS_PER_STREAM) + 1)
    pages = F.sequence(F.lit(0), _int(_div(F.col("n") - 1, 2)))
    first = F.col("p") * 2
    return (table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
            .select("doc_id", "n", F.explode(pages).alias("p"))
            .select("doc_id", (F.col("p") + 1).cast("bigint").alias("page_no"),
                    F.when(F.col("p") % 7 == 6, F.lit(None).cast("array<int>"))
                     .when(first + 1 < F.col("n"), F.array(first, first + 1))
                     .otherwise(F.array(first)).alias("contents")))


#: A stream that pages name and no document has.
LOST_STREAM = 900_000


def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name their streams in any order: turned, twice, with a shared one first, with a lost one, or none."""
    n = _div(F.size(F.split("text", " ", -1)) - 1, WORDS_PER_STREAM) + 1
    first, second, kind = F.col("p") * 2, F.col("p") * 2 + 1, F.col("p") % 6
    named = (F.when(kind == 0, F.array(first, second)).when(kind == 1, F.array(second, first))
              .when(kind == 2, F.array(second, first, second)).when(kind == 3, F.array(F.lit(0).cast("bigint"), first, second))
              .when(kind == 4, F.array(first, F.lit(LOST_STREAM).cast("bigint"), second)))
    return (table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
            .select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), _div(F.col("n") - 1, 2))).alias("p"))
            .select("doc_id", (F.col("p") + 1).alias("page_no"),
                    F.filter(named, lambda x: (x < F.col("n")) | (x == LOST_STREAM)).alias("contents")))


def colorspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five named spaces per document; one in five names has no entry."""
    doc, n = F.col("doc_id"), F.col("n")
    kind = (doc + n) % 5
    pattern = (kind == 4) & (doc % 3 == 0)
    width = F.when(kind == 1, 4).when(kind == 2, 3).when(kind == 3, 1).otherwise(2)
    channels = F.sequence(F.lit(1), _int(width))
    return (table(spark, sf_dir, "documents").select("doc_id")
            .select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
            .filter(kind != 0)
            .select("doc_id", F.lit("page").alias("scope"),
                    F.concat(F.lit("C"), n.cast("string")).alias("name"),
                    F.when(pattern, "Pattern").when(kind == 2, "DeviceN").otherwise("Separation")
                     .alias("type"),
                    F.when(~pattern, (doc % 3 + 1).cast("double")).alias("fn_n"),
                    F.when(~pattern, F.transform(channels, lambda c: F.lit(0.0))).alias("c0"),
                    F.when(~pattern, F.transform(
                        channels, lambda c: (doc + n + c * 7) % 11 / F.lit(10.0))).alias("c1"),
                    F.when(kind == 1, "/DeviceCMYK").when(kind == 2, "/DeviceRGB")
                     .when(kind == 3, "/DeviceGray").otherwise("/Lab").alias("alt")))


# --- objects, resource graph, page tree -----------------------------------------------------------

def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _div(key, OBJECTS_PER_DOC).alias("doc_id"), _int(key % OBJECTS_PER_DOC).alias("obj_no"),
        F.col("p_size").alias("size"), "p_type")


_OBJECT_SCHEMA = ("doc_id bigint, obj_no int, kind string, subtype string, w int, h int, cs_obj int, "
                  "filter array<string>, is_mask boolean, has_smask boolean, has_decode boolean, "
                  "shading_type int, pattern_type int, target_obj int, length bigint")


def _as_objects(df: DataFrame, **columns: Column) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in _OBJECT_SCHEMA.split(",")]
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, forms, shadings, patterns and graphics states from ``part``; soft masks and groups beside."""
    parts = _parts(spark, sf_dir)
    doc, no, size, kind = (F.col(c) for c in ("doc_id", "obj_no", "size", "p_type"))
    image = kind == "ECONOMY"
    main = _as_objects(
        parts, doc_id=doc, obj_no=no,
        kind=F.when(image | (kind == "LARGE"), "XObject").when(kind == "MEDIUM", "Shading")
              .when(kind.isin("PROMO", "SMALL"), "Pattern").otherwise("ExtGState"),
        subtype=F.when(image, "/Image").when(kind == "LARGE", "/Form"),
        w=F.when(image, size), h=F.when(image, size + 3),
        cs_obj=F.when(no % 11 == 0, F.lit(None)).when(no % 17 == 3, F.lit(500)).otherwise(no * 7 % 128),
        filter=_filter(size), is_mask=F.when(size % 9 == 0, True).when(size % 9 == 1, False),
        has_smask=size % 2 == 0, has_decode=size % 5 == 0,
        shading_type=F.when(kind == "MEDIUM", size % 7 + 1),
        pattern_type=F.when(kind == "PROMO", 2).when(kind == "SMALL", 1),
        target_obj=F.when(kind == "PROMO", no * 3 % 128).when(kind == "STANDARD", no + SMASK_BASE),
        length=size * 10)
    masks = _as_objects(
        parts.filter(kind == "STANDARD"), doc_id=doc, obj_no=no + SMASK_BASE, kind=F.lit("SMask"),
        target_obj=F.floor(no / 2) + GROUP_BASE)
    groups = _as_objects(
        parts.filter(no % 2 == 0), doc_id=doc, obj_no=F.floor(no / 2) + GROUP_BASE,
        kind=F.lit("Group"), subtype=F.lit("/Form"), filter=_filter(no))
    return main.unionByName(masks).unionByName(groups)


def object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of forms, tiling patterns and soft-mask groups, six lines each, readable or not."""
    no, doc = F.col("obj_no"), F.col("doc_id")
    steps = F.sequence(F.lit(0), F.lit(OBJECT_STREAM_LINES - 1))
    values = F.transform(steps, lambda j: (doc * 128 + no) * 13 + j * 5)
    sizes = F.transform(steps, lambda j: no % 10)
    holders = _spread(objects(spark, sf_dir).filter((F.col("subtype") == "/Form") | (F.col("pattern_type") == 1)).select(
        "doc_id", "obj_no", "filter"))
    return holders.select("doc_id", "obj_no", "filter", F.concat(
        _stream_text(values, F.lit(0), sizes), F.lit("\n")).alias("text"))


def cs_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour-space definition per part; base and alternate point at the one before."""
    family = F.array(*[F.lit(f) for f in ("/DeviceRGB", "/DeviceCMYK", "/DeviceGray", "/ICCBased",
                                          "/Indexed", "/Separation", "/CalGray")])
    size, no = F.col("size"), F.col("obj_no")
    kind = size % 7
    before = F.when(no % 13 == 5, F.lit(600)).when(no > 0, no - 1)
    return _parts(spark, sf_dir).select(
        "doc_id", no.alias("cs_obj"), F.get(family, _int(kind)).alias("family"),
        _int(F.when((kind == 3) & (size % 8 != 7), size % 4 + 1)).alias("n"),
        _int(F.when(kind == 4, before)).alias("base_obj"),
        _int(F.when(kind == 5, before)).alias("alt_obj"),
        _int(F.when(kind == 3, 2).when(kind.isin(4, 5), 4).when((kind == 6) & (size % 2 == 0), 2))
        .alias("size"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource entries: a shared DAG inside each document, under page roots and soft-mask groups.

    Some groups are also forms of a dictionary.
    """
    no = F.col("obj_no")
    category = (F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "XObject")
                 .when(F.col("p_type") == "MEDIUM", "Shading")
                 .when(F.col("p_type").isin("PROMO", "SMALL"), "Pattern").otherwise("ExtGState"))
    parents = F.array_distinct(F.filter(F.array(
        F.when(no > 0, _int(F.floor(no / 4))), F.when((no > 0) & (no % 3 != 0), _int(F.floor(no / 3))),
        F.when(no % 5 == 1, _int(F.floor(no / 2) + GROUP_BASE)),
        F.when(no < 24, no % PAGES_PER_DOC + ROOT_BASE + 1),
        F.when((no < 24) & (no % 3 == 0), (no + 1) % PAGES_PER_DOC + ROOT_BASE + 1)),
        lambda p: p.isNotNull()))
    own = F.transform(parents, lambda p: F.struct(p.alias("parent_obj"), no.alias("child_obj"), category.alias("category")))
    group = F.struct(_int(F.floor(no / 4)).alias("parent_obj"), _int(F.floor(no / 2) + GROUP_BASE).alias("child_obj"),
                     F.lit("XObject").alias("category"))
    both = F.when(no % 12 == 8, F.concat(own, F.array(group))).otherwise(own)
    return _parts(spark, sf_dir).select("doc_id", F.explode(both).alias("e")).select(
        "doc_id", "e.*", F.concat(F.lit("/R"), F.col("e.child_obj").cast("string")).alias("name"),
        F.col("e.child_obj").alias("ordinal"))


def object_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of each object document under two nodes under one, from the first seven objects.

    Page 2 inherits from its parent, page 3 from the root; in some documents page 4 does so too, or the root has nothing.
    """
    doc, no = F.col("doc_id"), F.col("obj_no")
    node = F.when(no < PAGES_PER_DOC, no + 1).otherwise(no + 7)
    parent = F.when(no < 2, 11).when(no < 4, 12).when(no < 6, 13)
    own = (F.when((no == 0) | ((no == 3) & (doc % 4 != 2)), no + 1).when(no == 4, 2)
            .when((no == 6) & (doc % 3 != 1), 3))
    return _parts(spark, sf_dir).filter(no < 7).select(
        "doc_id", node.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"),
        (no < PAGES_PER_DOC).alias("is_page"), F.when(no < PAGES_PER_DOC, no + 1).cast("bigint").alias("page_no"),
        (own + ROOT_BASE).cast("int").alias("resources_obj"))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (customers) under nations under regions, as one tree."""
    region = table(spark, sf_dir, "region").select(
        F.lit(0).cast("bigint").alias("doc_id"), (F.col("r_regionkey") + 1).cast("bigint").alias("node_id"),
        F.lit(None).cast("bigint").alias("parent_id"), F.lit(False).alias("is_page"),
        (F.col("r_regionkey") + 100).cast("int").alias("resources_obj"))
    nation = table(spark, sf_dir, "nation").select(
        F.lit(0).cast("bigint").alias("doc_id"), (F.col("n_nationkey") + 101).cast("bigint").alias("node_id"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("parent_id"), F.lit(False).alias("is_page"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 200).cast("int").alias("resources_obj"))
    page = table(spark, sf_dir, "customer").select(
        F.lit(0).cast("bigint").alias("doc_id"), (F.col("c_custkey") + 1001).alias("node_id"),
        (F.col("c_nationkey") + 101).cast("bigint").alias("parent_id"), F.lit(True).alias("is_page"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") + 5000).cast("int").alias("resources_obj"))
    return region.unionByName(nation).unionByName(page)


# --- rasters --------------------------------------------------------------------------------------

_HEX = [f"{i:02X}" for i in range(256)]


def rasters(spark: SparkSession, sf_dir: str, with_bytes: bool = True, dealt: bool = False) -> DataFrame:
    """Images of ``part`` with three or four channels and predictor 1, 2 or 15; some short, long or lost.

    With ``dealt`` the rows of ``part`` go to all cores before their bytes are built.
    """
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    base = (_spread(parts) if dealt else parts).select(
        key.alias("image_id"), F.col("p_size").alias("w"), _int(key % 9 + 1).alias("h"),
        _int(key % 2 + 3).alias("channels"),
        F.when(key % 3 == 0, 1).when(key % 3 == 1, 2).otherwise(15).alias("predictor"),
        (key % 5 != 0).alias("is_raw"), (key % 10 == 5).alias("is_cut"))
    stride = F.col("w") * F.col("channels") + F.when(F.col("predictor") >= 10, 1).otherwise(0)
    image = F.col("image_id")
    base = base.withColumn("stride", stride).withColumn("decoded_len", (
        F.when(~F.col("is_raw") & (image % 13 == 0), F.lit(None))
         .otherwise(F.col("stride") * F.col("h") - F.when(image % 11 == 0, F.lit(-1)).otherwise(image % 4))
    ).cast("bigint"))
    keys = ["image_id", "w", "h", "channels", "predictor", "is_raw", "is_cut", "decoded_len"]
    if not with_bytes:
        return base.select(*keys)
    hexes = F.array(*[F.lit(x) for x in _HEX])
    row_tag = F.when(image % 4 == 3, F.lit(3)).otherwise(image % 4)

    length, tagged = F.col("decoded_len"), F.col("predictor") >= 10
    step = (F.col("w") * 3 + 1).cast("bigint")
    values = F.sequence(image * 7, image * 7 + (length - 1) * step, step)

    def plain(value: Column) -> Column:
        return F.get(hexes, _int(value % 256))

    def with_tag(value: Column, i: Column) -> Column:
        y = F.floor(i / F.col("stride"))
        tag = F.when(image % 8 == 7, y % 5).when(row_tag == 3, y % 3).when(row_tag == 0, F.lit(1)).when(row_tag == 1, F.lit(2)).otherwise(0)
        return F.when(i % F.col("stride") == 0, F.get(hexes, _int(tag))).otherwise(plain(value))

    text = (F.when((image % 7 == 0) & (F.col("predictor") == 1), F.repeat(F.lit(_HEX[77]), _int(length)))
             .when(tagged, F.array_join(F.transform(values, with_tag), "")).otherwise(F.array_join(F.transform(values, plain), "")))
    body = F.when(length > 0, F.unhex(text))
    # One-row generator: keeps the bytes from being built again inside every predicate that reads them.
    return base.select(*keys, F.inline(F.array(F.struct(body.alias("bytes")))))


def tint_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-channel images of ``part`` in the named spaces of documents; some have no space or name a lost one."""
    image, w, h = F.col("p_partkey"), F.col("p_size"), _int(F.col("p_partkey") % 5 + 1)
    base = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        image.alias("image_id"), w.alias("w"), h.alias("h"), (image % 50).alias("doc_id"),
        F.when(image % 9 != 0, F.concat(F.lit("C"), (image % 5).cast("string"))).alias("space"),
        (w * h).cast("bigint").alias("decoded_len"))
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), _int(F.col("decoded_len") - 1)), lambda i: F.get(
        F.array(*[F.lit(x) for x in _HEX]), _int((F.col("image_id") * 11 + i * 3) % 256))), ""))
    return base.select("*", F.lit(1).alias("channels"), F.lit(1).alias("predictor"), F.lit(True).alias("is_raw"), F.lit(False).alias("is_cut"),
                       F.inline(F.array(F.struct(body.alias("bytes")))))
