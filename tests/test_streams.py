"""Hand-written streams with known answers."""

import pytest
from pyspark.sql import functions as F

from pagetone.functions import regions
from pagetone.operators import rewrite, scan, tokens
from pagetone.plans import audit as jobs

_INFO = "struct<type:string,fn_n:double,c0:array<double>,c1:array<double>,alt:string>"


def _streams(spark, texts):
    rows = [(1, 1, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, page_no bigint, stream_id bigint, text string")


def _spaces(spark, rows):
    return spark.createDataFrame(
        [(1, *r) for r in rows],
        "doc_id bigint, name string, type string, fn_n double, c0 array<double>, c1 array<double>, alt string")


SPACES = [
    ("C1", "Separation", 1.0, [1.0], [0.0], "/DeviceGray"),
    ("C2", "Separation", 2.0, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], "/DeviceRGB"),
    ("C3", "DeviceN", 1.0, [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], "/DeviceCMYK"),
    ("C4", "Separation", 1.0, [0.0], [1.0], "/Lab"),
    ("P1", "Pattern", None, None, None, None),
]

REWRITES = [
    ("1 0 0 rg", "0.2990 g"),
    ("0 0 0 1 K", "0.0000 G"),
    ("1 0 0 rg (1 0 0 rg) Tj", "0.2990 g (1 0 0 rg) Tj"),
    ("0.3 scn", "0.7000 g"),
    ("0.1 0.2 SC", "0.1 0.8000 G"),
    ("0.9 0 0 0 1 scn", "0.9 0.0000 g"),
    ("0.1 0.2 rg", "0.1 0.2 rg"),
    ("0.5 0.1 0.2 0.3 rg", "0.5 0.1815 g"),
    ("1.2.3 0 0 rg", "1.0.6877 g"),
    (".5 .5 .5 RG\n", "0.5000 G\n"),
    ("/C1 cs 0 scn", " 1.0000 g"),
    ("/C2 cs 0.5 scn", " 0.2500 g"),
    ("/C3 CS 0.25 SCN", " 0.7500 G"),
    ("/C4 cs 0.25 scn", " 0.7500 g"),
    ("/C1 cs 0.5 scn /C2 cs", " 0.2500 g "),                       # last space of the segment
    ("/C1 cs (x) 0.2 scn", " (x) 0.8000 g"),                        # carried to the next segment
    ("/C1 cs 0.4 scn (x) 0.5 scn /C2 cs 0.5 scn", " 0.6000 g (x) 0.2500 g  0.2500 g"),
    ("/P1   cs /X scn", "/P1 cs /X scn"),                           # Pattern stays, one blank
    ("(a (b) 1 0 0 rg) 1 0 0 rg", "(a (b) 1 0 0 rg) 0.2990 g"),     # balanced literal
    (r"(a \) 1 0 0 rg) 1 0 0 rg", r"(a \) 1 0 0 rg) 0.2990 g"),
    ("1 0 0 rg (open 1 0 0 rg", "0.2990 g (open 1 0 0 rg"),         # unclosed runs to the end
    ("<1 0 0 rg > 1 0 0 rg", "<1 0 0 rg > 0.2990 g"),
    ("<< /A 1 0 0 rg >> 1 0 0 rg", "<< /A 1 0 0 rg >> 0.2990 g"),   # second < opens a hex string
    ("BI\n/W 1\nID\n1 0 0 rg \nEI\n1 0 0 rg", "BI\n/W 1\nID\n1 0 0 rg \nEI\n0.2990 g"),
    ("(" * 33 + "x" + ")" * 33 + " Tj\n1 0 0 rg\n", "(" * 33 + "x" + ")" * 33 + " Tj\n0.2990 g\n"),
    ("(" * 40 + "1 0 0 rg" + ")" * 40 + "1 0 0 rg", "(" * 40 + "1 0 0 rg" + ")" * 40 + "0.2990 g"),
    ("(" * 5000 + ")" * 5000 + " 1 0 0 rg (a)", "(" * 5000 + ")" * 5000 + " 0.2990 g (a)"),
    ("1 0 0 rg " + "(" * 40 + ")" * 39 + " 1 0 0 rg )", "0.2990 g " + "(" * 40 + ")" * 39 + " 1 0 0 rg )"),
    ("1 0 0 rg " + "(" * 40 + ")" * 39 + " 1 0 0 rg", "0.2990 g " + "(" * 40 + ")" * 39 + " 1 0 0 rg"),
    ("BI /W 1\n1 0 0 rg", "BI /W 1\n0.2990 g"),                      # no inline image
    ("BI\n/W 16 /H 1 /CS /G /BPC 8\nID\n\nEI 1 0 0 rg\nzzz\nEI\n1 0 0 rg",   # the end is where the header says
     "BI\n/W 16 /H 1 /CS /G /BPC 8\nID\n\nEI 1 0 0 rg\nzzz\nEI\n0.2990 g"),
    ("BI\n/W 3 /H 1\nID\n(((1 0 0 rg", "BI\n/W 3 /H 1\nID\n(((\nEI0.2990 g"),  # end mark put in
    ("BI\n/W 2 /H 1 /CS /RGB\nID\n\xff\0\0\0\xff\0\nEI\n1 0 0 rg", "BI\n/W 2 /H 1 /CS /G\nID\n\x4c\x96\nEI\n0.2990 g"),
    ("BI\n/W 1 /H 2 /ColorSpace /DeviceCMYK\nID\n\0\0\0\0\0\xff\0\0\nEI",
     "BI\n/W 1 /H 2 /CS /G\nID\n\xff\x69\nEI"),
    ("BI\n/W 9 /H 9 /CS /RGB\nID\n\xff\xff\xff\0", "BI\n/W 9 /H 9 /CS /G\nID\n\xff" + "\0" * 80 + "\nEI"),  # cut off
    ("BI\n/W 9 /H 9 /CS /RGB\nID\n", "BI\n/W 9 /H 9 /CS /G\nID\n" + "\0" * 81 + "\nEI"),
    ("BI\n/W 2 /H 2 /CS /CMYK\nID\n\0\0\0\xff\0\0\0", "BI\n/W 2 /H 2 /CS /G\nID\n\0\xff\xff\xff\nEI"),
    ("BI\n/F /Fl\nID\nabcdef", "BI\n/F /Fl\nID\nabcd\nEI"),  # no end mark found: it takes the last two characters
    ("BI\n/F /Fl\nID\na", "BI\n/F /Fl\nID\n\nEI"),
    ("(BI\n/W 1 /H 1\nID\n) 1 0 0 rg", "(BI\n/W 1 /H 1\nID\n) 0.2990 g"),
    ("/P1 scn", "/P0.0000 g"),                                      # digit of a name read as a tint
]


@pytest.mark.parametrize("gain", [0])
def test_rewrites(spark, gain):
    streams = rewrite.attach_colorspaces(_streams(spark, [t for t, _ in REWRITES]), _spaces(spark, SPACES))
    rows = {r.stream_id: r for r in rewrite.rewrite_streams(streams, gain).collect()}
    for i, (text, expected) in enumerate(REWRITES):
        assert rows[i].error is None, text
        assert rows[i].gray_text == expected, text


def test_tint_without_info_has_no_gain_and_pattern_tint_fails(spark):
    streams = rewrite.attach_colorspaces(
        _streams(spark, ["0.3 scn", "/C4 cs 0.75 scn", "/P1 cs 0.5 scn 1 0 0 rg"]), _spaces(spark, SPACES))
    rows = {r.stream_id: r for r in rewrite.rewrite_streams(streams, 25).collect()}
    assert rows[0].gray_text == "0.7000 g"
    assert rows[1].gray_text == " 0.5000 g"
    assert (rows[2].error, rows[2].gray_text, rows[2].n_rewritten) == ("pattern_tint", "/P1 cs 0.5 scn 1 0 0 rg", 0)


def test_position_mode(spark):
    streams = _streams(spark, ["/C1 cs 0.5 scn /C2 cs 0.5 scn"])
    spaces = [r.space for r in rewrite.current_colorspace(streams, "position").orderBy("segment").collect()]
    assert spaces == ["C1", "C2"]
    spaces = [r.space for r in rewrite.current_colorspace(streams).collect()]
    assert spaces == ["C2", "C2"]


AUDITS = [
    ("0.5 0.5 0.5 rg\n", {}),
    ("0.50 0.50 0.52 rg\n", {"rgb": (1, "0.50 0.50 0.52 rg")}),
    ("(1 0 0 rg) Tj\n", {}),
    ("1 0 0 rg", {}),                                                # needs white space after the operator
    ("9 1 0 0 rg\n", {"rgb": (1, "1 0 0 rg")}),
    ("1 0 0 rg 0 1 0 RG\n", {"rgb": (2, "1 0 0 rg")}),
    ("0 0 0 1 k 0.2 0 0 0 K\n", {"cmyk": (1, "0.2 0 0 0 K")}),
    ("1 0 0 scn 1 0 0 0 SC 1 0 0 0 0 scn 9 9 9 9 9 9 sc\n",
     {"generic3": (1, "1 0 0 scn"), "generic4": (1, "1 0 0 0 SC")}),
    ("1.2.3 0 0.5 rg\n", {"rgb": (1, "1.2.3 0 0.5 rg")}),            # not a number: only the second test counts
    ("/A cs /A CS /B cs\n", {"space(/A)": (2, "/A cs"), "space(/B)": (1, "/B cs")}),
    ("/P scn /S1 sh \nBI \n", {"pattern(/P)": (1, "/P scn"), "shading": (1, "sh"), "inline_image": (1, "BI...")}),
    ("(a (b) 1 0 0 rg ) Tj\n", {"rgb": (1, "1 0 0 rg")}),            # only the innermost literal is masked
]


def test_audit(spark):
    found = scan.summarize_ops(_streams(spark, [t for t, _ in AUDITS])).collect()
    for i, (text, expected) in enumerate(AUDITS):
        assert {r.kind: (r.n, r.sample) for r in found if r.stream_id == i} == expected, text


def test_audit_at_end(spark):
    assert scan.summarize_ops(_streams(spark, ["1 0 0 rg"]), "rewrite").count() == 1


def test_long_inputs_stay_linear(spark):
    long = ["(" + "x" * 200_000 + ") 1 0 0 rg\n", "1 " * 20_000 + "Tj\n", "<" + "0A " * 100_000 + "> 1 0 0 rg\n",
            "(" * 5_000, "0.5 scn (a) " * 20_000]
    streams = _streams(spark, long)
    assert scan.summarize_ops(streams).filter("kind = 'rgb'").count() == 2
    rows = {r.stream_id: r.n_rewritten for r in rewrite.rewrite_streams(streams).collect()}
    assert [rows[i] for i in range(5)] == [1, 0, 1, 0, 20_000]
    assert tokens.with_operands(streams).filter("op = 'Tj'").select(F.max("n_args")).first()[0] == 20_000


def test_rewrite_leaves_no_colour(spark):
    texts = ["1 0 0 rg\n0.1 0.2 0.3 0.4 k\n", "0.1 0.5 0.9 scn\n0.9 0 0 0 1 scn\n/C1 cs\n0.5 scn\n"]
    streams = _streams(spark, texts).withColumn("filter", F.lit(None).cast("array<string>"))
    rows = jobs.rewrite_audit(jobs.gray_streams(streams, _spaces(spark, SPACES))).collect()
    assert {r.kind for r in rows} >= {"rgb", "cmyk", "generic3"}
    assert all(r.n_after == 0 for r in rows)


def test_tokens_concatenate_to_the_text(spark):
    texts = ["a (b (c) \\) d) <0A> << /X 1 >> [1 2] TJ\n", "(open", "<open", " x\u0085y"]
    streams = _streams(spark, texts)
    rebuilt = (tokens.tokenize(streams).groupBy("stream_id")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))),
                                             lambda s: s["tok"]), "").alias("text")))
    assert {r.stream_id: r.text for r in rebuilt.collect()} == dict(enumerate(texts))


def test_latin1_round_trip(spark):
    data = bytes(range(256))
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    row = df.select(tokens.stream_text(F.col("content")).alias("text")).select(
        F.length("text").alias("n"), tokens.stream_bytes(F.col("text")).alias("back")).first()
    assert row.n == 256 and bytes(row.back) == data


def test_too_large_inline_image_fails_its_stream(spark):
    text = "1 0 0 rg\nBI\n/W 99999999999 /H 70000 /CS /RGB\nID\nabc"
    row = rewrite.rewrite_streams(_streams(spark, [text])).first()
    assert row.error == "inline_image_size" and row.gray_text == text and row.n_rewritten == 0


def test_colour_spaces_come_to_the_texts(spark):
    """Under the limit no exchange carries a text; beyond it the result is the same."""
    streams = _streams(spark, [t for t, _ in REWRITES])
    spaces = _spaces(spark, SPACES)
    near, far = rewrite.attach_colorspaces(streams, spaces), rewrite.attach_colorspaces(streams, spaces, 0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x and "text#" in x] and "BroadcastHashJoin" in plan
    rows = [{(r.stream_id, r.gray_text, r.error) for r in rewrite.rewrite_streams(df).collect()} for df in (near, far)]
    assert rows[0] == rows[1]


def test_calls_are_cut_once_before_any_filter(spark):
    """A filter on operator or operands must not cut the calls again."""
    streams = spark.createDataFrame([(1, 1, 0, "0.1  0.2\n0.3 scn 1 sc 0 0 0 1 K")], "doc_id bigint, page_no bigint, stream_id bigint, text string")
    generic = rewrite.rewrite_generic(rewrite.current_colorspace(streams))
    plan = generic._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter") and "regexp_" in line]
    assert [(r.call, r.args, r.gray) for r in generic.collect()] == [("0.1  0.2\n0.3 scn", [0.1, 0.2, 0.3], "0.1815")]


def test_short_key_of_an_inline_image_wins(spark):
    rows = [("/Width 7 /W 2 /H x /Height 3 /CS /RGB /BPC 4",), ("/W /Width 9\n/ColorSpace /DeviceCMYK /F [/A85] /Filter /Fl",), ("",)]
    fields = spark.createDataFrame(rows, "header string").select(*[c.alias(k) for k, c in regions.image_fields(F.col("header")).items()])
    assert [tuple(r) for r in fields.collect()] == [(2, 3, 4, "RGB", ""), (9, 0, 8, "DeviceCMYK", "Fl"), (0, 0, 8, "", "")]
