"""Left-over colour in content streams.

A stream is one row, so its text is masked, matched and summed up where it lies: no token leaves the task
and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.functions import patterns as P
from pagetone.functions.color import let
from pagetone.operators.tokens import KEYS, mask_literals

# Colour limit, and the length of a sample in a message.
LIMIT = 0.01
SAMPLE_CHARS = 40
# Order in which the kinds of a stream are reported.
STAGES = {"rgb": 0, "cmyk": 1, "generic": 2, "space": 3, "pattern": 4, "inline_image": 5, "shading": 6}


def _at(args: Column, i: int) -> Column:
    return F.get(args, F.lit(i))


def differs(args: Column) -> Column:
    """Not gray as RGB: first against second, second against third."""
    limit = F.lit(LIMIT)
    return F.coalesce((F.abs(_at(args, 0) - _at(args, 1)) > limit)
                      | (F.abs(_at(args, 1) - _at(args, 2)) > limit), F.lit(False))


def inked(args: Column) -> Column:
    """Not gray as CMYK: any of the first three above the limit; black is free."""
    limit = F.lit(LIMIT)
    return F.coalesce((_at(args, 0) > limit) | (_at(args, 1) > limit) | (_at(args, 2) > limit), F.lit(False))


def _calls(clean: Column, at_end: str, stages: Sequence[str] = tuple(STAGES)[:5]) -> Column:
    """All colour calls of a text, found in one pass: stage, place, operator, operands, name, sample."""
    numeric = tuple(op for s, ops in (("rgb", P.RGB_OPS), ("cmyk", P.CMYK_OPS), ("generic", P.GENERIC_OPS))
                    if s in stages for op in ops)
    named = tuple(op for s, ops in (("space", P.SPACE_OPS), ("pattern", P.PATTERN_OPS))
                  if s in stages for op in ops)
    found = F.regexp_extract_all(clean, F.lit(P.color_call(at_end, numeric, named)), F.lit(0))
    spaced = F.transform(found, lambda m: F.struct(
        m.alias("sample"), F.split(F.regexp_replace(m, rf"{P.WS}++", " "), " ", -1).alias("words")))

    def parsed(s: Column, i: Column) -> Column:
        words, sample = s["words"], s["sample"]
        n = F.size(words) - 1
        op = F.get(words, n)
        is_named = sample.startswith("/")
        stage = (F.when(is_named & op.isin(*P.SPACE_OPS), STAGES["space"]).when(is_named, STAGES["pattern"])
                  .when(op.isin(*P.RGB_OPS), STAGES["rgb"]).when(op.isin(*P.CMYK_OPS), STAGES["cmyk"])
                  .otherwise(STAGES["generic"]))
        need = (F.when(is_named, 0).when(op.isin(*P.RGB_OPS), 3).when(op.isin(*P.CMYK_OPS), 4).otherwise(n))
        return F.struct(stage.alias("stage"), i.alias("idx"), op.alias("op"), n.alias("n"), need.alias("need"),
                        words.alias("words"), F.when(is_named, F.substring(F.get(words, F.lit(0)), 2, 1 << 30))
                        .alias("name"), sample.alias("sample"))

    def call(c: Column) -> Column:
        args = F.transform(F.slice(c["words"], c["n"] - c["need"] + 1, c["need"]), lambda x: x.try_cast("double"))
        extra = F.concat(F.lit(r"\S+(?:"), F.lit(P.WS), F.lit("++\\S+){"), c["need"].cast("string"), F.lit("}$"))
        sample = F.when((c["need"] == 0) | (c["n"] == c["need"]), c["sample"]).otherwise(
            F.regexp_substr(c["sample"], extra))
        return F.struct(c["stage"].alias("stage"), c["idx"].alias("idx"), c["op"].alias("op"), args.alias("args"),
                        c["name"].alias("name"), sample.alias("sample"))

    complete = F.filter(F.transform(spaced, parsed), lambda c: c["n"] >= c["need"])
    return F.transform(complete, call)


def color_ops(streams: DataFrame, at_end: str = "audit", keys: Sequence[str] = KEYS,
              stages: Sequence[str] = ("rgb", "cmyk", "generic", "space", "pattern")) -> DataFrame:
    """One row per colour operator of the masked text. ``stages`` limits which forms are looked for."""
    keep = [k for k in keys if k in streams.columns]
    return (streams.select(*keep, F.explode(_calls(mask_literals(F.col("text")), at_end, stages)).alias("c"))
            .select(*keep, "c.*").withColumn("n_args", F.size("args")))


def nongray_rgb(ops: DataFrame) -> DataFrame:
    return ops.filter((F.col("stage") == STAGES["rgb"]) & differs(F.col("args")))


def nongray_cmyk(ops: DataFrame) -> DataFrame:
    return ops.filter((F.col("stage") == STAGES["cmyk"]) & inked(F.col("args")))


def nongray_generic3(ops: DataFrame) -> DataFrame:
    """Generic operators with exactly three numbers."""
    return ops.filter((F.col("stage") == STAGES["generic"]) & (F.col("n_args") == 3)
                      & differs(F.col("args")))


def nongray_generic4(ops: DataFrame) -> DataFrame:
    """Generic operators with exactly four numbers."""
    return ops.filter((F.col("stage") == STAGES["generic"]) & (F.col("n_args") == 4) & inked(F.col("args")))


def _named_uses(ops: DataFrame, stage: str) -> DataFrame:
    keys = [k for k in KEYS if k in ops.columns]
    return (ops.filter(F.col("stage") == STAGES[stage]).groupBy(*keys, "name")
            .agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx")))


def colorspace_uses(ops: DataFrame) -> DataFrame:
    """Colour spaces chosen in each stream, gray or not."""
    return _named_uses(ops, "space")


def pattern_uses(ops: DataFrame) -> DataFrame:
    """Patterns called in each stream."""
    return _named_uses(ops, "pattern")


def has_inline_image(clean: Column) -> Column:
    return clean.rlike(P.INLINE_IMAGE_TOKEN)


def has_shading_op(clean: Column) -> Column:
    return clean.rlike(P.SHADING_TOKEN)


def inline_image_flag(streams: DataFrame) -> DataFrame:
    """Streams with an inline image: reported once, however many there are."""
    keep = [k for k in KEYS if k in streams.columns]
    return (streams.filter(has_inline_image(mask_literals(F.col("text"))))
            .select(*keep, F.lit(1).cast("bigint").alias("n"), F.lit("BI...").alias("sample")))


def shading_op_flag(streams: DataFrame) -> DataFrame:
    """Streams with a shading operator: reported once."""
    keep = [k for k in KEYS if k in streams.columns]
    return (streams.filter(has_shading_op(mask_literals(F.col("text"))))
            .select(*keep, F.lit(1).cast("bigint").alias("n"), F.lit("sh").alias("sample")))


_HIT = "struct<stage:int,kind:string,idx:int,sample:string>"


def _hits(clean: Column, at_end: str) -> Column:
    """Every hit of a stream as (stage, kind, idx, sample), in that order."""
    def is_hit(c: Column) -> Column:
        stage, n = c["stage"], F.size(c["args"])
        as_rgb = (stage == STAGES["rgb"]) | ((stage == STAGES["generic"]) & (n == 3))
        as_cmyk = (stage == STAGES["cmyk"]) | ((stage == STAGES["generic"]) & (n == 4))
        return (stage >= STAGES["space"]) | (as_rgb & differs(c["args"])) | (as_cmyk & inked(c["args"]))

    def to_hit(c: Column) -> Column:
        stage = c["stage"]
        kind = (F.when(stage == STAGES["rgb"], "rgb").when(stage == STAGES["cmyk"], "cmyk")
                 .when(stage == STAGES["generic"], F.concat(F.lit("generic"), F.size(c["args"]).cast("string")))
                 .when(stage == STAGES["space"], F.concat(F.lit("space(/"), c["name"], F.lit(")")))
                 .otherwise(F.concat(F.lit("pattern(/"), c["name"], F.lit(")"))))
        return F.struct(stage.alias("stage"), kind.alias("kind"), c["idx"].alias("idx"), c["sample"].alias("sample"))

    def flag(test: Column, stage: str, sample: str) -> Column:
        hit = F.struct(F.lit(STAGES[stage]).alias("stage"), F.lit(stage).alias("kind"), F.lit(0).alias("idx"),
                       F.lit(sample).alias("sample"))
        return F.when(test, F.array(hit)).otherwise(F.array().cast(f"array<{_HIT}>"))

    calls = F.transform(F.filter(_calls(clean, at_end), is_hit), to_hit)
    return F.array_sort(F.concat(calls, flag(has_inline_image(clean), "inline_image", "BI..."),
                                 flag(has_shading_op(clean), "shading", "sh")))


def _runs(hits: Column) -> Column:
    """One entry per kind of sorted hits: where the kind starts, and how far to the next one."""
    def starts(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(
            (i == 0) | (x["kind"] != F.get(h, i - 1)["kind"]) | (x["stage"] != F.get(h, i - 1)["stage"]), i))
        return F.filter(at, lambda i: i.isNotNull())

    def summary(h: Column, at: Column) -> Column:
        def entry(p: Column, k: Column) -> Column:
            first = F.get(h, p)
            n = F.coalesce(F.get(at, k + 1), F.size(h)) - p
            return F.struct(first["stage"].alias("stage"), first["kind"].alias("kind"),
                            n.cast("bigint").alias("n"), first["idx"].alias("first_idx"),
                            F.substring(first["sample"], 1, SAMPLE_CHARS).alias("sample"))
        return F.transform(at, entry)

    return let(hits, lambda h: let(starts(h), lambda at: summary(h, at)))


def summarize_ops(streams: DataFrame, at_end: str = "audit", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per stream and kind: how often, and the first hit as the sample.

    The hits of one stream are sorted and counted inside its row, so nothing is shuffled.
    """
    found = let(mask_literals(F.col("text")), lambda clean: _runs(_hits(clean, at_end)))
    keep = [k for k in keys if k in streams.columns]
    return streams.select(*keep, F.explode(found).alias("h")).select(*keep, "h.*")
