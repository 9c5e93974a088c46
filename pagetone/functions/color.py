"""Gray maths as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# BT.601 luma weights, and the two dot-gain curves the engine knows (percent).
LUMA_R, LUMA_G, LUMA_B = 0.299, 0.587, 0.114
DOT_GAINS = (0, 20, 25)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    ``element_at`` knows its type; ``get`` derives it anew from the whole of ``body`` for every value.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def luma_rgb(r: Column, g: Column, b: Column) -> Column:
    """Luma of RGB in 0..1."""
    return F.lit(LUMA_R) * r + F.lit(LUMA_G) * g + F.lit(LUMA_B) * b


def luma_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Luma of CMYK in 0..1."""
    one = F.lit(1.0)
    light = one - k
    return luma_rgb((one - c) * light, (one - m) * light, (one - y) * light)


def round_half_up(x: Column) -> Column:
    """Nearest integer, ties towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("int")


def luma_rgb8(r: Column, g: Column, b: Column) -> Column:
    """Luma of bytes, as a byte."""
    return round_half_up(luma_rgb(r, g, b))


def luma_cmyk8(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Luma of CMYK bytes, as a byte."""
    full = F.lit(255.0)
    return round_half_up(full * luma_cmyk(c / full, m / full, y / full, k / full))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def dot_gain(v: Column, gain: int) -> Column:
    """Dot-gain correction of a known gray in 0..1. Gain 0 leaves the value as it is, unclamped."""
    if not gain:
        return v
    x = clamp01(v)
    if gain == 25:
        return F.sqrt(x)
    if gain == 20:
        dot = (F.lit(1.8) - F.sqrt(F.lit(0.04) + F.lit(3.2) * x)) / F.lit(1.6)
        return F.lit(1.0) - clamp01(dot)
    return x


def dot_gain8(v: Column, gain: int) -> Column:
    """Dot-gain correction of a gray byte, computed in place."""
    if not gain:
        return v.cast("int")
    return round_half_up(dot_gain(v / F.lit(255.0), gain) * F.lit(255.0))


def dot_gain_lut(spark: SparkSession, gain: int) -> DataFrame:
    """The 256-row table of one dot gain."""
    v_in = F.col("id").cast("int")
    return spark.range(256).select(
        F.lit(gain).alias("gain"), v_in.alias("v_in"), dot_gain8(v_in, gain).alias("v_out"))


def apply_lut(df: DataFrame, lut: DataFrame, column: str = "gray") -> DataFrame:
    """Map a gray byte column through a table; the table has 256 rows, so it is always broadcast."""
    table = F.broadcast(lut.select(F.col("v_in").alias(column), F.col("v_out").alias("_out")))
    rest = [c for c in df.columns if c != column]
    return df.join(table, column).select(*rest, F.col("_out").alias(column))


def compose_luts(first: DataFrame, second: DataFrame) -> DataFrame:
    """One table that maps through ``first`` and then ``second`` (both 256 rows)."""
    inner = first.select("v_in", F.col("v_out").alias("_mid"))
    outer = F.broadcast(second.select(F.col("v_in").alias("_mid"), "v_out"))
    return inner.join(outer, "_mid").select("v_in", "v_out")


def tint_channels(t: Column, n: Column, c0: Column, c1: Column) -> Column:
    """Exponential interpolation c0 + t^n (c1 - c0), channel by channel."""
    return let(F.pow(t, n), lambda tn: F.zip_with(c0, c1, lambda lo, hi: lo + tn * (hi - lo)))


def tint_luma(t: Column, info: Column) -> Column:
    """Gray of one tint before dot gain. ``info`` is a struct (fn_n, c0, c1, alt); NULL c0 gives NULL."""
    ch = tint_channels(t, info["fn_n"], info["c0"], info["c1"])

    def by_alternate(c: Column) -> Column:
        def at(i: int) -> Column:
            return F.get(c, F.lit(i))

        return (F.when(c.isNull(), F.lit(None).cast("double"))
                .when((info["alt"] == "/DeviceCMYK") & (F.size(c) >= 4),
                      luma_cmyk(at(0), at(1), at(2), at(3)))
                .when((info["alt"] == "/DeviceRGB") & (F.size(c) >= 3), luma_rgb(at(0), at(1), at(2)))
                .when((info["alt"] == "/DeviceGray") & (F.size(c) >= 1), at(0))
                .otherwise(F.lit(1.0) - t))

    return let(ch, by_alternate)


def tint_to_gray(t: Column, info: Column, gain: int = 0) -> Column:
    """Gray of one tint under its colour space, with dot gain; NULL without a tint function."""
    return F.when(info["c0"].isNotNull(), dot_gain(tint_luma(t, info), gain))


def tint_table(info: Column) -> Column:
    """Gray bytes of the 256 tints of one colour space, before dot gain; NULL without a tint function."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: round_half_up(tint_luma(v / F.lit(255.0), info) * F.lit(255.0)))
    return F.when(info["c0"].isNotNull(), F.transform(bytes_, lambda b: F.greatest(F.lit(0), F.least(F.lit(255), b))))


def tint_tables(colorspaces: DataFrame) -> DataFrame:
    """(doc_id, space, tint): one table of 256 gray bytes per named colour space with a tint function."""
    info = F.struct("fn_n", "c0", "c1", "alt")
    return colorspaces.filter("c0 IS NOT NULL").select("doc_id", F.col("name").alias("space"), tint_table(info).alias("tint"))


def _ten_thousandths(v: Column) -> Column:
    """|v| x 10000 rounded to an integer on the exact binary value, ties up.

    The number is split into a 26-bit head and a tail, so both products with 10000 are exact and the
    comparison with one half sees no rounding error.
    """
    splitter = F.lit(134217729.0)  # 2^27 + 1
    x = F.abs(v)
    head = x * splitter - (x * splitter - x)
    scaled_head = head * F.lit(10000.0)
    tail = (x - head) * F.lit(10000.0)
    whole = F.floor(scaled_head)
    over_half = scaled_head - whole - F.lit(0.5)
    return (whole + F.when(over_half >= -tail, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def gray4(v: Column) -> Column:
    """Four decimals, as a number."""
    return F.signum(v) * _ten_thousandths(v) / F.lit(10000.0)


def gray4_text(v: Column) -> Column:
    """Four decimals, as the text that goes into a stream."""
    def show(x: Column, q: Column) -> Column:
        sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.floor(q / F.lit(10000)).cast("string"), F.lit("."),
                        F.lpad((q % F.lit(10000)).cast("string"), 4, "0"))

    return let(v, lambda x: let(_ten_thousandths(x), lambda q: show(x, q)))
