"""Raster tables: status and padding of decoded data, pixels, delta filters, gray.

An image is cut into tiles of whole rows, and a row is an array of samples. Row filters are undone, luma is taken and
differences are written inside these arrays; only images whose rows refer upwards over a tile's border move
anything, one row per tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.functions.color import dot_gain8, let, luma_cmyk8, luma_rgb8

# Predictor codes and row-filter tags.
TIFF_PREDICTOR, ROW_PREDICTORS_FROM = 2, 10
TAG_SUB, TAG_UP, TAG_AVERAGE, TAG_PAETH = 1, 2, 3, 4
WHITE = 255
CHANNELS = ("c1", "c2", "c3", "c4")
#: Samples of a tile (a tile has one row at least), and columns that are carried from tile to tile in one group.
TILE_VALUES, CARRY_COLUMNS = 1 << 14, 256


def _tagged() -> Column:
    return F.col("predictor") >= ROW_PREDICTORS_FROM


def row_bytes() -> Column:
    """Bytes of one row, with its tag where rows are tagged."""
    return (F.col("w").cast("bigint") * F.col("channels") + F.when(_tagged(), 1).otherwise(0)).cast("int")


def expected_length() -> Column:
    return row_bytes().cast("bigint") * F.col("h")


def raster_status(rasters: DataFrame) -> DataFrame:
    """ok, padded, or why the data cannot be used.

    Raw data and data cut off in the middle may be short and are padded; data that decoded cleanly may not.
    """
    short = F.col("decoded_len") < F.col("expected_len")
    wrong = F.when(_tagged(), "predictor_fail").otherwise("length_fail")
    return (rasters.withColumn("expected_len", expected_length())
            .withColumn("status", F
                        .when(F.col("decoded_len").isNull() | (~F.col("is_raw") & (F.col("decoded_len") <= 0)),
                              "inflate_fail")
                        .when(F.col("decoded_len") == F.col("expected_len"), "ok")
                        .when(short & (F.col("is_raw") | F.col("is_cut")), "padded").otherwise(wrong)))


def fill_value() -> Column:
    """0 for tagged rows (a valid tag) and for CMYK (no ink), else white."""
    return F.when(_tagged() | (F.col("channels") == 4), 0).otherwise(WHITE)


def pad_rule(rasters: DataFrame) -> DataFrame:
    """Fill value and number of bytes missing."""
    missing = F.greatest(F.col("expected_len") - F.col("decoded_len"), F.lit(0))
    return (raster_status(rasters).withColumn("fill", fill_value())
            .withColumn("n_missing", F.when(F.col("status") == "padded", missing).otherwise(F.lit(0))))


def _row_tag(y: Column) -> Column:
    """Tag of one row, read in place; 0 beyond the data, as padded."""
    at = y * row_bytes() + 1
    return F.coalesce(F.conv(F.hex(F.substring("bytes", at, F.lit(1))), 16, 10).try_cast("int"), F.lit(0))


def filter_mode(rasters: DataFrame) -> DataFrame:
    """Add ``filter_mode``: none, tiff, sub, up or unsupported, without unpacking a pixel."""
    rows = F.sequence(F.lit(0), F.col("h") - 1)

    def has(*tags: int) -> Column:
        return F.exists(rows, lambda y: _row_tag(y).isin(*tags))

    mode = (F.when(F.col("predictor") == TIFF_PREDICTOR, "tiff").when(~_tagged(), "none")
             .when(has(TAG_AVERAGE, TAG_PAETH), "unsupported").when(has(TAG_UP), "up")
             .when(has(TAG_SUB), "sub").otherwise("none"))
    return rasters.withColumn("filter_mode", mode)


def raster_errors(rasters: DataFrame) -> DataFrame:
    """(image_id, error): one row for every raster that yields no gray pixels, with the reason.

    A status other than ok or padded is its own reason. Decoding two-directional row filters fails as a
    predictor does; rasters of two channels have no luma, those of one channel need a ``tint`` table where they have a
    ``space``; an image without area has no pixels.
    """
    no_area = ~F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    no_tint = ((F.col("channels") == 1) & F.col("space").isNotNull() & F.col("tint").isNull()
               if {"space", "tint"} <= set(rasters.columns) else F.lit(False))
    reason = (F.when(no_area, "no_pixels").when(~F.col("status").isin("ok", "padded"), F.col("status"))
               .when(~F.coalesce(F.col("channels").isin(1, 3, 4), F.lit(False)), "channels_unsupported")
               .when(F.col("filter_mode") == "unsupported", "predictor_fail").when(no_tint, "tint_unsupported"))
    # An empty image is known without its rows, and a sequence of none of them would count down.
    sized = filter_mode(pad_rule(rasters.withColumns({
        "w": F.when(no_area, 0).otherwise(F.col("w")), "h": F.when(no_area, 1).otherwise(F.col("h"))})))
    return sized.select("image_id", reason.alias("error")).filter("error IS NOT NULL")


def unpack_tiles(rasters: DataFrame) -> DataFrame:
    """Usable rasters as tiles of rows: (image_id, w, h, channels, filter_mode, n_tiles, tile, rows, tint).

    ``rows`` is an array of (y, tag, v); ``v`` holds the samples of a row, channels interleaved, as stored, with missing
    ones filled. A task never holds more than one tile as values. ``tint`` is passed on where rasters have it.
    """
    usable = filter_mode(pad_rule(rasters)).filter(
        F.col("status").isin("ok", "padded") & (F.col("w") > 0) & (F.col("h") > 0))
    if "tint" not in usable.columns:
        usable = usable.withColumn("tint", F.lit(None).cast("array<int>"))
    per_tile = F.greatest(F.lit(1), F.floor(F.lit(TILE_VALUES) / F.col("row_bytes"))).cast("int")
    usable = usable.select("image_id", "w", "h", "channels", "filter_mode", "tint", "fill", "bytes", row_bytes().alias("row_bytes"),
                           F.when(_tagged(), 1).otherwise(0).alias("skip")).withColumn("per_tile", per_tile)
    n_tiles = F.ceil(F.col("h") / F.col("per_tile")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), n_tiles - 1), lambda t: F.struct(
        t.alias("tile"), F.substring("bytes", t * F.col("per_tile") * F.col("row_bytes") + 1, F.col("per_tile") * F.col("row_bytes")).alias("data")))
    cut = usable.select("image_id", "w", "h", "channels", "filter_mode", "tint", "fill", "row_bytes", "skip", "per_tile",
                        n_tiles.alias("n_tiles"), F.explode(tiles).alias("t"))
    first = F.col("t.tile") * F.col("per_tile")
    width = F.col("w") * F.col("channels")
    chars = F.split(F.decode("t.data", "ISO-8859-1"), "", -1)
    values = F.when(F.length("t.data") > 0, F.transform(chars, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))

    def row(r: Column, v: Column) -> Column:
        own = F.slice(v, r * F.col("row_bytes") + F.col("skip") + 1, width)
        filled = let(own, lambda x: F.concat(x, F.array_repeat(F.col("fill"), width - F.size(x))))
        tag = F.when(F.col("skip") == 1, F.coalesce(F.get(v, r * F.col("row_bytes")), F.lit(0)))
        return F.struct((first + r).alias("y"), tag.alias("tag"), filled.alias("v"))

    rows = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.least(F.col("per_tile"), F.col("h") - first) - 1), lambda r: row(r, v)))
    return cut.select("image_id", "w", "h", "channels", "filter_mode", "n_tiles", F.col("t.tile").alias("tile"), rows.alias("rows"), "tint")


def unpack_pixels(rasters: DataFrame) -> DataFrame:
    """One row per pixel of every usable raster, channels side by side, as stored (filters not undone).

    The image is cut into its rows first, so no task ever holds more than one row of one image as values.
    """
    usable = filter_mode(pad_rule(rasters)).filter(
        F.col("status").isin("ok", "padded") & (F.col("w") > 0) & (F.col("h") > 0))
    rows = usable.select(
        "image_id", "w", "channels", "filter_mode", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"),
        row_bytes().alias("row_bytes"), F.when(_tagged(), 1).otherwise(0).alias("skip"), "fill", "bytes")
    rows = rows.select(
        "image_id", "w", "channels", "filter_mode", "y", "skip", "fill",
        F.substring("bytes", F.col("y") * F.col("row_bytes") + 1, F.col("row_bytes")).alias("row"))
    chars = F.split(F.decode("row", "ISO-8859-1"), "", -1)
    rows = rows.select(
        "image_id", "w", "channels", "filter_mode", "y", "skip", "fill",
        F.when(F.length("row") > 0, F.transform(chars, lambda c: F.ascii(c)))
         .otherwise(F.array().cast("array<int>")).alias("v"))

    def sample(k: int) -> Column:
        place = F.col("skip") + F.col("x") * F.col("channels") + k
        return F.when(F.col("channels") > k, F.coalesce(F.get("v", place), F.col("fill")))

    tag = F.when(F.col("skip") == 1, F.coalesce(F.get("v", F.lit(0)), F.lit(0)))
    return (rows.select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
            .select("image_id", "filter_mode", "y", tag.alias("tag"), "x", *[sample(k).alias(c) for k, c in enumerate(CHANNELS)]))


def unpack_samples(pixels: DataFrame) -> DataFrame:
    """One row per pixel and channel."""
    values = F.filter(F.array(*[F.struct(F.lit(i).alias("ch"), F.col(c).alias("v"))
                                for i, c in enumerate(CHANNELS)]), lambda s: s["v"].isNotNull())
    return pixels.select("image_id", "y", "x", "tag", F.explode(values).alias("s")).select(
        "image_id", "y", "x", "tag", "s.*")


# --- undoing filters inside rows ---------------------------------------------------------------------

def running_sums(v: Column, stride: Column, steps: Column) -> Column:
    """Sums of every value and those before it at a distance of ``stride``, mod 256.

    Each round adds the sums that end twice as far back, so a row of n pixels takes log2(n) rounds.
    """
    rounds = F.ceil(F.log2(F.greatest(steps, F.lit(1)))).cast("int")
    reaches = F.transform(F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), rounds), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(reaches, v, lambda acc, reach: F.transform(
        acc, lambda x, i: (x + F.coalesce(F.get(acc, i - reach * stride), F.lit(0))).bitwiseAND(255)))


def _across(row: Column) -> Column:
    """A row with its horizontal differences undone, if it has any."""
    summed = (F.col("filter_mode") == "tiff") | (F.coalesce(row["tag"] == TAG_SUB, F.lit(False)) & F.col("filter_mode").isin("sub", "up"))
    v = F.when(summed, running_sums(row["v"], F.col("channels"), F.col("w"))).otherwise(row["v"])
    return F.struct(row["y"].alias("y"), row["tag"].alias("tag"), v.alias("v"))


def delta_decode(tiles: DataFrame) -> DataFrame:
    """Undo horizontal differences, row by row; nothing leaves its row."""
    return tiles.withColumn("rows", F.transform("rows", _across))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(255))


def _is_up(row: Column) -> Column:
    return F.coalesce(row["tag"] == TAG_UP, F.lit(False))


def _down(rows: Column) -> Column:
    """Rows of a tile with Up undone, as if zeros were above the tile."""
    width = F.col("w") * F.col("channels")
    empty = F.expr("CAST(array() AS array<struct<y:int,tag:int,v:array<int>>>)")
    start = F.struct(F.array_repeat(F.lit(0), width).alias("above"), empty.alias("done"))

    def add(acc: Column, row: Column) -> Column:
        v = F.when(_is_up(row), _add(acc["above"], row["v"])).otherwise(row["v"])
        return let(v, lambda x: F.struct(x.alias("above"), F.concat(acc["done"], F.array(F.struct(
            row["y"].alias("y"), row["tag"].alias("tag"), x.alias("v")))).alias("done")))

    return F.aggregate(rows, start, add, lambda acc: acc["done"])


def _carried(tiles: DataFrame) -> DataFrame:
    """Tiles whose first rows refer to the tile above them get its last row added.

    The last row of a tile is known once that of the tile above is, unless the tile has a row that does not refer
    upwards. So the last rows are carried down per image and block of columns, one short array per tile, and each
    tile gets one row back.
    """
    keys = ["image_id", "block"]
    width = F.col("w") * F.col("channels")
    closed = F.exists("rows", lambda r: ~_is_up(r))
    last = F.element_at("rows", -1)["v"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((width - 1) / F.lit(CARRY_COLUMNS)).cast("int")), lambda b: F.struct(
        b.alias("block"), F.slice(F.col("last"), b * CARRY_COLUMNS + 1, F.lit(CARRY_COLUMNS)).alias("part")))
    ends = (tiles.select("image_id", "tile", "w", "channels", closed.alias("closed"), last.alias("last"))
            .select("image_id", "tile", "closed", F.explode(blocks).alias("b")).select("image_id", "b.block", "tile", "closed", "b.part"))
    start = F.struct(F.lit(None).cast("array<int>").alias("above"), F.expr("CAST(array() AS array<struct<tile:int,part:array<int>>>)").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        below = F.when(t["closed"] | acc["above"].isNull(), t["part"]).otherwise(_add(acc["above"], t["part"]))
        carry = F.coalesce(acc["above"], F.transform(t["part"], lambda x: F.lit(0)))
        return F.struct(below.alias("above"), F.concat(acc["out"], F.array(F.struct(t["tile"].alias("tile"), carry.alias("part")))).alias("out"))

    scanned = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tile", "closed", "part"))).alias("tiles")).select(
        *keys, F.explode(F.aggregate("tiles", start, add, lambda acc: acc["out"])).alias("c"))
    carry = scanned.groupBy("image_id", F.col("c.tile").alias("tile")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "c.part"))), lambda x: x["part"])).alias("carry"))
    open_rows = F.array_position(F.transform("rows", lambda r: ~_is_up(r)), True)
    n_open = F.when(open_rows == 0, F.size("rows")).otherwise(open_rows - 1).cast("int")
    fixed = F.transform("rows", lambda r, i: F.struct(
        r["y"].alias("y"), r["tag"].alias("tag"), F.when(i < F.col("n_open"), _add(r["v"], F.col("carry"))).otherwise(r["v"]).alias("v")))
    return (tiles.join(carry, ["image_id", "tile"]).withColumn("n_open", n_open).withColumn("rows", fixed).select(*tiles.columns))


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """Undo whatever filter each image uses: None, Sub and Up in any mix inside an image, and TIFF differences.

    A Sub row depends on itself only, an Up row on the decoded row above. So rows are summed along first, then down
    inside their tile, and what a tile hands to the next is carried over. Average and Paeth rows are sequential in
    both directions; their images are left out (see ``raster_errors``).
    """
    summed = delta_decode(tiles.filter("filter_mode <> 'unsupported'"))
    summed = summed.withColumn("rows", F.when(F.col("filter_mode") == "up", _down(F.col("rows"))).otherwise(F.col("rows")))
    crosses = (F.col("filter_mode") == "up") & (F.col("n_tiles") > 1)
    return summed.filter(~crosses).unionByName(_carried(summed.filter(crosses)))


def row_delta_decode(rasters: DataFrame) -> DataFrame:
    """Decoded rows of images with tagged row filters; an image that cannot be decoded is one row with its error.

    (image_id, w, channels, y, v, error). Images whose rows are all stored plainly are left out.
    """
    tagged = rasters.filter(_tagged())
    tiles = unpack_tiles(tagged)
    rows = tile_rows(decode_tiles(tiles.filter(F.col("filter_mode").isin("sub", "up"))))
    return rows.drop("tag").withColumn("error", F.lit(None).cast("string")).unionByName(
        raster_errors(tagged), allowMissingColumns=True)


def tile_rows(tiles: DataFrame) -> DataFrame:
    """One row per image row, with its samples as an array."""
    return tiles.select("image_id", "w", "channels", F.explode("rows").alias("r")).select("image_id", "w", "channels", "r.*")


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """One row per pixel, channels side by side."""
    def sample(k: int) -> Column:
        return F.when(F.col("channels") > k, F.get("v", F.col("x") * F.col("channels") + k))

    return tile_rows(tiles).select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x")).select(
        "image_id", "y", "x", *[sample(k).alias(c) for k, c in enumerate(CHANNELS)])


# --- gray ---------------------------------------------------------------------------------------------

def gray_tiles(tiles: DataFrame, gain: int = 0) -> DataFrame:
    """Decoded tiles as gray: ``rows`` of (y, g). Luma is rounded first, then corrected for dot gain.

    One channel is gray already, or looked up in the ``tint`` table of its colour space, by position.
    """
    def gray(v: Column, x: Column) -> Column:
        at = [F.get(v, x * F.col("channels") + k) for k in range(4)]
        tinted = F.when(F.col("tint").isNull(), at[0]).otherwise(F.get("tint", at[0]))
        luma = F.when(F.col("channels") == 4, luma_cmyk8(*at)).when(F.col("channels") == 3, luma_rgb8(*at[:3])).otherwise(tinted)
        return let(luma, lambda byte: dot_gain8(byte, gain))

    rows = F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.transform(
        F.sequence(F.lit(0), F.col("w") - 1), lambda x: gray(r["v"], x)).alias("g")))
    return tiles.select("image_id", "w", "h", "tile", rows.alias("rows"))


def delta_encode(gray: DataFrame) -> DataFrame:
    """Gray tiles with the horizontal differences of each row, mod 256, in ``g``; every row is tagged Sub."""
    def differences(g: Column) -> Column:
        return F.transform(g, lambda x, i: (x - F.coalesce(F.get(g, i - 1), F.lit(0))).bitwiseAND(255))

    return gray.withColumn("rows", F.transform("rows", lambda r: F.struct(
        r["y"].alias("y"), F.lit(TAG_SUB).alias("tag"), differences(r["g"]).alias("g"))))


def packed_images(coded: DataFrame) -> DataFrame:
    """(image_id, w, h, gray): encoded tiles put together again, a tag and the differences per row, as bytes."""
    def text(r: Column) -> Column:
        return F.concat(F.char(r["tag"]), F.array_join(F.transform(r["g"], lambda x: F.char(x)), ""))

    lines = coded.select("image_id", "w", "h", "tile", F.array_join(F.transform("rows", text), "").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("tile", "text")))
    return lines.groupBy("image_id", "w", "h").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).select(
        "image_id", "w", "h", F.encode("text", "ISO-8859-1").alias("gray"))


def gray_pixels(gray: DataFrame) -> DataFrame:
    """One row per gray pixel."""
    return gray.select("image_id", F.explode("rows").alias("r")).select(
        "image_id", "r.y", F.posexplode("r.g").alias("x", "gray"))


def pixels_to_gray(pixels: DataFrame, gain: int = 0) -> DataFrame:
    """Gray byte of every pixel: luma is rounded first, then corrected for dot gain."""
    c1, c2, c3, c4 = (F.col(c) for c in CHANNELS)
    luma = F.when(c4.isNotNull(), luma_cmyk8(c1, c2, c3, c4)).otherwise(luma_rgb8(c1, c2, c3))
    return pixels.select("image_id", "y", "x", dot_gain8(luma, gain).alias("gray"))


def gray_histogram(gray: DataFrame) -> DataFrame:
    """Pixels per gray level of each image; an image that failed is one row with its error and no pixels."""
    return gray.groupBy("image_id", "gray", "error").agg(F.count("gray").alias("n"))
