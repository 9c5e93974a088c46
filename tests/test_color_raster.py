"""Gray maths, rasters and pages."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetone.functions import color
from pagetone.operators import pages, raster
from pagetone.plans import audit as jobs


def test_four_decimals_follow_the_exact_binary_value(spark):
    rng = np.random.default_rng(7)
    values = [0.00015, 0.03125, 0.09375, 0.5, 0.0, 1.0, -0.25, 0.99995, 0.00005, 1.00005]
    values += [float(v) for v in rng.random(3000)] + [float(i) / 20000 for i in range(1, 20000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, text in df.select("v", color.gray4_text(F.col("v"))).collect():
        exact = abs(Decimal(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        assert text == ("-" if v < 0 else "") + str(exact), v


def test_dot_gain_tables(spark):
    for gain in (0, 20, 25):
        out = [r.v_out for r in color.dot_gain_lut(spark, gain).orderBy("v_in").collect()]
        assert out[0] == 0 and out[255] == 255 and out == sorted(out)
    assert [r.v_out for r in color.dot_gain_lut(spark, 25).filter("v_in = 64").collect()] == [128]


def _undo(raw: np.ndarray, tags: list[int]) -> np.ndarray:
    out = np.zeros_like(raw)
    for y in range(raw.shape[0]):
        for x in range(raw.shape[1]):
            left = out[y, x - 1] if x else 0
            up = out[y - 1, x] if y else 0
            out[y, x] = (raw[y, x] + {0: 0, 1: left, 2: up}[tags[y]]) % 256
    return out


def test_mixed_row_filters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    h, w, expected, rows = 9, 5, {}, []
    for image in range(6):
        tags = [int(t) for t in rng.integers(0, 3, h)]
        raw = rng.integers(0, 256, (h, w, 3))
        expected[image] = _undo(raw, tags)
        body = b"".join(bytes([tags[y]]) + bytes(raw[y].astype(np.uint8).tobytes()) for y in range(h))
        rows.append((image, w, h, 3, 15, True, False, len(body), bytearray(body)))
    rasters = spark.createDataFrame(rows, "image_id bigint, w int, h int, channels int, predictor int, "
                                          "is_raw boolean, is_cut boolean, decoded_len bigint, bytes binary")
    for r in raster.tile_pixels(raster.decode_tiles(raster.unpack_tiles(rasters))).collect():
        assert [r.c1, r.c2, r.c3] == list(expected[r.image_id][r.y, r.x])
        assert r.c4 is None


RASTERS = ("image_id bigint, w int, h int, channels int, predictor int, is_raw boolean, is_cut boolean, "
           "decoded_len bigint, bytes binary")


def _decoded(tags, raw, channels):
    """Brute force over interleaved rows of ``channels`` samples a pixel."""
    out = np.zeros_like(raw)
    for y in range(raw.shape[0]):
        for x in range(raw.shape[1]):
            left = out[y, x - channels] if x >= channels else 0
            out[y, x] = (raw[y, x] + {0: 0, 1: left, 2: out[y - 1, x] if y else 0}[tags[y]]) % 256
    return out


@pytest.mark.parametrize("tile_values, carry_columns", [(1 << 14, 256), (60, 7), (1, 1)])
def test_upward_rows_over_tile_borders(spark, monkeypatch, tile_values, carry_columns):
    """With small tiles every few rows are a tile, and Up runs cross several; sums must still reach down."""
    monkeypatch.setattr(raster, "TILE_VALUES", tile_values)
    monkeypatch.setattr(raster, "CARRY_COLUMNS", carry_columns)
    rng = np.random.default_rng(11)
    rows, expected = [], {}
    for image, share in enumerate([0.0, 0.5, 0.9, 1.0, 0.97]):
        h, w, channels = 40, 6, 3 + image % 2
        tags = [2 if rng.random() < share else int(rng.integers(0, 2)) for _ in range(h)]
        raw = rng.integers(0, 256, (h, w * channels))
        expected[image] = _decoded(tags, raw, channels)
        body = b"".join(bytes([tags[y]]) + raw[y].astype(np.uint8).tobytes() for y in range(h))
        rows.append((image, w, h, channels, 15, True, False, len(body), bytearray(body)))
    got = raster.tile_rows(raster.decode_tiles(raster.unpack_tiles(spark.createDataFrame(rows, RASTERS)))).collect()
    assert len(got) == 5 * 40
    for r in got:
        assert r.v == list(expected[r.image_id][r.y])


def _unpacked(gray: bytes, w: int) -> list[list[int]]:
    """A reader of packed images: tag 1, then differences."""
    lines = [gray[i:i + w + 1] for i in range(0, len(gray), w + 1)]
    assert all(line[0] == 1 for line in lines)
    return [np.cumsum(list(line[1:])).astype(np.uint8).tolist() for line in lines]


@pytest.mark.parametrize("tile_values", [1 << 14, 100])
def test_gray_images_round_trip(spark, monkeypatch, tile_values):
    monkeypatch.setattr(raster, "TILE_VALUES", tile_values)
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for image, (w, h, channels) in enumerate([(50, 9, 3), (1, 1, 4), (7, 30, 4), (200, 2, 3), (13, 5, 1)]):
        raw = rng.integers(0, 256, (h, w, channels))
        if channels == 3:
            gray = np.floor(0.299 * raw[..., 0] + 0.587 * raw[..., 1] + 0.114 * raw[..., 2] + 0.5)
        elif channels == 4:
            c, m, y, k = (raw[..., i] / 255.0 for i in range(4))
            gray = np.floor(255.0 * (0.299 * ((1 - c) * (1 - k)) + 0.587 * ((1 - m) * (1 - k)) + 0.114 * ((1 - y) * (1 - k))) + 0.5)
        else:
            gray = raw[..., 0]
        expected[image] = gray.astype(int).tolist()
        body = raw.astype(np.uint8).tobytes()
        rows.append((image, w, h, channels, 1, True, False, len(body), bytearray(body)))
    rows.append((9, 2, 2, 2, 1, True, False, 8, bytearray(8)))
    got = {r.image_id: r for r in jobs.gray_images(spark.createDataFrame(rows, RASTERS)).collect()}
    assert len(got) == 6 and got[9].error == "channels_unsupported" and got[9].gray is None
    for image, gray in expected.items():
        assert _unpacked(bytes(got[image].gray), got[image].w) == gray and got[image].error is None


def test_tints_go_through_the_table_of_their_space(spark):
    spaces = spark.createDataFrame([(1, "A", "Separation", 1.0, [0.0], [1.0], "/DeviceGray"), (1, "P", "Pattern", None, None, None, "/Lab"),
                                    (2, "A", "Separation", 2.0, [0.0], [0.5], "/DeviceGray")],
                                   "doc_id bigint, name string, type string, fn_n double, c0 array<double>, c1 array<double>, alt string")
    rows = [(i, 3, 1, 1, 1, True, False, 3, bytearray([0, 128, 255]), doc, space)
            for i, (doc, space) in enumerate([(1, "A"), (2, "A"), (1, None), (1, "P"), (3, "A")])]
    got = jobs.gray_images(spark.createDataFrame(rows, RASTERS + ", doc_id bigint, space string"), colorspaces=spaces).collect()
    shown = {r.image_id: r.error or _unpacked(bytes(r.gray), 3)[0] for r in got}
    assert shown == {0: [0, 128, 255], 1: [0, 32, 128], 2: [0, 128, 255], 3: "tint_unsupported", 4: "tint_unsupported"}


def test_row_filters_stay_in_their_rows(spark, sf_dir):
    """No window, no exchange: H5 and the differences of plain images are taken inside row arrays."""
    from pagetone.sources import derived as D

    tiles = raster.unpack_tiles(D.rasters(spark, sf_dir))
    for df in (raster.delta_decode(tiles), raster.delta_encode(raster.gray_tiles(raster.delta_decode(tiles)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_long_rows_sum_right(spark):
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, (2, 3000, 3))
    body = raw.astype(np.uint8).tobytes()
    rows = [(1, 3000, 2, 3, 2, True, False, len(body), bytearray(body))]
    got = raster.tile_rows(raster.delta_decode(raster.unpack_tiles(spark.createDataFrame(rows, RASTERS)))).collect()
    for r in got:
        assert r.v == (np.cumsum(raw[r.y], axis=0) % 256).ravel().tolist()


def test_padding_and_unsupported_filters(spark):
    schema = ("image_id bigint, w int, h int, channels int, predictor int, is_raw boolean, is_cut boolean, "
              "decoded_len bigint, bytes binary")
    rows = [(1, 2, 2, 3, 1, True, False, 11, bytearray(range(11))), (2, 1, 1, 3, 15, True, False, 4, bytearray([4, 1, 2, 3])),
            (3, 2, 2, 3, 1, False, False, 11, bytearray(11)), (4, 2, 1, 3, 15, False, True, 3, bytearray([1, 5, 6]))]
    rasters = spark.createDataFrame(rows, schema)
    assert {r.image_id: r.status for r in raster.raster_status(rasters).collect()} == {
        1: "padded", 2: "ok", 3: "length_fail", 4: "padded"}
    pixels = {(r.image_id, r.y, r.x): [r.c1, r.c2, r.c3] for r in raster.tile_pixels(raster.decode_tiles(raster.unpack_tiles(rasters))).collect()}
    failed = raster.row_delta_decode(rasters).filter("error IS NOT NULL").collect()
    assert [(r.image_id, r.error, r.v) for r in failed] == [(2, "predictor_fail", None)]
    assert pixels[(1, 1, 1)] == [9, 10, 255]
    assert pixels[(4, 0, 0)] == [5, 6, 0] and pixels[(4, 0, 1)] == [5, 6, 0]
    assert not any(k[0] in (2, 3) for k in pixels)


def test_every_raster_answers(spark):
    schema = ("image_id bigint, w int, h int, channels int, predictor int, is_raw boolean, is_cut boolean, "
              "decoded_len bigint, bytes binary")
    rows = [(1, 2, 2, 3, 1, True, False, 12, bytearray([9] * 12)), (2, 1, 1, 3, 15, True, False, 4, bytearray([4, 1, 2, 3])),
            (3, 2, 2, 3, 1, False, False, 11, bytearray(11)), (4, 2, 1, 2, 1, True, False, 4, bytearray(4)),
            (5, 1, 1, 3, 1, False, False, None, None), (6, 0, 2, 3, 1, True, False, 0, bytearray()),
            (7, 2, 0, 3, 15, True, False, 0, bytearray()), (8, 1, 1, 4, 15, True, False, 5, bytearray([3, 1, 2, 3, 4])), (9, 2, 1, 1, 1, True, False, 2, bytearray([7, 7]))]
    found = raster.gray_histogram(jobs.gray_rasters(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.image_id, r.gray, r.error, r.n) for r in found) == [
        (1, 9, None, 4), (2, None, "predictor_fail", 0), (3, None, "length_fail", 0), (4, None, "channels_unsupported", 0),
        (5, None, "inflate_fail", 0), (6, None, "no_pixels", 0), (7, None, "no_pixels", 0), (8, None, "predictor_fail", 0), (9, 7, None, 2)]


def test_page_on_the_limit_is_gray(spark):
    px = spark.range(2_000_000).select(
        F.lit(1).alias("doc_id"), F.when(F.col("id") < 1_000_000, 1).otherwise(2).alias("page_no"),
        F.when(F.col("id").isin(5, 1_000_001, 1_000_002), 9).otherwise(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    assert {r.page_no: r.is_gray for r in pages.page_class(px).collect()} == {1: True, 2: False}


def test_page_edits(spark):
    base = spark.createDataFrame([(1, p) for p in (1, 2, 3)], "doc_id bigint, page_no int")
    edits = spark.createDataFrame(
        [(1, 1, 1, "delete", 0, None), (1, 2, 1, "undo", 0, None), (1, 3, 2, "delete", 0, None),
         (1, 4, 3, "rotate", -90, None), (1, 5, 3, "move", 0, 9.0), (1, 6, 3, "move", 0, 0.5), (1, 7, 1, "insert", 0, 1.5)],
        "doc_id bigint, seq bigint, page_no int, action string, degrees int, order_key double")
    rows = pages.fold_page_edits(base, edits).orderBy("order_key", "page_no", "blank_seq").collect()
    assert [(r.page_no, r.blank_seq, r.rotation) for r in rows] == [(3, None, 270), (1, None, 0), (None, 7, 0)]


def test_pixels_are_taken_by_places(spark):
    """Pixels come from a sequence of places, so that their samples are read in compiled code and not inside a lambda."""
    rows = [(1, 2, 2, 3, 1, True, False, 12, bytearray(range(12))), (2, 1, 1, 4, 1, True, False, 3, bytearray([1, 2, 3]))]
    rasters = spark.createDataFrame(rows, RASTERS)
    expected = {(1, 0, 0, 0, 1, 2, None), (1, 0, 1, 3, 4, 5, None), (1, 1, 0, 6, 7, 8, None), (1, 1, 1, 9, 10, 11, None), (2, 0, 0, 1, 2, 3, 0)}
    for df in (raster.unpack_pixels(rasters), raster.tile_pixels(raster.unpack_tiles(rasters))):
        assert {(r.image_id, r.y, r.x, r.c1, r.c2, r.c3, r.c4) for r in df.collect()} == expected
        assert "struct(x, " not in df._jdf.queryExecution().optimizedPlan().toString()
