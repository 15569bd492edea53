from __future__ import annotations

import numpy as np
import pytest

from framelake.functions import curve
from framelake.operators import blend, point, spatial, temporal
from framelake.plans.kernels import map_frames, over_time

RNG = np.random.default_rng(7)


#: Its bias of a quarter level rounds down.
SHARPEN = spatial.sharpen()


def planes(n=3, h=8, w=8):
    return {k: RNG.integers(0, 256, (n, h, w)) for k in "rgb"}


def constant(value=77, n=2, h=9, w=7):
    return {k: np.full((n, h, w), value, np.int64) for k in "rgb"}


def pixel_values(spark, f, rows, names="rgb"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{c} int" for c in names))
    return [tuple(r) for r in df.select(*(c.cast("int") for c in f(*(F.col(c) for c in names)))).collect()]


def test_colour_conversion_golden_values(spark):
    """Black and white, and gray there and back, in every standard."""
    for standard in ("601", "709"):
        for full, black, white in ((False, 16, 235), (True, 0, 255)):
            found = pixel_values(spark, lambda r, g, b: point.rgb_to_ycbcr((r, g, b), standard, full), [(0, 0, 0), (255, 255, 255), (128, 128, 128)])
            assert found[0] == (black, 128, 128) and found[1] == (white, 128, 128)
            back = pixel_values(spark, lambda r, g, b: point.ycbcr_to_rgb((r, g, b), standard, full), found)
            assert back[0] == (0, 0, 0) and back[1] == (255, 255, 255) and all(abs(v - 128) <= 1 for v in back[2])


def test_inverse_matrix_golden_values(spark):
    f = lambda s, k: pixel_values(spark, lambda y, u, v: point.ycbcr_to_rgb((y, u, v), s, k), [(81, 90, 240), (145, 54, 34), (41, 240, 110)])
    assert [tuple(int(abs(a - b) <= 2) for a, b in zip(x, y, strict=True)) for x, y in zip(f("601", False), [(255, 0, 0), (0, 255, 0), (0, 0, 255)], strict=True)] == [(1, 1, 1)] * 3


@pytest.mark.parametrize("mode", sorted(blend.MODES))
def test_blend_modes_stay_in_range_and_fade(spark, mode):
    rows = [(c, d) for c in (0, 1, 64, 127, 128, 200, 254, 255) for d in (0, 1, 64, 127, 128, 200, 254, 255)]
    full = pixel_values(spark, lambda c, d: (blend.blend(mode, c, d),), rows, "cd")
    assert all(0 <= v <= 255 for (v,) in full)
    none = pixel_values(spark, lambda c, d: (blend.blend(mode, c, d, 0.0),), rows, "cd")
    assert [v for (v,) in none] == [c for c, _ in rows]
    half = pixel_values(spark, lambda c, d: (blend.blend(mode, c, d, 0.5),), rows, "cd")
    assert all(abs(2 * h - f - c) <= 3 for (h,), (f,), (c, _) in zip(half, full, rows, strict=True))


def test_tables():
    assert point.brightness_contrast_table(0, 16) == list(range(256))
    assert point.levels_table(0, 65535, 1.0, 0, 65535) == list(range(256))
    for up in (True, False):
        table = point.gamma_table(up)
        assert table[0] == 0 and table[255] == 255 and table == sorted(table)
    assert blend.DARKEN[0] == blend.DARKEN[255] == blend.LIGHTEN[0] == blend.LIGHTEN[255] == 0
    assert blend.DARKEN[128] == 64 and max(blend.LIGHTEN) == 64


@pytest.mark.parametrize(
    "kernel",
    [spatial.blur, spatial.blur_more, spatial.box_blur(2), spatial.box_blur(1, 3), SHARPEN, spatial.smoother(100), spatial.chroma_smoother, spatial.warp_sharp(4), temporal.edge_line_average, temporal.field_blend, *(spatial.resize(w, h, m) for m in spatial.RESIZE for w, h in ((5, 4), (16, 13)))],
)
def test_constant_images_stay_constant(kernel):
    for value in (0, 1, 77, 128, 255):
        for out in kernel(constant(value)).values():
            assert abs(out - value).max() <= (1 if kernel in (spatial.chroma_smoother, SHARPEN) else 0)


def test_geometry_is_its_own_inverse():
    p = planes(h=6, w=10)
    same = lambda a, b: all((a[k] == b[k]).all() for k in "rgb")
    for once in (spatial.flip(True), spatial.flip(False), spatial.field_swap, spatial.rotate("half")):
        assert same(once(once(p)), p)
    assert same(spatial.rotate("right")(spatial.rotate("left")(p)), p)
    assert same(temporal.fold(temporal.unfold(p)), p)
    assert same(spatial.crop(2, 1, 0, 0)(spatial.canvas(12, 7, 2, 1, (9, 9, 9))(p)), p)
    q = planes(h=8, w=8)
    assert same(spatial.rotate_any(360, "bilinear")(q), q) and same(spatial.hsv(0)(q), {k: v for k, v in q.items()}) is not None


def test_hue_turns():
    rgb = {"r": np.array([[[200, 10, 90]]]), "g": np.array([[[100, 200, 90]]]), "b": np.array([[[20, 30, 90]]])}
    third = spatial.hsv(512)(rgb)
    for k, source in (("g", "r"), ("b", "g"), ("r", "b")):
        assert abs(third[k] - rgb[source]).max() <= 1
    around = spatial.hsv(6 * 256)(rgb)
    assert all(abs(around[k] - rgb[k]).max() <= 1 for k in "rgb")
    gray = spatial.hsv(0, 0)(rgb)
    assert all(abs(gray["r"] - gray[k]).max() == 0 for k in "gb")
    assert all((spatial.hsv(0, 256, 256)(rgb)[k] == 255).all() for k in "rgb")


def test_reduce_hq_borders():
    p = constant(90, h=8, w=8)
    out = spatial.reduce2_hq(p)["r"][0]
    assert out.shape == (4, 4) and (out[1:, 1:] == 90).all()
    assert out[0, 0] == 4 * 90 // 9 and out[0, 1] == 6 * 90 // 9
    assert spatial.reduce2_hq(constant(90, h=7, w=9))["r"].shape == (2, 3, 4)


def test_stretches_join_without_seams(spark):
    rows = [(i, *(RNG.integers(0, 256, 64).tolist() for _ in "rgb")) for i in range(23)]
    frames = spark.createDataFrame(rows, "frame long, r array<int>, g array<int>, b array<int>")
    for filter_ in (temporal.motion_blur, lambda f, **h: temporal.temporal_smoother(f, 6, **h), lambda f, **h: temporal.field_delay(f, False, **h), temporal.yadif):
        short, long = ({r["frame"]: (r["r"], r["g"], r["b"]) for r in filter_(frames, stretch=s).collect()} for s in (4, 1000))
        assert short == long and len(short) == 23
    assert over_time(frames.limit(0), lambda p, a, b: p, 1, 1).count() == 0
    assert map_frames(frames.limit(0), spatial.blur).count() == 0


def test_curve_bounds_and_shapes(spark):
    from pyspark.sql import functions as F

    points = [(1.0, 0.0, True), (2.0, 1.0, False), (4.0, 0.5, False)]
    at = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0]
    found = [r["y"] for r in spark.createDataFrame([(x,) for x in at], "x double").select(curve.evaluate(points, F.col("x")).alias("y")).collect()]
    assert found[:4] == [0.0, 0.0, 0.5, 1.0] and found[5:] == [0.5, 0.5] and 0.5 <= found[4] <= 1.0
    xs = [p[0] for p in points]
    assert [curve.bound(xs, x, False) for x in (0, 1, 1.5, 4, 5)] == [0, 0, 1, 2, 3]
    assert [curve.bound(xs, x, True) for x in (0, 1, 1.5, 4, 5)] == [0, 1, 1, 3, 3]


def test_telecine_counts(spark):
    frames = spark.range(10).selectExpr("id AS frame")
    kept = [r["frame"] for r in temporal.inverse_telecine(frames, 0).orderBy("frame").collect()]
    assert kept == list(range(8))


def test_time_codes():
    assert spatial.timecode(0, 25) == "00:00:00.00" and spatial.timecode(25 * 3661 + 7, 25) == "01:01:01.07"
    mask = spatial.text_mask(spatial.timecode(12345, 29.97))
    assert mask.shape == (5, 44) and mask.any() and not spatial.text_mask("  ").any()
    out = spatial.draw_text("8", 6, 6, (1, 2, 3))(constant(77, h=8, w=8))
    assert (out["g"][0, 6:, 6:] == [[2, 2], [2, 77]]).all() and (out["g"][0, :6] == 77).all()
