"""Queries of the video filters, on 8x8 frames made of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.catalog import register
from framelake.operators import blend, point, spatial, temporal
from framelake.plans import chain
from framelake.plans.kernels import map_frames
from framelake.sources.tables import SQL_PIXELS, frames, pixels
from framelake.suites import twins



def _rgb() -> point.RGB:
    return F.col("r"), F.col("g"), F.col("b")


def _point(name: str, f, sql: str) -> None:
    """A point filter; sql: its three channels over r, g, b (x and y), or one that stands for all as {c}."""
    def run(spark, sf_dir: str) -> DataFrame:
        out = f(_rgb())
        return pixels(frames(spark, sf_dir)).select("frame", "x", "y", *(c.cast("int").alias(n) for c, n in zip(out, "rgb", strict=True)))

    parts = [sql.replace("{c}", c) for c in "rgb"] if "{c}" in sql else sql.split(" ;; ") if " ;; " in sql else [sql] * 3
    register(name, run, f"WITH {SQL_PIXELS} SELECT frame, x, y, {', '.join(f'CAST({p} AS INT) AS {n}' for p, n in zip(parts, 'rgb', strict=True))} FROM px")


def clamp(v: str) -> str:
    return f"greatest(0, least(255, {v}))"


GRAY = "(19 * b + 183 * g + 54 * r)"
_point("f_invert", point.invert, "255 - {c}")
_point("f_grayscale", point.grayscale, f"{GRAY} >> 8")
_point("f_threshold", lambda c: point.threshold(c, 100), f"CASE WHEN {GRAY} >= 100 * 256 THEN 255 ELSE 0 END")
_point("f_brightness_contrast", lambda c: point.brightness_contrast(c, 20, 24), clamp("(CAST((20 - 0.5) * 65536 AS BIGINT) + 32768 + {c} * 98304) >> 16"))
_point("f_brightness_identity", lambda c: point.brightness_contrast(c, 0, 16), "{c}")
_point("f_gamma_to_linear", lambda c: point.gamma_correct(c, True), "floor(255 * CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END + 0.5)")
_point("f_gamma_to_srgb", lambda c: point.gamma_correct(c, False), "floor(255 * CASE WHEN {c} / 255.0 <= 0.0031808 THEN {c} / 255.0 * 12.92 ELSE 1.055 * pow({c} / 255.0, 1 / 2.4) - 0.055 END + 0.5)")
_LEVELS = "CASE WHEN {v} * 257 < 8192 THEN 0 WHEN {v} * 257 > 57344 THEN 255 ELSE CAST(floor(65535 * pow(({v} * 257 - 8192) / 49152.0, 1 / 1.4) + 0.5) AS BIGINT) >> 8 END"
_point("f_levels", lambda c: point.levels(c, 8192, 57344, 1.4, 0, 65535), _LEVELS.replace("{v}", "{c}"))
_Y16 = "((19595 * r + 38470 * g + 7471 * b + 32768) >> 16)"
_point("f_levels_luma", lambda c: point.levels(c, 8192, 57344, 1.4, 0, 65535, True), clamp("{c} + " + _LEVELS.replace("{v}", _Y16) + f" - {_Y16}"))
_point("f_curves", lambda c: point.per_channel(c, lambda v: point.lookup([min(255, i * i // 255 + 10) for i in range(256)], v)), "least(255, {c} * {c} // 255 + 10)")
_point("f_fill", lambda c: point.fill(c, F.col("x"), F.col("y"), (1, 2, 1, 1), (8, 8), (10, 20, 30)), " ;; ".join(f"CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 6 THEN {k} ELSE {c} END" for c, k in zip("rgb", (10, 20, 30), strict=True)))
_point("f_fill_outside", lambda c: point.fill(c, F.col("x"), F.col("y"), (2, 2, 2, 2), (8, 8), (1, 2, 3), True), " ;; ".join(f"CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN {c} ELSE {k} END" for c, k in zip("rgb", (1, 2, 3), strict=True)))
for _mode, _sql in (("y", "(77 * r + 150 * g + 29 * b + 128) >> 8"), ("i", clamp("((153 * r - 70 * g - 82 * b + 128) >> 8) + 128")), ("q", clamp("((54 * r - 134 * g + 80 * b + 128) >> 8) + 128"))):
    _point(f"f_tv_{_mode}", lambda c, m=_mode: point.tv(c, m), _sql)
#: Fixed values of the forward matrices: (y, cb, cr rows, offset of y).
_FORWARD = {
    ("601", False): ((16829, 33039, 6416), (-9714, -19071, 28784), (28784, -24103, -4681), 0x108000),
    ("601", True): ((19595, 38470, 7471), (-11058, -21710, 32768), (32768, -27439, -5329), 0x8000),
    ("709", False): ((11966, 40254, 4064), (-6596, -22189, 28784), (28784, -26145, -2639), 0x108000),
    ("709", True): ((13933, 46871, 4732), (-7509, -25259, 32768), (32768, -29763, -3005), 0x8000),
}
for (_std, _full), (*_rows, _off) in _FORWARD.items():
    _n = f"{_std}_{'full' if _full else 'limited'}"
    _sqls = [clamp(f"({r} * r + {g} * g + {b} * b + {o}) >> 16") for (r, g, b), o in zip(_rows, (_off, 0x808000, 0x808000), strict=True)]
    _point(f"f_rgb_to_ycbcr_{_n}", lambda c, s=_std, k=_full: point.rgb_to_ycbcr(c, s, k), " ;; ".join(_sqls))
    _ky, _rv, _gv, _gu, _bu = point.INVERSE[_std, _full]
    _base = f"{_ky} * (r - {0 if _full else 16}) + 32768"
    _point(f"f_ycbcr_to_rgb_{_n}", lambda c, s=_std, k=_full: point.ycbcr_to_rgb(c, s, k), " ;; ".join(clamp(f"({_base} + {v}) >> 16") for v in (f"{_rv} * (b - 128)", f"({_gv}) * (b - 128) + ({_gu}) * (g - 128)", f"{_bu} * (g - 128)")))


# --- blending --------------------------------------------------------------

_M = "(({p}) + 128 + ((({p}) + 128) >> 8)) >> 8"


def _scaled(p: str) -> str:
    return f"({_M.replace('{p}', p)})"


_DARK, _LIGHT = "floor(255.0 * (c / 255.0) * (1 - c / 255.0) + 0.5)", "floor(255.0 * CASE WHEN c / 255.0 <= 0.25 THEN ((16 * (c / 255.0) - 12) * (c / 255.0) + 4) * (c / 255.0) - c / 255.0 ELSE sqrt(c / 255.0) - c / 255.0 END + 0.5)"
_BLEND_SQL = {
    "min": "least(c, d)",
    "max": "greatest(c, d)",
    "add": "least(255, c + d)",
    "multiply": _scaled("c * d"),
    "linear_burn": "greatest(0, c + d - 255)",
    "color_burn": "CASE WHEN d = 0 THEN 0 ELSE greatest(0, 255 - (255 * (255 - c) + (d >> 1)) // d) END",
    "screen": f"c + d - {_scaled('c * d')}",
    "color_dodge": "CASE WHEN d = 255 THEN CASE WHEN c > 0 THEN 255 ELSE 0 END ELSE least(255, (255 * c + ((255 - d) >> 1)) // (255 - d)) END",
    "overlay": f"CASE WHEN c < 128 THEN {_scaled('c * d * 2')} ELSE greatest(0, 2 * (c + d - {_scaled('c * d')}) - 255) END",
    "soft_light": f"CASE WHEN d < 128 THEN greatest(0, c - {_scaled(f'(255 - 2 * d) * CAST({_DARK} AS INT)')}) ELSE least(255, c + {_scaled(f'(2 * d - 255) * CAST({_LIGHT} AS INT)')}) END",
    "hard_light": f"CASE WHEN d < 128 THEN {_scaled('c * d * 2')} ELSE 2 * (c + d) - {_scaled('c * d * 2')} - 255 END",
    "vivid_light": "CASE WHEN d = 0 THEN 0 WHEN d = 255 THEN 255 WHEN d < 128 THEN greatest(0, 255 - ((255 - c) * 255 + d) // (2 * d)) ELSE least(255, (c * 255 + 255 - d) // (2 * (255 - d))) END",
    "linear_light": clamp("c + 2 * d - 255"),
    "pin_light": "CASE WHEN d < 128 THEN least(c, 2 * d) ELSE greatest(c, 2 * d - 255) END",
    "hard_mix": "CASE WHEN c + d > 255 THEN 255 ELSE 0 END",
    "difference": "abs(c - d)",
    "exclusion": _scaled("255 * c + 255 * d - 2 * c * d"),
}
_LAYERS = f"WITH {SQL_PIXELS}, layers AS (SELECT a.frame, a.x, a.y, a.r AS r_c, a.g AS g_c, a.b AS b_c, b.r AS r_d, b.g AS g_d, b.b AS b_d FROM px a JOIN px b ON b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y)"


def _layer_sql(expression: str) -> str:
    channels = (f"(SELECT CAST({expression} AS INT) FROM (SELECT {k}_c AS c, {k}_d AS d))" for k in "rgb")
    return f"{_LAYERS} SELECT frame, x, y, {', '.join(f'{s} AS {k}' for s, k in zip(channels, 'rgb', strict=True))} FROM layers"


def _two(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir)
    return pixels(f), pixels(f.withColumn("frame", F.col("frame") - 1))


for _mode, _sql in _BLEND_SQL.items():
    register(f"blend_{_mode}", lambda s, d, m=_mode: blend.blend_layers(*_two(s, d), m), _layer_sql(_sql))
register("blend_lerp", lambda s, d: blend.blend_layers(*_two(s, d), "lerp", 0.4), _layer_sql(_scaled("255 * c + (d - c) * 102")))
register("blend_multiply_half", lambda s, d: blend.blend_layers(*_two(s, d), "multiply", 0.5), _layer_sql(_scaled(f"255 * {_BLEND_SQL['multiply']} + (c - {_BLEND_SQL['multiply']}) * 127")))


def _merge(mode: str):
    def run(spark, sf_dir: str) -> DataFrame:
        f = frames(spark, sf_dir)
        return blend.merge_layers(pixels(f), pixels(f.withColumn("frame", F.col("frame") - 1)), pixels(f.withColumn("frame", F.col("frame") - 2)), mode)

    return run


_THREE = f"WITH {SQL_PIXELS} SELECT a.frame, a.x, a.y, {{}} FROM px a JOIN px b ON b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y JOIN px m ON m.frame = a.frame + 2 AND m.x = a.x AND m.y = a.y"
register("merge_select", _merge("select"), _THREE.format(", ".join(f"CASE WHEN m.r >= 128 THEN b.{c} ELSE a.{c} END AS {c}" for c in "rgb")))
register("merge_lerp", _merge("lerp"), _THREE.format(", ".join(f"CAST(a.{c} + {_scaled(f'(b.{c} - a.{c}) * m.r')} AS INT) AS {c}" for c in "rgb")))
register(
    "logo_overlay",
    lambda s, d: blend.overlay_image(pixels(frames(s, d)), pixels(frames(s, d).where("frame = 7")).where("x < 3 AND y < 3"), 0.6, (4, 2)),
    f"WITH {SQL_PIXELS}, logo AS (SELECT x + 4 AS x, y + 2 AS y, r, g, b FROM px WHERE frame = 7 AND x < 3 AND y < 3) SELECT p.frame, p.x, p.y, "
    + ", ".join(f"CAST(CASE WHEN l.r IS NULL THEN p.{c} ELSE {_scaled(f'255 * p.{c} + (l.{c} - p.{c}) * 153')} END AS INT) AS {c}" for c in "rgb")
    + " FROM px p LEFT JOIN logo l USING (x, y)",
)

# --- neighbourhoods --------------------------------------------------------


def _spatial(name: str, kernel, sql: str | None, width: int = 8) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return pixels(map_frames(frames(spark, sf_dir), kernel), width)

    register(name, run, sql)


def _near(dx: int, dy: int, c: str) -> str:
    """A neighbour's channel by windows; edges replicate."""
    return f"n{dx + 2}_{dy + 2}_{c}"


def _grid(expression, reach: int = 1, channels: str = "rgb", source: str = "px") -> str:
    """SQL that joins each pixel with its neighbourhood; expression(c) uses _near names."""
    places = [(dx, dy) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    sums = ", ".join(f"max(CASE WHEN o.dx = {dx} AND o.dy = {dy} THEN q.{c} END) AS {_near(dx, dy, c)}" for dx, dy in places for c in channels)
    return (
        f"WITH {SQL_PIXELS}, o AS (SELECT dx, dy FROM range(-{reach}, {reach + 1}) a(dx), range(-{reach}, {reach + 1}) b(dy)), near AS ("
        f"SELECT p.frame, p.x, p.y, {sums} FROM {source} p CROSS JOIN o JOIN {source} q ON q.frame = p.frame AND q.x = greatest(0, least(7, p.x + o.dx)) AND q.y = greatest(0, least(7, p.y + o.dy)) GROUP BY 1, 2, 3"
        f") SELECT frame, x, y, {', '.join(f'CAST({expression(c)} AS INT) AS {c}' for c in channels)} FROM near"
    )


def _conv(weights: list[int], bias: int):
    return lambda c: clamp("(" + " + ".join(f"({k}) * {_near(i % 3 - 1, i // 3 - 1, c)}" for i, k in enumerate(weights) if k) + f" + ({bias})) >> 8")


_K = [-10, 20, -30, 40, 216, 40, -30, 20, -10]
_spatial("f_convolution", spatial.convolution(_K, 12), _grid(_conv(_K, 12)))
_spatial("f_sharpen", spatial.sharpen(16), _grid(_conv([-16] * 4 + [384] + [-16] * 4, -64)))
_spatial("f_emboss", spatial.emboss(0, 16), _grid(_conv([0, 0, 0, 16, 0, -16, 0, 0, 0], 32896)))
_spatial("f_emboss_rounded", spatial.emboss(2, 16, True), _grid(_conv([-8, -16, -8, 0, 0, 0, 8, 16, 8], 32896)))


def _separable(taps: list[int], shift: int) -> str:
    """Along rows, then columns, each by window sums over replicated edges."""
    r = len(taps) // 2
    lag = lambda c, d, part, order, last: f"coalesce({'lead' if d > 0 else 'lag'}({c}, {abs(d)}) OVER {order}, {'last' if d > 0 else 'first'}_value({c}) OVER (PARTITION BY {part} ORDER BY {last} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    line = lambda c, part, by: "(" + " + ".join(f"{k} * {lag(c, i - r, part, f'(PARTITION BY {part} ORDER BY {by})', by)}" for i, k in enumerate(taps)) + f" + {1 << shift >> 1}) >> {shift}"
    rows = ", ".join(f"({line(c, 'frame, y', 'x')}) AS {c}" for c in "rgb")
    cols = ", ".join(f"CAST(({line(c, 'frame, x', 'y')}) AS INT) AS {c}" for c in "rgb")
    return f"WITH {SQL_PIXELS}, h AS (SELECT frame, x, y, {rows} FROM px) SELECT frame, x, y, {cols} FROM h"


_spatial("f_blur", spatial.blur, _separable([1, 2, 1], 2))
_spatial("f_blur_more", spatial.blur_more, _separable([1, 4, 6, 4, 1], 4))


def _box_sql() -> str:
    side = lambda by, part: ", ".join(f"(list_sum(list_transform(range(-2, 3), lambda d: l_{c}[greatest(1, least(8, {by} + 1 + d))])) * 13108)::BIGINT >> 16 AS {c}" for c in "rgb")
    lists = ", ".join(f"list({c} ORDER BY x) AS l_{c}" for c in "rgb")
    columns = lists.replace("ORDER BY x", "ORDER BY y")
    return (
        f"WITH {SQL_PIXELS}, hl AS (SELECT frame, y, {lists} FROM px GROUP BY frame, y), h AS (SELECT frame, y, x, {side('x', 'y')} FROM hl, range(0, 8) t(x)), "
        f"vl AS (SELECT frame, x, {columns} FROM h GROUP BY frame, x), v AS (SELECT frame, x, y, {side('y', 'x')} FROM vl, range(0, 8) t(y)) "
        "SELECT frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM v"
    )


_spatial("f_box_blur", spatial.box_blur(2), _box_sql())


def _cubic_sql() -> str:
    """Three passes of a box of three along rows, then three along columns."""
    steps, before = [], "px"
    for i, (by, part) in enumerate((("x", "frame, y"),) * 3 + (("y", "frame, x"),) * 3):
        w = f"(PARTITION BY {part} ORDER BY {by})"
        sums = ", ".join(f"((coalesce(lag({c}) OVER {w}, {c}) + {c} + coalesce(lead({c}) OVER {w}, {c})) * 21846) >> 16 AS {c}" for c in "rgb")
        steps.append(f"s{i} AS (SELECT frame, x, y, {sums} FROM {before})")
        before = f"s{i}"
    return f"WITH {SQL_PIXELS}, {', '.join(steps)} SELECT frame, x, y, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM s5"


def _edges(dx: int, dy: int) -> str:
    return "(" + " + ".join(f"abs({_near(dx, dy, c)} - {_near(-dx, -dy, c)})" for c in "rgb") + ")"


def _smoother_sql(threshold: int) -> str:
    weights = (1, 2, 1, 2, 4, 2, 1, 2, 1)
    mean = lambda c: "((" + " + ".join(f"{k} * {_near(i % 3 - 1, i // 3 - 1, c)}" for i, k in enumerate(weights)) + " + 8) >> 4)"
    grid = _grid(lambda c: mean(c))
    head, _, _ = grid.rpartition(" SELECT frame, x, y")
    edge = f"CASE WHEN {_edges(1, 0)} * {_edges(1, 0)} + {_edges(0, 1)} * {_edges(0, 1)} > {threshold} THEN 1 ELSE 0 END"
    kept = ", ".join(f"CAST(CASE WHEN m.e > 0 THEN m.{c} ELSE m.s_{c} END AS INT) AS {c}" for c in "rgb")
    means = ", ".join(f"{mean(c)} AS s_{c}, {_near(0, 0, c)} AS {c}" for c in "rgb")
    return (
        f"{head}, one AS (SELECT frame, x, y, {edge} AS edge, {means} FROM near), "
        "m AS (SELECT p.*, (SELECT max(q.edge) FROM one q WHERE q.frame = p.frame AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1) AS e FROM one p) "
        f"SELECT m.frame, m.x, m.y, {kept} FROM m"
    )


_SOFT = lambda c: f"({_near(-1, 0, c)} + 2 * {_near(0, 0, c)} + {_near(1, 0, c)})"
_DELTA = "((4 * (" + " + ".join(f"{k} * {_near(0, 0, c)}" for k, c in zip((54, 183, 19), "rgb", strict=True)) + ") - (" + " + ".join(f"{k} * {_SOFT(c)}" for k, c in zip((54, 183, 19), "rgb", strict=True)) + ") + 512) >> 10)"
_spatial("f_box_blur_cubic", spatial.box_blur(1, 3), _cubic_sql())
_spatial("f_smoother", spatial.smoother(40_000), _smoother_sql(40_000))
_spatial("f_chroma_smoother", spatial.chroma_smoother, _grid(lambda c: clamp(f"(({_SOFT(c)} + 2) >> 2) + {_DELTA}")))
_spatial("f_warp_sharp", spatial.warp_sharp(3), twins.warped(3, f"{SQL_PIXELS}, pic AS (SELECT * FROM px)"))
_spatial("f_reduce2", spatial.reduce2, f"WITH {SQL_PIXELS} SELECT frame, x // 2 AS x, y // 2 AS y, {', '.join(f'CAST((sum({c}) + 2)::BIGINT >> 2 AS INT) AS {c}' for c in 'rgb')} FROM px GROUP BY 1, 2, 3", 4)
_HQ = lambda c: (
    "CASE WHEN x = 0 OR y = 0 THEN ("
    + " + ".join(f"CASE WHEN x + ({dx}) BETWEEN 0 AND 7 AND y + ({dy}) BETWEEN 0 AND 7 THEN {_near(dx, dy, c)} ELSE 0 END" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
    + ") // 9 ELSE ("
    + " + ".join(f"{k} * {_near(i % 3 - 1, i // 3 - 1, c)}" for i, k in enumerate((1, 2, 1, 2, 4, 2, 1, 2, 1)))
    + " + 8) >> 4 END"
)
_spatial("f_reduce2_hq", spatial.reduce2_hq, f"SELECT frame, x // 2 AS x, y // 2 AS y, r, g, b FROM ({_grid(_HQ)}) WHERE x % 2 = 0 AND y % 2 = 0", 4)
_spatial("f_flip_horizontal", spatial.flip(True), f"WITH {SQL_PIXELS} SELECT frame, 7 - x AS x, y, r, g, b FROM px")
_spatial("f_flip_vertical", spatial.flip(False), f"WITH {SQL_PIXELS} SELECT frame, x, 7 - y AS y, r, g, b FROM px")
_spatial("f_rotate_left", spatial.rotate("left"), f"WITH {SQL_PIXELS} SELECT frame, y AS x, 7 - x AS y, r, g, b FROM px")
_spatial("f_rotate_right", spatial.rotate("right"), f"WITH {SQL_PIXELS} SELECT frame, 7 - y AS x, x AS y, r, g, b FROM px")
_spatial("f_rotate_half", spatial.rotate("half"), f"WITH {SQL_PIXELS} SELECT frame, 7 - x AS x, 7 - y AS y, r, g, b FROM px")
_spatial("f_rotate_any", spatial.rotate_any(30, "bicubic", (1, 2, 3)), twins.rotated(30, (1, 2, 3)))
_spatial("f_rotate_any_right_angle", spatial.rotate_any(90, "point"), f"WITH {SQL_PIXELS} SELECT frame, y AS x, 7 - x AS y, r, g, b FROM px")
_spatial("f_perspective_identity", spatial.perspective([(-0.5, -0.5), (7.5, -0.5), (-0.5, 7.5), (7.5, 7.5)], 8, 8), f"WITH {SQL_PIXELS} SELECT frame, x, y, r, g, b FROM px")
_spatial("f_perspective", spatial.perspective([(0, 0), (7, 1), (1, 7), (6, 6)], 8, 8), twins.in_perspective([(0, 0), (7, 1), (1, 7), (6, 6)]))
_spatial("f_field_swap", spatial.field_swap, f"WITH {SQL_PIXELS} SELECT frame, x, xor(y, 1) AS y, r, g, b FROM px")
_spatial("f_crop", spatial.crop(1, 2, 3, 1), f"WITH {SQL_PIXELS} SELECT frame, x - 1 AS x, y - 2 AS y, r, g, b FROM px WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6", 4)
_spatial(
    "f_canvas",
    spatial.canvas(10, 9, 1, 1, (5, 6, 7)),
    f"WITH {SQL_PIXELS}, grid AS (SELECT DISTINCT frame, CAST(gx AS INT) AS x, CAST(gy AS INT) AS y FROM px, range(0, 10) a(gx), range(0, 9) b(gy)) SELECT g.frame, g.x, g.y, coalesce(p.r, 5) AS r, coalesce(p.g, 6) AS g, coalesce(p.b, 7) AS b FROM grid g LEFT JOIN px p ON p.frame = g.frame AND p.x = g.x - 1 AND p.y = g.y - 1",
    10,
)


def _resize_sql(kernel: str, reach: float, widens: bool, width: int = 12, height: int = 6) -> str:
    """Separable resampling: weights in 1/16384 from the kernel of t, the largest taking what rounding left."""
    def weights(source: int, target: int) -> str:
        scale = max(1.0, source / target) if widens else 1.0
        span = int(-(-reach * scale // 1)) + 1
        at = f"floor(((o + 0.5) * {source} / {target} - 0.5) * 256 + 0.5) / 256"
        return (
            f"SELECT o, greatest(0, least({source - 1}, CAST(i AS INT))) AS i, sum(f + CASE WHEN k = 1 THEN 16384 - total ELSE 0 END)::BIGINT AS w FROM ("
            "SELECT *, sum(f) OVER (PARTITION BY o) AS total, row_number() OVER (PARTITION BY o ORDER BY f DESC, i) AS k FROM ("
            "SELECT o, i, floor(v / sum(v) OVER (PARTITION BY o) * 16384 + 0.5)::BIGINT AS f FROM ("
            f"SELECT o, i, CAST({kernel} AS DOUBLE) AS v FROM (SELECT o, i, abs((i - a) / {scale}::DOUBLE) AS t FROM (SELECT o, a, floor(a) + d AS i FROM (SELECT o, CAST({at} AS DOUBLE) AS a FROM range(0, {target}) r(o)), range({-span}, {span + 1}) s(d)))))) GROUP BY 1, 2"
        )

    rows = ", ".join(f"greatest(0, least(255, (sum(p.{c} * w.w)::BIGINT + 8192) >> 14)) AS {c}" for c in "rgb")
    return (
        f"WITH {SQL_PIXELS}, wx AS ({weights(8, width)}), wy AS ({weights(8, height)}), h AS (SELECT p.frame, w.o AS x, p.y, {rows} FROM px p JOIN wx w ON w.i = p.x GROUP BY 1, 2, 3) "
        f"SELECT p.frame, CAST(p.x AS INT) AS x, CAST(w.o AS INT) AS y, {', '.join(f'CAST(greatest(0, least(255, (sum(p.{c} * w.w)::BIGINT + 8192) >> 14)) AS INT) AS {c}' for c in 'rgb')} FROM h p JOIN wy w ON w.i = p.y GROUP BY 1, 2, 3"
    )


def _cubic_kernel(a: str) -> str:
    return f"CASE WHEN t < 1 THEN 1 + t * t * (-(({a}) + 3) + (({a}) + 2) * t) WHEN t < 2 THEN -4 * ({a}) + t * (8 * ({a}) + t * (-5 * ({a}) + ({a}) * t)) ELSE 0 END"


_SINC = lambda v: f"CASE WHEN {v} = 0 THEN 1 ELSE sin(pi() * {v}) / (pi() * {v}) END"
_RESIZE_SQL = {
    "nearest": f"WITH {SQL_PIXELS} SELECT p.frame, CAST(a.o AS INT) AS x, CAST(b.o AS INT) AS y, p.r, p.g, p.b FROM px p JOIN range(0, 12) a(o) ON p.x = least(7, floor((a.o + 0.5) * 8 / 12)) JOIN range(0, 6) b(o) ON p.y = least(7, floor((b.o + 0.5) * 8 / 6))",
    "bilinear": _resize_sql("greatest(0, 1 - t)", 1, False),
    "bicubic": _resize_sql(_cubic_kernel("-0.75::DOUBLE"), 2, False),
    "precise_bilinear": _resize_sql("greatest(0, 1 - t)", 1, True),
    "precise_bicubic_075": _resize_sql(_cubic_kernel("-0.75::DOUBLE"), 2, True),
    "precise_bicubic_060": _resize_sql(_cubic_kernel("-0.6::DOUBLE"), 2, True),
    "precise_bicubic_100": _resize_sql(_cubic_kernel("-1.0::DOUBLE"), 2, True),
    "lanczos3": _resize_sql(f"CASE WHEN t < 3 THEN ({_SINC('t')}) * ({_SINC('(t / 3)')}) ELSE 0 END", 3, True),
}
for _mode in spatial.RESIZE:
    _spatial(f"f_resize_{_mode}", spatial.resize(12, 6, _mode), _RESIZE_SQL[_mode], 12)
_spatial("f_resize_nearest_double", spatial.resize(16, 16, "nearest"), f"WITH {SQL_PIXELS} SELECT frame, CAST(x * 2 + dx AS INT) AS x, CAST(y * 2 + dy AS INT) AS y, r, g, b FROM px, range(0, 2) a(dx), range(0, 2) b(dy)", 16)
_spatial("f_hsv_identity", spatial.hsv(0), f"WITH {SQL_PIXELS} SELECT frame, x, y, r, g, b FROM px")
_spatial("f_hsv_brighter", spatial.hsv(-90, 320, 60), twins.hsv(-90, 320, 60))
_spatial("f_hsv_darker", spatial.hsv(700, 200, -40), twins.hsv(700, 200, -40))
_spatial("f_hsv_black", spatial.hsv(0, 256, -256), f"WITH {SQL_PIXELS} SELECT frame, x, y, 0 AS r, 0 AS g, 0 AS b FROM px")
_spatial("f_hsv_third_turn", spatial.hsv(512), twins.hsv(512, 256, 0))
_GROWN = _resize_sql("greatest(0, 1 - t)", 1, True, 16, 12).removeprefix("WITH ")
_ctes, _, _final = _GROWN.rpartition(") SELECT ")
_spatial("f_warp_resize", spatial.warp_resize(16, 12, 2), twins.warped(2, f"{_ctes}), pic AS (SELECT {_final})", 16, 12), 16)

# --- time ------------------------------------------------------------------


def _temporal(name: str, run, sql: str | None, width: int = 8) -> None:
    register(name, lambda s, d: pixels(run(frames(s, d)), width), sql)


def _at(d: int, c: str) -> str:
    return f"list_{c}[greatest(1, least(len(list_{c}), f + 1 + ({d})))]"


_SERIES = f"WITH {SQL_PIXELS}, series AS (SELECT x, y, {', '.join(f'list({c} ORDER BY frame) AS list_{c}' for c in 'rgb')} FROM px GROUP BY x, y), t AS (SELECT x, y, unnest(range(0, len(list_r))) AS f, list_r, list_g, list_b FROM series)"


def _blurred(c: str) -> str:
    acc = _at(-7, c)
    for d in range(-6, 1):
        acc = f"(({acc} + {_at(d, c)}) >> 1)"
    return acc


_temporal("f_motion_blur", temporal.motion_blur, f"{_SERIES} SELECT f AS frame, x, y, {', '.join(f'CAST({_blurred(c)} AS INT) AS {c}' for c in 'rgb')} FROM t")


def _smooth_sql() -> str:
    w = lambda d: "(16 - least(16, (" + " + ".join(f"({_at(d, c)} - {_at(0, c)}) * ({_at(d, c)} - {_at(0, c)})" for c in "rgb") + ") >> 8))"
    ws = ", ".join(f"{w(d)} AS w{d + 3}" for d in range(-3, 4))
    total = " + ".join(f"w{i}" for i in range(7))
    scale = f"(CASE WHEN {total} <= 2 THEN 32767 ELSE 65536 // greatest(1, {total}) END)"
    return f"{_SERIES}, u AS (SELECT *, {ws} FROM t) SELECT f AS frame, x, y, " + ", ".join(f"CAST((({' + '.join(f'w{d + 3} * {_at(d, c)}' for d in range(-3, 4))}) * {scale}) >> 16 AS INT) AS {c}" for c in "rgb") + " FROM u"


_temporal("f_temporal_smoother", lambda f: temporal.temporal_smoother(f, 8), _smooth_sql())
_temporal("f_field_delay", lambda f: temporal.field_delay(f, True), f"{_SERIES} SELECT f AS frame, x, y, {', '.join(f'CASE WHEN y % 2 = 0 THEN {_at(1, c)} ELSE {_at(0, c)} END AS {c}' for c in 'rgb')} FROM t")
_temporal("f_interlace", temporal.interlace, f"{_SERIES} SELECT f // 2 AS frame, x, y, {', '.join(f'CASE WHEN y % 2 = 0 THEN {_at(0, c)} ELSE {_at(1, c)} END AS {c}' for c in 'rgb')} FROM t WHERE f % 2 = 0")


def _bob(f: DataFrame) -> DataFrame:
    both = [map_frames(f, lambda p, k=k: temporal.bob_double(p, k)).withColumn("frame", F.col("frame") * 2 + k) for k in (0, 1)]
    return both[0].unionByName(both[1])


_COLUMN = f"WITH {SQL_PIXELS}, cols AS (SELECT frame, x, {', '.join(f'list({c} ORDER BY y) AS list_{c}' for c in 'rgb')} FROM px GROUP BY frame, x), t AS (SELECT frame, x, CAST(unnest(range(0, 8)) AS INT) AS y, list_r, list_g, list_b FROM cols)"
_row = lambda e, c: f"list_{c}[({e}) + 1]"
_temporal(
    "f_bob_doubler",
    _bob,
    f"{_COLUMN} SELECT frame * 2 + k AS frame, x, y, "
    + ", ".join(f"CASE WHEN y % 2 = k THEN {_row('y', c)} WHEN y = 0 THEN {_row('1', c)} WHEN y = 7 THEN {_row('6', c)} ELSE ({_row('y - 1', c)} + {_row('y + 1', c)} + 1) >> 1 END AS {c}" for c in "rgb")
    + " FROM t, range(0, 2) p(k)",
)
_temporal(
    "f_deinterlace_blend",
    lambda f: map_frames(f, temporal.field_blend),
    f"{_COLUMN} SELECT frame, x, y, "
    + ", ".join(f"CASE y WHEN 0 THEN ({_row('0', c)} + {_row('1', c)} + 1) >> 1 WHEN 7 THEN ({_row('6', c)} + {_row('7', c)} + 1) >> 1 ELSE ({_row('y - 1', c)} + 2 * {_row('y', c)} + {_row('y + 1', c)} + 2) >> 2 END AS {c}" for c in "rgb")
    + " FROM t",
)
_temporal("f_deinterlace_duplicate", lambda f: map_frames(f, temporal.field_duplicate), f"{_COLUMN} SELECT frame, x, y, {', '.join(f'{_row(chr(121) + " - y % 2", c)} AS {c}' for c in 'rgb')} FROM t")
_temporal("f_deinterlace_discard", lambda f: map_frames(f, temporal.field_discard), f"WITH {SQL_PIXELS} SELECT frame, x, y // 2 AS y, r, g, b FROM px WHERE y % 2 = 0")
_temporal("f_deinterlace_unfold", lambda f: map_frames(f, temporal.unfold), f"WITH {SQL_PIXELS} SELECT frame, x + 8 * (y % 2) AS x, y // 2 AS y, r, g, b FROM px", 16)
_temporal("f_deinterlace_fold", lambda f: map_frames(map_frames(f, temporal.unfold), temporal.fold, (16, 4)), f"WITH {SQL_PIXELS} SELECT frame, x, y, r, g, b FROM px")
_temporal("f_deinterlace_ela", lambda f: map_frames(f, temporal.edge_line_average), twins.edge_lines())
_temporal("f_deinterlace_yadif", temporal.yadif, twins.yadif())
_temporal("f_ivtc", lambda f: temporal.inverse_telecine(f.select("frame", "r", "g", "b"), 2), f"WITH {SQL_PIXELS} SELECT frame // 5 * 4 + frame % 5 - CASE WHEN frame % 5 > 2 THEN 1 ELSE 0 END AS frame, x, y, r, g, b FROM px WHERE frame % 5 <> 2")
_temporal(
    "f_field_bob",
    temporal.field_bob,
    f"{_COLUMN} SELECT frame, x, y, "
    + ", ".join(f"CASE WHEN frame % 2 = 0 THEN {_row('y', c)} ELSE ({_row('greatest(0, y - 1)', c)} + 2 * {_row('y', c)} + {_row('least(7, y + 1)', c)} + 2) >> 2 END AS {c}" for c in "rgb")
    + " FROM t",
)
_DIFF = " + ".join(f"abs({_at(0, c)} - {_at(-1, c)})" for c in "rgb")
_temporal("f_noise_reduction", lambda f: temporal.noise_reduction(f, 90), f"{_SERIES} SELECT f AS frame, x, y, {', '.join(f'CASE WHEN {_DIFF} <= 90 THEN ({_at(0, c)} + {_at(-1, c)} + 1) >> 1 ELSE {_at(0, c)} END AS {c}' for c in 'rgb')} FROM t")
_spatial("f_luma_squish", spatial.luma_squish, f"WITH {SQL_PIXELS} SELECT frame, x, y, {', '.join(f'({c} * 219 + 127) // 255 + 16 AS {c}' for c in 'rgb')} FROM px")
_spatial("f_vertical_squash", spatial.vertical_squash, f"WITH {SQL_PIXELS} SELECT frame, x, y // 2 AS y, {', '.join(f'CAST((sum({c}) + 1)::BIGINT >> 1 AS INT) AS {c}' for c in 'rgb')} FROM px GROUP BY frame, x, y // 2")
_spatial("f_draw_text", spatial.draw_text("7:1", 1, 1, (255, 0, 128)), f"WITH {SQL_PIXELS}, lit(x, y) AS (VALUES (1, 1), (2, 1), (3, 1), (3, 2), (2, 3), (2, 4), (2, 5), (6, 2), (6, 4)) SELECT p.frame, p.x, p.y, {', '.join(f'CASE WHEN l.x IS NULL THEN p.{c} ELSE {k} END AS {c}' for c, k in zip('rgb', (255, 0, 128), strict=True))} FROM px p LEFT JOIN lit l ON l.x = p.x AND l.y = p.y")


def _aliased(spark, sf_dir: str) -> DataFrame:
    """Planes that are said to be YCbCr, and then converted."""
    s = chain.alias(chain.Stream(frames(spark, sf_dir).select("frame", "r", "g", "b"), chain.FrameSchema(8, 8)), "ycbcr")
    return pixels(chain.convert(s.frames, s.schema, "rgb"))


_Y = f"{point.INVERSE['601', False][0]} * (r - 16) + 32768"
_PARTS = [f"{rv} * (b - 128)" for rv in point.INVERSE["601", False][1:2]] + ["({2}) * (b - 128) + ({3}) * (g - 128)".format(*point.INVERSE["601", False]), "{4} * (g - 128)".format(*point.INVERSE["601", False])]
register("f_alias_format", _aliased, f"WITH {SQL_PIXELS} SELECT frame, x, y, {', '.join(f'CAST({clamp(f'({_Y} + {v}) >> 16')} AS INT) AS {c}' for v, c in zip(_PARTS, 'rgb', strict=True))} FROM px")
_temporal(
    "f_interpolate",
    lambda f: chain.interpolate(f, f.count(), 1.5),
    f"WITH {SQL_PIXELS}, n AS (SELECT count(*) AS k FROM embeddings), m AS (SELECT i AS frame, CAST(floor((i + 0.5) / 1.5 * 256 + 0.5) - 128 AS BIGINT) AS place FROM n, range(0, CAST(floor((SELECT count(*) FROM embeddings) * 1.5 + 0.5) AS BIGINT)) t(i)), "
    "u AS (SELECT frame, greatest(0, least(k - 1, place >> 8)) AS a, greatest(0, least(k - 1, (place >> 8) + 1)) AS b, place & 255 AS w FROM m, n) "
    f"SELECT u.frame, p.x, p.y, {', '.join(f'CAST(p.{c} + (((q.{c} - p.{c}) * w + 128) >> 8) AS INT) AS {c}' for c in 'rgb')} FROM u JOIN px p ON p.frame = u.a JOIN px q ON q.frame = u.b AND q.x = p.x AND q.y = p.y",
)


def _chained(spark, sf_dir: str) -> DataFrame:
    """A chain that needs a converter, acts on a range, and ends in a mean over time."""
    f = frames(spark, sf_dir).select("frame", "r", "g", "b")
    schema = chain.FrameSchema(8, 8, count=f.count())
    invert = chain.Filter("invert", lambda p: {k: 255 - v for k, v in p.items()})
    c = chain.Chain().add(chain.Filter("flip", spatial.flip(True))).add(invert, frames=(10, 20)).add(chain.mean_of(1, 1))
    return pixels(c.run(chain.Stream(f, schema)).frames)


_INV = ", ".join(f"CASE WHEN frame BETWEEN 10 AND 19 THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb")
register(
    "chain_of_filters",
    _chained,
    f"WITH {SQL_PIXELS}, e AS (SELECT frame, 7 - x AS x, y, {_INV} FROM px), n AS (SELECT max(frame) AS last FROM px) SELECT p.frame, p.x, p.y, {', '.join(f'CAST((p.{c} + a.{c} + b.{c} + 1) // 3 AS INT) AS {c}' for c in 'rgb')} "
    "FROM e p, n JOIN e a ON true JOIN e b ON true WHERE a.frame = greatest(0, p.frame - 1) AND a.x = p.x AND a.y = p.y AND b.frame = least(n.last, p.frame + 1) AND b.x = p.x AND b.y = p.y",
)
