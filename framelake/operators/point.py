"""Point filters: a pixel depends on itself alone. All are Column expressions on 8-bit channels.

Each function takes the channels' Columns and returns the new ones; nothing is
shuffled and Spark compiles the whole chain into one loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def per_channel(rgb: RGB, f) -> RGB:
    return tuple(f(c) for c in rgb)


def lookup(table: list[int], v: Column) -> Column:
    """table[v] for v from 0 on; the table is a literal of the plan."""
    return F.element_at(F.array(*map(F.lit, table)), v + 1)


def luma(rgb: RGB) -> Column:
    r, g, b = rgb
    return 19 * b + 183 * g + 54 * r


def invert(rgb: RGB) -> RGB:
    return per_channel(rgb, lambda c: 255 - c)


def grayscale(rgb: RGB) -> RGB:
    y = F.shiftright(luma(rgb), 8)
    return y, y, y


def threshold(rgb: RGB, level: int = 128) -> RGB:
    y = F.when(luma(rgb) >= level * 256, 255).otherwise(0)
    return y, y, y


def brightness_contrast_table(brightness: int, contrast: int) -> list[int]:
    """Fixed-point line with slope contrast / 16 through a bias of brightness - 0.5; brightness is in levels."""
    slope = int(contrast / 16 * 65536 + 0.5)
    bias = round((brightness - 0.5) * 65536) + 0x8000
    return [max(0, min(255, (bias + i * slope) >> 16)) for i in range(256)]


def brightness_contrast(rgb: RGB, brightness: int, contrast: int) -> RGB:
    table = brightness_contrast_table(brightness, contrast)
    return per_channel(rgb, lambda c: lookup(table, c))


def gamma_table(to_linear: bool) -> list[int]:
    """sRGB to linear light or back."""
    def curve(x: float) -> float:
        if to_linear:
            return x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4
        return x * 12.92 if x <= 0.0031808 else 1.055 * x ** (1 / 2.4) - 0.055

    return [int(255 * curve(i / 255) + 0.5) for i in range(256)]


def gamma_correct(rgb: RGB, to_linear: bool) -> RGB:
    table = gamma_table(to_linear)
    return per_channel(rgb, lambda c: lookup(table, c))


def levels_table(in_lo: int, in_hi: int, gamma: float, out_lo: int, out_hi: int) -> list[int]:
    """Inputs are 16-bit levels, as are outputs before the shift to 8 bits."""
    table = []
    for i in range(256):
        x = i * 257
        if x < in_lo:
            y = out_lo
        elif x > in_hi:
            y = out_hi
        else:
            y = int(out_lo + (out_hi - out_lo) * ((x - in_lo) / max(1, in_hi - in_lo)) ** (1 / gamma) + 0.5)
        table.append(y >> 8)
    return table


def levels(rgb: RGB, in_lo: int, in_hi: int, gamma: float, out_lo: int, out_hi: int, by_luma: bool = False) -> RGB:
    table = levels_table(in_lo, in_hi, gamma, out_lo, out_hi)
    if not by_luma:
        return per_channel(rgb, lambda c: lookup(table, c))
    r, g, b = rgb
    y = F.shiftright(19595 * r + 38470 * g + 7471 * b + 0x8000, 16)
    delta = lookup(table, y) - y
    return per_channel(rgb, lambda c: clamp(c + delta))


def fill(rgb: RGB, x: Column, y: Column, insets: tuple[int, int, int, int], size: tuple[int, int], color: RGB, outside: bool = False) -> RGB:
    """A constant colour inside the rectangle that the insets (left, top, right, bottom) leave, or outside it."""
    left, top, right, bottom = insets
    inside = x.between(left, size[0] - right - 1) & y.between(top, size[1] - bottom - 1)
    return tuple(F.when(~inside if outside else inside, F.lit(k)).otherwise(c) for c, k in zip(rgb, color, strict=True))


#: 16.16 fixed-point weights of red and blue in luma.
LUMA = {"601": (0.299, 0.114), "709": (0.2126, 0.0722)}


def ycbcr_matrix(standard: str, full: bool) -> tuple[list[list[int]], list[int]]:
    """Rows for (y, cb, cr) over (r, g, b) in 16.16 fixed point, and their offsets with rounding."""
    kr, kb = LUMA[standard]
    kg = 1 - kr - kb
    ys, cs = (1.0, 1.0) if full else (219 / 255, 224 / 255)
    rows = [
        [kr * ys, kg * ys, kb * ys],
        [-kr / (1 - kb) / 2 * cs, -kg / (1 - kb) / 2 * cs, cs / 2],
        [cs / 2, -kg / (1 - kr) / 2 * cs, -kb / (1 - kr) / 2 * cs],
    ]
    fixed = [[int(v * 65536 + (0.5 if v >= 0 else -0.5)) for v in row] for row in rows]
    return fixed, [((0 if full else 16) << 16) + 0x8000, (128 << 16) + 0x8000, (128 << 16) + 0x8000]


def rgb_to_ycbcr(rgb: RGB, standard: str = "601", full: bool = False) -> RGB:
    rows, offsets = ycbcr_matrix(standard, full)
    return tuple(clamp(F.shiftright(sum((k * c for k, c in zip(row, rgb, strict=True)), F.lit(o)), 16)) for row, o in zip(rows, offsets, strict=True))


#: Fixed values, 16.16: (luma, red by cr, green by cr, green by cb, blue by cb). Two of "601 full" are
#: not what the standard gives (91881 and 116130), but results are to match these.
INVERSE = {
    ("601", False): (76309, 104597, -53279, -25674, 132201),
    ("601", True): (65536, 91181, -46802, -22554, 166130),
    ("709", False): (76309, 117489, -34925, -13975, 138438),
    ("709", True): (65536, 103206, -30679, -12276, 121609),
}


def ycbcr_to_rgb(ycc: RGB, standard: str = "601", full: bool = False) -> RGB:
    k_y, rv, gv, gu, bu = INVERSE[standard, full]
    y, cb, cr = ycc[0] - (0 if full else 16), ycc[1] - 128, ycc[2] - 128
    base = k_y * y + 0x8000
    return clamp(F.shiftright(base + rv * cr, 16)), clamp(F.shiftright(base + gv * cr + gu * cb, 16)), clamp(F.shiftright(base + bu * cb, 16))


#: Luminance-chrominance weights of the broadcast colour space, 8-bit fixed point.
YIQ = ((77, 150, 29), (153, -70, -82), (54, -134, 80))


def tv(rgb: RGB, mode: str) -> RGB:
    """The broadcast (YIQ) components as gray: y, i or q, the latter two around 128."""
    row = YIQ["yiq".index(mode)]
    v = F.shiftright(sum((k * c for k, c in zip(row, rgb, strict=True)), F.lit(128)), 8)
    v = clamp(v if mode == "y" else v + 128)
    return v, v, v
