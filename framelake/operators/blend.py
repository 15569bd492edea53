"""Blending of two or three layers joined by frame and place. c is the lower layer, d the upper, 8 bits."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.point import clamp, lookup


def scaled(product: Column) -> Column:
    """product / 255, rounded, for products of two 8-bit numbers."""
    t = product + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def quotient(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative numbers; null where b is 0."""
    return F.floor(a / F.nullif(b, F.lit(0))).cast("int")


def lerp(c: Column, d: Column, f: Column | int) -> Column:
    return scaled(255 * c + (d - c) * f)


#: The soft-light corrections, from their defining curves.
DARKEN = [int(255 * (x := i / 255) * (1 - x) + 0.5) for i in range(256)]
LIGHTEN = [int(255 * ((((16 * x - 12) * x + 4) * x - x) if (x := i / 255) <= 0.25 else sqrt(x) - x) + 0.5) for i in range(256)]


def _overlay(c: Column, d: Column) -> Column:
    return F.when(c < 128, scaled(2 * c * d)).otherwise(F.greatest(F.lit(0), 2 * (c + d - scaled(c * d)) - 255))


def _hard_light(c: Column, d: Column) -> Column:
    low = scaled(2 * c * d)
    return F.when(d < 128, low).otherwise(2 * (c + d) - low - 255)


def _soft_light(c: Column, d: Column) -> Column:
    dark = F.greatest(F.lit(0), c - scaled((255 - 2 * d) * lookup(DARKEN, c)))
    light = F.least(F.lit(255), c + scaled((2 * d - 255) * lookup(LIGHTEN, c)))
    return F.when(d < 128, dark).otherwise(light)


def _vivid_light(c: Column, d: Column) -> Column:
    low = F.greatest(F.lit(0), 255 - quotient((255 - c) * 255 + d, 2 * d))
    high = F.least(F.lit(255), quotient(c * 255 + 255 - d, 2 * (255 - d)))
    return F.when(d < 128, F.coalesce(low, F.lit(0))).otherwise(F.coalesce(high, F.lit(255)))


def _color_burn(c: Column, d: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), 255 - quotient(255 * (255 - c) + F.shiftright(d, 1), d)), F.lit(0))


def _color_dodge(c: Column, d: Column) -> Column:
    e = 255 - d
    return F.least(F.lit(255), F.coalesce(quotient(255 * c + F.shiftright(e, 1), e), F.when(c > 0, 255).otherwise(0)))


MODES = {
    "min": F.least,
    "max": F.greatest,
    "add": lambda c, d: F.least(F.lit(255), c + d),
    "multiply": lambda c, d: scaled(c * d),
    "linear_burn": lambda c, d: F.greatest(F.lit(0), c + d - 255),
    "color_burn": _color_burn,
    "screen": lambda c, d: c + d - scaled(c * d),
    "color_dodge": _color_dodge,
    "overlay": _overlay,
    "soft_light": _soft_light,
    "hard_light": _hard_light,
    "vivid_light": _vivid_light,
    "linear_light": lambda c, d: clamp(c + 2 * d - 255),
    "pin_light": lambda c, d: F.when(d < 128, F.least(c, 2 * d)).otherwise(F.greatest(c, 2 * d - 255)),
    "hard_mix": lambda c, d: F.when(c + d > 255, 255).otherwise(0),
    "difference": lambda c, d: F.abs(c - d),
    "exclusion": lambda c, d: scaled(255 * (c + d) - 2 * c * d),
}


def blend(mode: str, c: Column, d: Column, amount: float = 1.0) -> Column:
    f = int(255 * amount + 0.5)
    if f == 0:
        return c
    if mode == "lerp":
        return d if f == 255 else lerp(c, d, f)
    full = MODES[mode](c, d)
    return full if f == 255 else lerp(full, c, 255 - f)


def merge(mode: str, a: Column, b: Column, m: Column) -> Column:
    """select: b where the mask is 128 or more; lerp: from a to b by the mask."""
    if mode == "select":
        return F.when(m >= 128, b).otherwise(a)
    return a + scaled((b - a) * m)


def blend_layers(below: DataFrame, above: DataFrame, mode: str, amount: float = 1.0, keys: tuple[str, ...] = ("frame", "x", "y")) -> DataFrame:
    """Rows that both layers have, blended per channel; an equi-join on the place."""
    d = above.select(*keys, *(F.col(c).alias(f"{c}_d") for c in "rgb"))
    return below.join(d, list(keys)).select(*keys, *(blend(mode, F.col(c), F.col(f"{c}_d"), amount).cast("int").alias(c) for c in "rgb"))


def merge_layers(a: DataFrame, b: DataFrame, mask: DataFrame, mode: str, keys: tuple[str, ...] = ("frame", "x", "y")) -> DataFrame:
    """Three layers; the mask's red channel decides."""
    b = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in "rgb"))
    mask = mask.select(*keys, F.col("r").alias("m"))
    return a.join(b, list(keys)).join(mask, list(keys)).select(*keys, *(merge(mode, F.col(c), F.col(f"{c}_b"), F.col("m")).cast("int").alias(c) for c in "rgb"))


def overlay_image(frames: DataFrame, image: DataFrame, opacity: float, at: tuple[int, int]) -> DataFrame:
    """A small image (x, y, r, g, b) over every frame at a place; images are one frame and therefore broadcast."""
    logo = image.select((F.col("x") + at[0]).alias("x"), (F.col("y") + at[1]).alias("y"), *(F.col(c).alias(f"{c}_d") for c in "rgb"))
    f = int(255 * opacity + 0.5)
    joined = frames.join(F.broadcast(logo), ["x", "y"], "left")
    return joined.select("frame", "x", "y", *(F.when(F.col("r_d").isNull(), F.col(c)).otherwise(lerp(F.col(c), F.col(f"{c}_d"), f)).cast("int").alias(c) for c in "rgb"))
