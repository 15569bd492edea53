"""The video filters that a script can add: name -> (argument types of Config, how to build one from them)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np

from framelake.functions.fraction import Fraction
from framelake.operators import point, spatial, temporal
from framelake.plans import chain
from framelake.plans.chain import Filter, FrameSchema
from framelake.plans.kernels import Planes

BOTH = ("rgb", "ycbcr")
#: Resize modes by number; fixed values.
MODES = ("nearest", "bilinear", "bicubic", "precise_bilinear", "precise_bicubic_075", "precise_bicubic_060", "precise_bicubic_100", "lanczos3")


def _gray(p: Planes) -> np.ndarray:
    return 19 * p["b"] + 183 * p["g"] + 54 * p["r"]


def _alike(v: np.ndarray) -> Planes:
    return {"r": v, "g": v, "b": v}


def _through(table: list[int]) -> Callable[[Planes], Planes]:
    values = np.array(table)
    return lambda p: {k: values[v] for k, v in p.items()}


def _levels(lo: int = 0, hi: int = 0xFFFF, gamma: int = 1 << 24, out_lo: int = 0, out_hi: int = 0xFFFF, luma: int = 0) -> Filter:
    """Inputs and outputs in 1/65535, gamma in 1/2**24."""
    table = np.array(point.levels_table(lo, hi, gamma / (1 << 24), out_lo, out_hi))

    def by_luma(p: Planes) -> Planes:
        y = (19595 * p["r"] + 38470 * p["g"] + 7471 * p["b"] + 0x8000) >> 16
        return {k: np.clip(v + table[y] - y, 0, 255) for k, v in p.items()}

    return Filter("levels", by_luma if luma else _through(table.tolist()))


def _tv(mode: int = 0) -> Filter:
    row = point.YIQ[mode]

    def run(p: Planes) -> Planes:
        v = (row[0] * p["r"] + row[1] * p["g"] + row[2] * p["b"] + 128) >> 8
        return _alike(np.clip(v if mode == 0 else v + 128, 0, 255))

    return Filter("TV", run)


def _fill(left: int = 0, top: int = 0, right: int = 0, bottom: int = 0, color: int = 0) -> Filter:
    """Insets from each edge, and 0xRRGGBB."""

    def run(p: Planes) -> Planes:
        out = {}
        for (k, v), c in zip(p.items(), (color >> 16 & 255, color >> 8 & 255, color & 255), strict=True):
            out[k] = v.copy()
            out[k][:, top : v.shape[1] - bottom, left : v.shape[2] - right] = c
        return out

    return Filter("fill", run)


def _sized(name: str, kernel, width: int, height: int, models: tuple[str, ...] = ("rgb",)) -> Filter:
    return Filter(name, kernel, models, lambda s: replace(s, width=width, height=height))


def _rotate(turn: int = 0) -> Filter:
    """0 left, 1 right, 2 half."""
    swap = lambda s: replace(s, width=s.height, height=s.width) if turn < 2 else s
    return Filter("rotate", spatial.rotate(("left", "right", "half")[turn]), BOTH, swap)


def _rotate2(angle: int = 0, mode: int = 1, color: int = 0, expand: int = 0) -> Filter:
    """Angle in 1/2**32 of a full turn, filter by number, 0xRRGGBB, whether the frame grows."""
    degrees = angle * 360 / 2**32
    fill = (color >> 16 & 255, color >> 8 & 255, color & 255)

    def after(s: FrameSchema) -> FrameSchema:
        if not expand:
            return s
        c, w = abs(np.cos(np.radians(degrees))), abs(np.sin(np.radians(degrees)))
        return replace(s, width=int(np.ceil(s.width * c + s.height * w - 1e-9)), height=int(np.ceil(s.height * c + s.width * w - 1e-9)))

    return Filter("rotate2", spatial.rotate_any(degrees, ("point", "bilinear", "bicubic")[mode], fill, bool(expand)), ("rgb",), after)


def _canvas(width: float = 320, height: float = 240, x: float = 0, y: float = 0, color: int = 0) -> Filter:
    fill = (color >> 16 & 255, color >> 8 & 255, color & 255)
    return _sized("canvas size", spatial.canvas(int(width), int(height), int(x), int(y), fill), int(width), int(height))


def _over(name: str, run, output=lambda s: s, models: tuple[str, ...] = BOTH) -> Filter:
    """A filter over time, as a function of frames and their size."""
    return Filter(name, None, models, output, frames=run)


def _interlace(lace: int = 0, odd_first: int = 0) -> Filter:
    half = lambda s: replace(s, rate=s.rate / 2, count=s.count // 2)
    return _over("interlace", lambda f, size: temporal.interlace(f, bool(odd_first), size=size), half)


def _bob(mode: int = 0) -> Filter:
    """Both fields of a frame as frames: means of the rows around, or (1) edge-directed ones."""
    from pyspark.sql import functions as F

    from framelake.plans.kernels import map_frames

    make = temporal.edge_line_average if mode == 1 else temporal.bob_double

    def run(f, size):
        both = [map_frames(f, lambda p, k=k: make(p, k), size).withColumn("frame", F.col("frame") * 2 + k) for k in (0, 1)]
        return both[0].unionByName(both[1])

    return _over("bob doubler", run, lambda s: replace(s, rate=s.rate * 2, count=s.count * 2))


#: Deinterlacing modes by number, of what works on a frame alone; fixed values.
_FIELDS = {1: temporal.edge_line_average, 3: temporal.field_blend, 4: temporal.field_duplicate, 5: temporal.field_discard, 6: temporal.unfold, 7: temporal.fold}


def _deinterlace(mode: int = 0, parity: int = 0, double: int = 0) -> Filter:
    """0 Yadif, 1 edge-directed, 2 bob, 3 blend, 4 duplicate, 5 discard, 6 unfold, 7 fold. The rate is doubled by the bob doubler."""
    if mode == 0:
        return _over("deinterlace", lambda f, size: temporal.yadif(f, parity, size=size))
    if mode == 2:
        return Filter("deinterlace", lambda p: temporal.bob_double(p, parity), BOTH)
    change = {5: lambda s: replace(s, height=s.height // 2), 6: lambda s: replace(s, width=2 * s.width, height=s.height // 2), 7: lambda s: replace(s, width=s.width // 2, height=2 * s.height)}
    run = _FIELDS[mode]
    return Filter("deinterlace", (lambda p: run(p, parity)) if mode in (1, 4, 5) else run, BOTH, change.get(mode, lambda s: s))


def _interpolate(hi: int = 1, lo: int = 1) -> Filter:
    return replace(chain.nearest_rate(hi / lo), name="interpolate")


FILTERS: dict[str, tuple[str, Callable[..., Filter]]] = {
    "invert": ("", lambda: Filter("invert", lambda p: {k: 255 - v for k, v in p.items()}, BOTH)),
    "grayscale": ("", lambda: Filter("grayscale", lambda p: _alike(_gray(p) >> 8))),
    "threshold": ("i", lambda level=128: Filter("threshold", lambda p: _alike(np.where(_gray(p) >= level * 256, 255, 0)))),
    "brightness/contrast": ("ii", lambda brightness=0, contrast=16: Filter("brightness/contrast", _through(point.brightness_contrast_table(brightness, contrast)))),
    "gamma correct": ("i", lambda linear=0: Filter("gamma correct", _through(point.gamma_table(bool(linear))))),
    "levels": ("iiiiii", _levels),
    "HSV adjust": ("iii", lambda hue=0, saturation=0x10000, value=0: Filter("HSV adjust", spatial.hsv(hue >> 8, saturation >> 8, value >> 8))),
    "TV": ("i", _tv),
    "fill": ("iiiii", _fill),
    "blur": ("", lambda: Filter("blur", spatial.blur)),
    "blur more": ("", lambda: Filter("blur more", spatial.blur_more)),
    "box blur": ("ii", lambda r=1, power=1: Filter("box blur", spatial.box_blur(r, power))),
    "sharpen": ("i", lambda k=16: Filter("sharpen", spatial.sharpen(k))),
    "emboss": ("ii", lambda direction=0, height=16: Filter("emboss", spatial.emboss(direction, height))),
    "smoother": ("ii", lambda threshold=100, preblur=0: Filter("smoother", (lambda p, s=spatial.smoother(threshold): s(spatial.blur(p))) if preblur else spatial.smoother(threshold))),
    "chroma smoother": ("i", lambda mode=0: Filter("chroma smoother", spatial.chroma_smoother)),
    "warp sharp": ("ii", lambda depth=2, blur=0: Filter("warp sharp", spatial.warp_sharp(depth, 1 + blur))),
    "warp resize": ("iii", lambda w=8, h=8, _=0: _sized("warp resize", spatial.warp_resize(w, h, 2), w, h)),
    "general convolution": ("iiiiiiiiiii", lambda *a: Filter("general convolution", spatial.convolution(list(a[:9]) or [0, 0, 0, 0, 256, 0, 0, 0, 0], a[9] if len(a) > 9 else 0))),
    "flip horizontally": ("", lambda: Filter("flip horizontally", spatial.flip(True), BOTH)),
    "flip vertically": ("", lambda: Filter("flip vertically", spatial.flip(False), BOTH)),
    "rotate": ("i", _rotate),
    "rotate2": ("iiii", _rotate2),
    "field swap": ("", lambda: Filter("field swap", spatial.field_swap, BOTH)),
    "2:1 reduction": ("", lambda: Filter("2:1 reduction", spatial.reduce2, output=lambda s: replace(s, width=s.width // 2, height=s.height // 2))),
    "2:1 reduction (high quality)": ("", lambda: Filter("2:1 reduction (high quality)", spatial.reduce2_hq, output=lambda s: replace(s, width=s.width // 2, height=s.height // 2))),
    "resize": ("iis", lambda w=8, h=8, mode="precise_bicubic_075": _sized("resize", spatial.resize(int(w), int(h), mode if isinstance(mode, str) else MODES[mode]), int(w), int(h))),
    "canvas size": ("ddddi", _canvas),
    "null transform": ("", lambda: Filter("null transform", lambda p: p, BOTH)),
    "convert format": ("i", lambda model=1: Filter("convert format", lambda p: p, (BOTH[model],))),
    "motion blur": ("", lambda: _over("motion blur", lambda f, size: temporal.motion_blur(f, size=size))),
    "temporal smoother": ("i", lambda strength=4: _over("temporal smoother", lambda f, size: temporal.temporal_smoother(f, strength, size=size))),
    "field delay": ("i", lambda top_first=0: _over("field delay", lambda f, size: temporal.field_delay(f, bool(top_first), size=size))),
    "field bob": ("", lambda: _over("field bob", lambda f, size: temporal.field_bob(f, size=size))),
    "interlace": ("ii", _interlace),
    "bob doubler": ("i", _bob),
    "deinterlace": ("iii", _deinterlace),
    "interpolate": ("ii", _interpolate),
    "IVTC": ("i", lambda phase=0: _over("IVTC", lambda f, size: temporal.inverse_telecine(f, phase), lambda s: replace(s, rate=s.rate * Fraction(4, 5), count=s.count // 5 * 4))),
}
