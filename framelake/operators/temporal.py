"""Temporal filters: kernels over stretches of frames (see `plans.kernels.over_time`) and joins on frame numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.spatial import shifted
from framelake.plans.kernels import Planes, over_time


def motion_blur(frames: DataFrame, taps: int = 8, **how) -> DataFrame:
    """Halving fold over the last `taps` frames (older ones would weigh under 1 / 2**taps); before the start, frame 0 repeats."""
    def run(planes: Planes, start: int, stop: int) -> Planes:
        out = {}
        for k, p in planes.items():
            acc = p[start - taps + 1 : stop - taps + 1]
            for back in range(taps - 2, -1, -1):
                acc = (acc + p[start - back : stop - back]) >> 1
            out[k] = acc
        return out

    return over_time(frames, run, taps - 1, 0, **how)


def temporal_smoother(frames: DataFrame, strength: int, **how) -> DataFrame:
    """Mean over seven frames, each pixel weighted by 16 less its squared distance to the middle one >> strength."""
    def run(planes: Planes, start: int, stop: int) -> Planes:
        view = lambda p, d: p[start + d : stop + d]
        weights = [16 - np.minimum(16, sum((view(p, d) - view(p, 0)) ** 2 for p in planes.values()) >> strength) for d in range(-3, 4)]
        total = sum(weights)
        scale = np.where(total <= 2, 0x7FFF, 65536 // np.maximum(total, 1))
        return {k: sum(w * view(p, d) for w, d in zip(weights, range(-3, 4), strict=True)) * scale >> 16 for k, p in planes.items()}

    return over_time(frames, run, 3, 3, **how)


def field_delay(frames: DataFrame, top_first: bool, **how) -> DataFrame:
    """One field from the next frame: the even rows if the top field comes first, else the odd ones."""
    def run(planes: Planes, start: int, stop: int) -> Planes:
        out = {}
        for k, p in planes.items():
            q = p[start:stop].copy()
            rows = slice(0 if top_first else 1, None, 2)
            q[:, rows] = p[start + 1 : stop + 1, rows]
            out[k] = q
        return out

    return over_time(frames, run, 0, 1, **how)


def interlace(frames: DataFrame, odd_first: bool = False, stretch: int = 64, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Half the frames: even rows of frame 2f and odd rows of 2f + 1, or the other way round. A last odd frame pairs with itself."""
    def run(planes: Planes, start: int, stop: int) -> Planes:
        out = {}
        for k, p in planes.items():
            q = p[start:stop].copy()
            rows = slice(0 if odd_first else 1, None, 2)
            q[:, rows] = p[start + 1 : stop + 1, rows]
            out[k] = q
        return out

    laced = over_time(frames, run, 0, 1, size=size, stretch=stretch - stretch % 2)
    return laced.where(F.col("frame") % 2 == 0).withColumn("frame", F.floor(F.col("frame") / 2))


def _interpolated(p: np.ndarray, parity: int) -> np.ndarray:
    """Rows of other parity replaced by the upward-rounded mean of their neighbours, at the edges by the nearest row."""
    out = p.copy()
    h = p.shape[1]
    for y in range(1 - parity, h, 2):
        up, down = (y - 1, y + 1)
        up, down = (down, down) if up < 0 else (up, up) if down >= h else (up, down)
        out[:, y] = (p[:, up] + p[:, down] + 1) >> 1
    return out


def bob_double(planes: Planes, parity: int) -> Planes:
    """One field of each frame as a whole frame."""
    return {k: _interpolated(p, parity) for k, p in planes.items()}


def field_blend(planes: Planes) -> Planes:
    """(a + 2b + c + 2) >> 2 down the rows; the first and last row average with their neighbour, rounded up."""
    out = {}
    for k, p in planes.items():
        q = (shifted(p, 0, -1) + 2 * p + shifted(p, 0, 1) + 2) >> 2
        q[:, 0], q[:, -1] = (p[:, 0] + p[:, 1] + 1) >> 1, (p[:, -2] + p[:, -1] + 1) >> 1
        out[k] = q
    return out


def field_duplicate(planes: Planes, parity: int = 0) -> Planes:
    """Each row of one field twice."""
    return {k: np.repeat(p[:, parity::2], 2, axis=1)[:, : p.shape[1]] for k, p in planes.items()}


def field_discard(planes: Planes, parity: int = 0) -> Planes:
    """One field alone, at half the height."""
    return {k: p[:, parity::2] for k, p in planes.items()}


def unfold(planes: Planes) -> Planes:
    """Both fields side by side."""
    return {k: np.concatenate((p[:, ::2], p[:, 1::2]), axis=2) for k, p in planes.items()}


def fold(planes: Planes) -> Planes:
    """The opposite of unfold."""
    out = {}
    for k, p in planes.items():
        n, h, w = p.shape
        q = np.empty((n, 2 * h, w // 2), p.dtype)
        q[:, ::2], q[:, 1::2] = p[:, :, : w // 2], p[:, :, w // 2 :]
        out[k] = q
    return out


def edge_line_average(planes: Planes, parity: int = 0) -> Planes:
    """Missing rows along the direction of least difference between the rows around: straight, or one or two columns aslant."""
    ups, downs = {k: shifted(p, 0, -1) for k, p in planes.items()}, {k: shifted(p, 0, 1) for k, p in planes.items()}
    for part in (ups, downs):
        for k, p in planes.items():
            part[k][:, 0] = p[:, min(1, p.shape[1] - 1)] if parity else part[k][:, 0]
            part[k][:, -1] = p[:, -2] if (p.shape[1] - 1) % 2 != parity else part[k][:, -1]

    def score(d: int) -> np.ndarray:
        one = sum(np.abs(shifted(ups[k], d, 0) - shifted(downs[k], -d, 0)) for k in planes)
        return shifted(one, -1, 0) + 2 * one + shifted(one, 1, 0)

    s = {d: score(d) for d in range(-2, 3)}
    best, chosen = s[0], np.zeros_like(s[0])
    for side in (-1, 1):  # the far direction only where the near one wins
        better = s[side] < best
        best, chosen = np.where(better, s[side], best), np.where(better, side, chosen)
        far = better & (s[2 * side] < best)
        best, chosen = np.where(far, s[2 * side], best), np.where(far, 2 * side, chosen)
    out = {}
    for k, p in planes.items():
        new = np.zeros_like(p)
        for d in range(-2, 3):
            new = np.where(chosen == d, (shifted(ups[k], d, 0) + shifted(downs[k], -d, 0) + 1) >> 1, new)
        q = p.copy()
        q[:, 1 - parity :: 2] = new[:, 1 - parity :: 2]
        out[k] = q
    return out


def yadif(frames: DataFrame, parity: int = 0, **how) -> DataFrame:
    """Missing rows from edge-directed rows of the frame, held within what the frames around allow."""
    def run(planes: Planes, start: int, stop: int) -> Planes:
        spatial = edge_line_average({k: p[start:stop] for k, p in planes.items()}, parity)
        out = {}
        for k, p in planes.items():
            cur, prev, nxt = p[start:stop], p[start - 1 : stop - 1], p[start + 1 : stop + 1]
            up, down = shifted(cur, 0, -1), shifted(cur, 0, 1)
            # With the kept field first, this row's own field lies between the previous frame's and this one's.
            before, after = (prev, cur) if parity == 0 else (cur, nxt)
            middle = (before + after + 1) >> 1
            d0 = np.abs(before - after)
            d1 = (np.abs(shifted(prev, 0, -1) - up) + np.abs(shifted(prev, 0, 1) - down)) >> 1
            d2 = (np.abs(shifted(nxt, 0, -1) - up) + np.abs(shifted(nxt, 0, 1) - down)) >> 1
            far = lambda d: (shifted(before, 0, d) + shifted(after, 0, d) + 1) >> 1
            p0, p4 = far(-2), far(2)
            most = np.minimum(np.minimum(middle - down, middle - up), np.maximum(p0 - up, p4 - down))
            least = np.maximum(np.maximum(middle - down, middle - up), np.minimum(p0 - up, p4 - down))
            span = np.maximum.reduce([d0 >> 1, d1, d2, most, -least, np.zeros_like(most)])
            q = cur.copy()
            q[:, 1 - parity :: 2] = np.clip(spatial[k], middle - span, middle + span)[:, 1 - parity :: 2]
            out[k] = q
        return out

    return over_time(frames, run, 1, 1, **how)


def inverse_telecine(frames: DataFrame, phase: int = 0) -> DataFrame:
    """Five frames become four: the frame at `phase` of each five goes and the rest are numbered anew."""
    kept = frames.where(F.pmod(F.col("frame"), F.lit(5)) != phase)
    return kept.withColumn("frame", (F.floor(F.col("frame") / 5) * 4 + F.col("frame") % 5 - (F.col("frame") % 5 > phase).cast("int")).cast("long"))


def field_bob(frames: DataFrame, smooth: bool = True, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Steadies alternate fields: even frames stay, odd ones move half a row by (a + 2b + c) / 4, or a quarter by (a + 3b) / 4."""
    from framelake.plans.kernels import map_frames

    def move(planes: Planes) -> Planes:
        if smooth:
            return {k: (shifted(p, 0, -1) + 2 * p + shifted(p, 0, 1) + 2) >> 2 for k, p in planes.items()}
        return {k: (shifted(p, 0, -1) + 3 * p + 2) >> 2 for k, p in planes.items()}

    f = frames.select("frame", "r", "g", "b")
    return f.where(F.col("frame") % 2 == 0).unionByName(map_frames(f.where(F.col("frame") % 2 != 0), move, size))


def noise_reduction(frames: DataFrame, threshold: int, **how) -> DataFrame:
    """Capture noise: a pixel near the same one of the frame before becomes the mean of both."""
    def run(planes: Planes, start: int, stop: int) -> Planes:
        last = {k: p[start - 1 : stop - 1] for k, p in planes.items()}
        now = {k: p[start:stop] for k, p in planes.items()}
        near = sum(np.abs(now[k] - last[k]) for k in planes) <= threshold
        return {k: np.where(near, (now[k] + last[k] + 1) >> 1, now[k]) for k in planes}

    return over_time(frames, run, 1, 0, **how)
