"""Neighbourhood and geometry filters as NumPy kernels on planes (frames, height, width), y = 0 on top.

Edges replicate unless said otherwise.
"""

from __future__ import annotations

import numpy as np

from framelake.plans.kernels import Kernel, Planes


def each(f) -> Kernel:
    return lambda planes: {k: f(p) for k, p in planes.items()}


def clip(p: np.ndarray) -> np.ndarray:
    return np.clip(p, 0, 255)


def shifted(p: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Each pixel's neighbour at (x + dx, y + dy)."""
    h, w = p.shape[1:]
    return p[:, np.clip(np.arange(h) + dy, 0, h - 1)][:, :, np.clip(np.arange(w) + dx, 0, w - 1)]


def convolution(weights: list[int], bias: int = 0) -> Kernel:
    """3x3 weights in 1/256, rows from top to bottom."""
    def run(p: np.ndarray) -> np.ndarray:
        total = np.full_like(p, bias)
        for i, k in enumerate(weights):
            if k:
                total = total + k * shifted(p, i % 3 - 1, i // 3 - 1)
        return clip(total >> 8)

    return each(run)


def sharpen(amount: int = 16) -> Kernel:
    return convolution([-amount] * 4 + [256 + 8 * amount] + [-amount] * 4, -4 * amount)


#: Compass places of the 3x3 neighbourhood, clockwise from east; their order is the filter's directions.
COMPASS = (5, 2, 1, 0, 3, 6, 7, 8)


def emboss(direction: int = 0, height: int = 16, rounded: bool = False) -> Kernel:
    m = [0] * 9
    m[COMPASS[direction]], m[COMPASS[(direction + 4) % 8]] = -height, height
    if rounded:
        half = (height + 1) // 2
        for turn, sign in ((1, -1), (7, -1), (3, 1), (5, 1)):
            m[COMPASS[(direction + turn) % 8]] = sign * half
    return convolution(m, 128 * 256 + 128)


def _pass(p: np.ndarray, taps: list[int], shift: int, axis: int) -> np.ndarray:
    reach = len(taps) // 2
    total = np.full_like(p, 1 << shift >> 1)
    for i, k in enumerate(taps):
        total = total + k * (shifted(p, i - reach, 0) if axis == 2 else shifted(p, 0, i - reach))
    return total >> shift


def blur(p: Planes) -> Planes:
    """[1 2 1] / 4 along rows, then columns."""
    return each(lambda x: _pass(_pass(x, [1, 2, 1], 2, 2), [1, 2, 1], 2, 1))(p)


def blur_more(p: Planes) -> Planes:
    """[1 4 6 4 1] / 16 along rows, then columns."""
    return each(lambda x: _pass(_pass(x, [1, 4, 6, 4, 1], 4, 2), [1, 4, 6, 4, 1], 4, 1))(p)


def box_blur(radius: int, power: int = 1) -> Kernel:
    def along(p: np.ndarray, axis: int) -> np.ndarray:
        r = min(radius, (p.shape[axis] - 1) >> 1)
        k = 65535 // (2 * r + 1) + 1
        for _ in range(power):
            p = sum(shifted(p, d, 0) if axis == 2 else shifted(p, 0, d) for d in range(-r, r + 1)) * k >> 16
        return p

    return each(lambda p: along(along(p, 2), 1))


def smoother(threshold: int) -> Kernel:
    """Averages with weights [1 2 1; 2 4 2; 1 2 1] / 16 where no pixel of the neighbourhood lies on an edge."""
    def run(planes: Planes) -> Planes:
        gx = sum(np.abs(shifted(p, 1, 0) - shifted(p, -1, 0)) for p in planes.values())
        gy = sum(np.abs(shifted(p, 0, 1) - shifted(p, 0, -1)) for p in planes.values())
        edge = (gx * gx + gy * gy > threshold).astype(np.int64)
        near = sum(shifted(edge, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) > 0
        weights = [1, 2, 1, 2, 4, 2, 1, 2, 1]
        mean = lambda p: sum(k * shifted(p, i % 3 - 1, i // 3 - 1) for i, k in enumerate(weights)) + 8 >> 4
        return {k: np.where(near, p, mean(p)) for k, p in planes.items()}

    return run


def chroma_smoother(planes: Planes) -> Planes:
    """Chroma (difference to luma) averaged [1 2 1] / 4 along rows; luma stays."""
    y = lambda p: 54 * p["r"] + 183 * p["g"] + 19 * p["b"]
    soft = {k: shifted(p, -1, 0) + 2 * p + shifted(p, 1, 0) for k, p in planes.items()}
    delta = (4 * y(planes) - y(soft) + 512) >> 10
    return {k: clip(((p + 2) >> 2) + delta) for k, p in soft.items()}


def reduce2(p: Planes) -> Planes:
    """Half the size, 2x2 means rounded half up."""
    return each(lambda x: (x[:, ::2, ::2] + x[:, 1::2, ::2] + x[:, ::2, 1::2] + x[:, 1::2, 1::2] + 2) >> 2)(p)


def reduce2_hq(p: Planes) -> Planes:
    """Half the size, [1 2 1] x [1 2 1] / 16 around odd places; at an even size's first row and column the sum of what there is, by 9."""
    def run(x: np.ndarray) -> np.ndarray:
        n, h, w = x.shape
        ys, xs = np.arange(h % 2, h, 2), np.arange(w % 2, w, 2)
        weights = [1, 2, 1, 2, 4, 2, 1, 2, 1]
        full = sum(k * shifted(x, i % 3 - 1, i // 3 - 1) for i, k in enumerate(weights)) + 8 >> 4
        padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
        some = sum(padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx in (-1, 0, 1) for dy in (-1, 0, 1)) // 9
        out = full[:, ys][:, :, xs]
        if h % 2 == 0:
            out[:, 0] = some[:, 0][:, xs]
        if w % 2 == 0:
            out[:, :, 0] = some[:, ys][:, :, 0]
        return out

    return each(run)(p)


def flip(horizontal: bool) -> Kernel:
    return each(lambda p: p[:, :, ::-1] if horizontal else p[:, ::-1])


def rotate(mode: str) -> Kernel:
    turns = {"left": 1, "half": 2, "right": 3}[mode]
    return each(lambda p: np.rot90(p, turns, (1, 2)))


def field_swap(p: Planes) -> Planes:
    """Rows in pairs exchanged; a last odd row stays."""
    def run(x: np.ndarray) -> np.ndarray:
        rows = np.arange(x.shape[1]) ^ 1
        rows[rows >= x.shape[1]] = x.shape[1] - 1
        return x[:, rows]

    return each(run)(p)


def crop(left: int, top: int, right: int, bottom: int) -> Kernel:
    return each(lambda p: p[:, top : p.shape[1] - bottom, left : p.shape[2] - right])


def canvas(width: int, height: int, left: int, top: int, color: tuple[int, int, int]) -> Kernel:
    """The frame at a place on a larger (or smaller) canvas of one colour."""
    def run(planes: Planes) -> Planes:
        out = {}
        for (k, p), fill in zip(planes.items(), color, strict=True):
            q = np.full((len(p), height, width), fill, np.int64)
            h, w = min(p.shape[1], height - top), min(p.shape[2], width - left)
            q[:, top : top + h, left : left + w] = p[:, :h, :w]
            out[k] = q
        return out

    return run


# --- resampling ------------------------------------------------------------


def _cubic(a: float):
    def f(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t < 1, 1 + t * t * (-(a + 3) + (a + 2) * t), np.where(t < 2, -4 * a + t * (8 * a + t * (-5 * a + a * t)), 0))

    return f, 2.0


KERNELS = {
    "linear": (lambda t: np.maximum(0, 1 - np.abs(t)), 1.0),
    "cubic_075": _cubic(-0.75),
    "cubic_060": _cubic(-0.6),
    "cubic_100": _cubic(-1.0),
    "lanczos3": (lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0), 3.0),
}
#: Filter name -> (kernel, whether it widens when shrinking).
RESIZE = {
    "nearest": None,
    "bilinear": ("linear", False),
    "bicubic": ("cubic_075", False),
    "precise_bilinear": ("linear", True),
    "precise_bicubic_075": ("cubic_075", True),
    "precise_bicubic_060": ("cubic_060", True),
    "precise_bicubic_100": ("cubic_100", True),
    "lanczos3": ("lanczos3", True),
}


def resize_weights(source: int, target: int, mode: str) -> np.ndarray:
    """(target, source) weights in 1/16384 that sum to 16384 in each row; 256 phases between pixels."""
    at = (np.arange(target) + 0.5) * source / target - 0.5
    if RESIZE[mode] is None:
        out = np.zeros((target, source), np.int64)
        out[np.arange(target), np.clip(np.floor(at + 0.5).astype(int), 0, source - 1)] = 16384
        return out
    name, widens = RESIZE[mode]
    kernel, reach = KERNELS[name]
    scale = max(1.0, source / target) if widens else 1.0
    at = np.floor(at * 256 + 0.5) / 256
    out = np.zeros((target, source), np.int64)
    span = int(np.ceil(reach * scale)) + 1
    for i, center in enumerate(at):
        places = np.arange(int(np.floor(center)) - span, int(np.floor(center)) + span + 1)
        w = kernel((places - center) / scale)
        fixed = np.floor(w / w.sum() * 16384 + 0.5).astype(np.int64)
        fixed[fixed.argmax()] += 16384 - fixed.sum()
        np.add.at(out[i], np.clip(places, 0, source - 1), fixed)
    return out


def resize(width: int, height: int, mode: str = "precise_bicubic_075") -> Kernel:
    def run(p: np.ndarray) -> np.ndarray:
        rows = clip((p @ resize_weights(p.shape[2], width, mode).T + 8192) >> 14)
        return clip((np.einsum("oh,nhw->now", resize_weights(p.shape[1], height, mode), rows) + 8192) >> 14)

    return each(run)


def _sampled(p: np.ndarray, sx: np.ndarray, sy: np.ndarray, mode: str, fill: int | None) -> np.ndarray:
    """p at real places (height, width); fill beyond the edges, or the edge's pixel for None."""
    h, w = p.shape[1:]
    beyond = (sx < -0.5) | (sx > w - 0.5) | (sy < -0.5) | (sy > h - 0.5)
    take = lambda x, y: p[:, np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
    if mode == "point":
        out = take(np.floor(sx + 0.5).astype(int), np.floor(sy + 0.5).astype(int))
    else:
        kernel, reach = KERNELS["linear" if mode == "bilinear" else "cubic_075"]
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        total = 0.0
        for dy in range(1 - int(reach), int(reach) + 1):
            for dx in range(1 - int(reach), int(reach) + 1):
                total = total + kernel(sx - x0 - dx) * kernel(sy - y0 - dy) * take(x0 + dx, y0 + dy)
        # Ties don't depend on the order of the sum.
        out = clip(np.floor(np.round(total, 9) + 0.5).astype(np.int64))
    return out if fill is None else np.where(beyond, fill, out)


def rotate_any(degrees: float, mode: str = "bilinear", color: tuple[int, int, int] = (0, 0, 0), expand: bool = False) -> Kernel:
    """Counter-clockwise about the centre; expand grows the frame to hold all of it."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))

    def run(planes: Planes) -> Planes:
        h, w = planes["r"].shape[1:]
        H, W = (int(np.ceil(abs(h * c) + abs(w * s) - 1e-9)), int(np.ceil(abs(w * c) + abs(h * s) - 1e-9))) if expand else (h, w)
        y, x = np.mgrid[:H, :W]
        u, v = x - (W - 1) / 2, y - (H - 1) / 2
        sx, sy = c * u - s * v + (w - 1) / 2, s * u + c * v + (h - 1) / 2
        return {k: _sampled(p, sx, sy, mode, fill) for (k, p), fill in zip(planes.items(), color, strict=True)}

    return run


def perspective(corners: list[tuple[float, float]], width: int, height: int, mode: str = "bilinear") -> Kernel:
    """The quadrangle with these source corners (top left, top right, bottom left, bottom right) spread over a frame."""
    target = [(-0.5, -0.5), (width - 0.5, -0.5), (-0.5, height - 0.5), (width - 0.5, height - 0.5)]
    rows, right = [], []
    for (x, y), (u, v) in zip(target, corners, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)

    def run(planes: Planes) -> Planes:
        y, x = np.mgrid[:height, :width]
        u, v, q = (m[i, 0] * x + m[i, 1] * y + m[i, 2] for i in range(3))
        return each(lambda p: _sampled(p, u / q, v / q, mode, None))(planes)

    return run


def warp_sharp(depth: int, blur_passes: int = 1) -> Kernel:
    """Pixels move along the slope of a blurred edge map, so that edges thin out."""
    def run(planes: Planes) -> Planes:
        gray = (54 * planes["r"] + 183 * planes["g"] + 19 * planes["b"]) >> 8
        gx, gy = shifted(gray, 1, 0) - shifted(gray, -1, 0), shifted(gray, 0, 1) - shifted(gray, 0, -1)
        bump = np.minimum(255, np.abs(gx) + np.abs(gy))
        for _ in range(blur_passes):
            bump = _pass(_pass(bump, [1, 2, 1], 2, 2), [1, 2, 1], 2, 1)
        dx, dy = (shifted(bump, 1, 0) - shifted(bump, -1, 0)) * depth, (shifted(bump, 0, 1) - shifted(bump, 0, -1)) * depth
        n, h, w = gray.shape
        y, x = np.mgrid[:h, :w]
        sx, sy = np.clip(x * 256 - dx, 0, (w - 1) * 256), np.clip(y * 256 - dy, 0, (h - 1) * 256)
        frame = np.arange(n)[:, None, None]

        def sample(p: np.ndarray) -> np.ndarray:
            x0, y0, fx, fy = sx >> 8, sy >> 8, sx & 255, sy & 255
            x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
            top = p[frame, y0, x0] * (256 - fx) + p[frame, y0, x1] * fx
            low = p[frame, y1, x0] * (256 - fx) + p[frame, y1, x1] * fx
            return (top * (256 - fy) + low * fy + 32768) >> 16

        return each(sample)(planes)

    return run


def warp_resize(width: int, height: int, depth: int) -> Kernel:
    """Enlarged bilinearly, then edges thinned."""
    grow, thin = resize(width, height, "precise_bilinear"), warp_sharp(depth)
    return lambda planes: thin(grow(planes))


def hsv(hue: int, saturation: int = 256, value: int = 0) -> Kernel:
    """hue in 1/256 of a sixth turn, saturation in 1/256, value from -256 (black) to 256 (white).

    Works on centre and range of the channels; the hue is a walk along the
    hexagon's edges by that many steps of the new range.
    """
    def run(planes: Planes) -> Planes:
        rgb = np.stack([planes[k] for k in "rgb"])
        top, low = rgb.max(axis=0), rgb.min(axis=0)
        span, twice = top - low, top + low
        twice = ((twice ^ 0x1FF) * (256 - value) + 128 >> 8) ^ 0x1FF if value > 0 else twice * (256 + value) + 128 >> 8
        new = np.minimum(span * saturation + 128 >> 8, np.minimum(twice, 511 - twice))
        bottom, n = (twice - new) >> 1, ((twice + new) >> 1) - ((twice - new) >> 1)
        scale = np.where(span > 0, 65536 // np.maximum(span, 1) + (65536 % np.maximum(span, 1) * 2 >= np.maximum(span, 1)), 0)
        r, g, b = np.minimum(n, (rgb - low) * n * scale + 0x8000 >> 16)
        at = np.select([(r == n) & (b == 0), (g == n) & (b == 0), (g == n) & (r == 0), (b == n) & (r == 0), (b == n) & (g == 0)], [g, 2 * n - r, 2 * n + b, 4 * n - g, 4 * n + r], 6 * n - b)
        at = (at + (n * hue + 128 >> 8)) % np.maximum(6 * n, 1)
        rise = lambda offset: np.clip(np.abs((at + offset) % np.maximum(6 * n, 1) - 3 * n) - n, 0, n)
        gray = (span == 0) | (n <= 0)
        return {k: np.where(gray, bottom, rise(o) + bottom) for k, o in (("r", 0 * n), ("g", 4 * n), ("b", 2 * n))}

    return run


def luma_squish(planes: Planes) -> Planes:
    """Full range to the broadcast range, 16 to 235."""
    return each(lambda p: (p * 219 + 127) // 255 + 16)(planes)


def vertical_squash(planes: Planes) -> Planes:
    """Half the height, rows averaged in pairs, rounded up."""
    return each(lambda p: (p[:, ::2] + p[:, 1::2] + 1) >> 1)(planes)


#: Glyphs of 3 x 5 pixels, a row of bits each, for time codes; fixed values.
GLYPHS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 3, 1, 7), "4": (5, 5, 7, 1, 1),
    "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7), "7": (7, 1, 2, 2, 2), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7),
    ":": (0, 2, 0, 2, 0), ".": (0, 0, 0, 0, 2), "-": (0, 0, 7, 0, 0), " ": (0, 0, 0, 0, 0),
}


def text_mask(text: str) -> np.ndarray:
    """(5, 4 * length) of whether a pixel is lit; characters without a glyph are blank."""
    rows = [[(GLYPHS.get(c, GLYPHS[" "])[y] >> (2 - x)) & 1 if x < 3 else 0 for c in text for x in range(4)] for y in range(5)]
    return np.array(rows, bool).reshape(5, 4 * len(text))


def draw_text(text: str, left: int, top: int, color: tuple[int, int, int]) -> Kernel:
    """Digits and marks of a time code, cut off at the frame's edge."""
    mask = text_mask(text)

    def run(planes: Planes) -> Planes:
        out = {}
        for (k, p), lit in zip(planes.items(), color, strict=True):
            q = p.copy()
            part = q[:, top : top + 5, left : left + mask.shape[1]]
            part[:, mask[: part.shape[1], : part.shape[2]]] = lit
            out[k] = q
        return out

    return run


def timecode(frame: int, rate: float) -> str:
    """hours:minutes:seconds.frames of a frame."""
    seconds, rest = divmod(frame, max(1, round(rate)))
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest:02d}"
