"""Frames of raw video in packed and planar YCbCr formats, to and from 8-bit planes.

A format says how many pixels share a chroma sample each way and how samples lie:
packed formats name the order of a pair's bytes, planar ones the order of planes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from framelake.operators.point import INVERSE, ycbcr_matrix
from framelake.sources.codecs import FormatError


class Layout(NamedTuple):
    across: int  # pixels of a chroma sample
    down: int
    order: str  # of a pair's bytes (packed), of planes (planar), or luma with pairs of chroma


#: Fixed layouts: y luma, u cb, v cr.
LAYOUTS = {
    "yuy2": Layout(2, 1, "yuyv"),
    "uyvy": Layout(2, 1, "uyvy"),
    "yv12": Layout(2, 2, "y v u"),
    "i420": Layout(2, 2, "y u v"),
    "yv16": Layout(2, 1, "y v u"),
    "yv24": Layout(1, 1, "y v u"),
    "yvu9": Layout(4, 4, "y v u"),
    "nv12": Layout(2, 2, "y uv"),
    "y8": Layout(1, 1, "y"),
}


def frame_bytes(kind: str, w: int, h: int) -> int:
    layout = LAYOUTS[kind]
    if w % layout.across or h % layout.down:
        raise FormatError(f"{kind} has frames of whole chroma samples")
    return w * h if layout.order == "y" else w * h + 2 * (w // layout.across) * (h // layout.down)


def unpack(data: bytes, kind: str, w: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma, cb and cr of a frame, chroma repeated to full size; y8 has none, which is 128."""
    layout = LAYOUTS[kind]
    raw = np.frombuffer(data, np.uint8, frame_bytes(kind, w, h)).astype(np.int64)
    size = (h // layout.down, w // layout.across)
    if set(layout.order) == set("yuv"):
        pairs = raw.reshape(h, w // 2, 4)
        at = {c: [i for i, x in enumerate(layout.order) if x == c] for c in "yuv"}
        y, u, v = pairs[:, :, at["y"]].reshape(h, w), pairs[:, :, at["u"][0]], pairs[:, :, at["v"][0]]
    elif layout.order == "y":
        return raw.reshape(h, w), np.full((h, w), 128), np.full((h, w), 128)
    else:
        y, rest = raw[: w * h].reshape(h, w), raw[w * h :]
        if layout.order == "y uv":
            u, v = rest[::2].reshape(size), rest[1::2].reshape(size)
        else:
            first, second = rest.reshape(2, *size)
            u, v = (first, second) if layout.order == "y u v" else (second, first)
    return (y, *(c.repeat(layout.down, axis=0).repeat(layout.across, axis=1) for c in (u, v)))


def pack(y: np.ndarray, u: np.ndarray, v: np.ndarray, kind: str) -> bytes:
    """A frame's bytes; chroma of full size is averaged, halves up."""
    layout = LAYOUTS[kind]
    h, w = y.shape
    frame_bytes(kind, w, h)
    area = layout.across * layout.down
    mean = lambda c: (c.reshape(h // layout.down, layout.down, w // layout.across, layout.across).sum(axis=(1, 3)) + area // 2) // area
    if layout.order == "y":
        return y.astype(np.uint8).tobytes()
    u, v = mean(u), mean(v)
    if set(layout.order) == set("yuv"):
        lumas = iter((y[:, ::2], y[:, 1::2]))
        parts = [next(lumas) if c == "y" else u if c == "u" else v for c in layout.order]
        return np.stack(parts, axis=2).astype(np.uint8).tobytes()
    if layout.order == "y uv":
        return y.astype(np.uint8).tobytes() + np.stack((u, v), axis=2).astype(np.uint8).tobytes()
    planes = (u, v) if layout.order == "y u v" else (v, u)
    return y.astype(np.uint8).tobytes() + b"".join(p.astype(np.uint8).tobytes() for p in planes)


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, standard: str = "601", full: bool = False) -> np.ndarray:
    """(height, width, 3) by the same fixed-point matrix as the column expressions."""
    ky, rv, gv, gu, bu = INVERSE[standard, full]
    base = ky * (y - (0 if full else 16)) + 0x8000
    planes = (base + rv * (v - 128), base + gv * (v - 128) + gu * (u - 128), base + bu * (u - 128))
    return np.clip(np.stack(planes, axis=2) >> 16, 0, 255).astype(np.uint8)


def from_rgb(image: np.ndarray, standard: str = "601", full: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, offsets = ycbcr_matrix(standard, full)
    p = image.astype(np.int64)
    return tuple(np.clip(p @ np.array(row) + o >> 16, 0, 255) for row, o in zip(rows, offsets, strict=True))
