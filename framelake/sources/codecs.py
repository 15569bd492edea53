"""Byte formats of images, audio and containers, both ways, in NumPy and the standard library."""

from __future__ import annotations

import struct
import uuid
import zlib
from typing import NamedTuple

import numpy as np


class FormatError(ValueError):
    pass


# --- images: arrays (height, width, 3) of uint8 in r, g, b -----------------

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _png_rows(image: np.ndarray) -> bytes:
    h = len(image)
    rows = np.zeros((h, 1 + image.shape[1] * image.shape[2]), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    return rows.tobytes()


def png_encode(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    return PNG_MAGIC + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(_png_rows(image))) + _png_chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters: none, left, up, mean of both, Paeth."""
    out = np.zeros_like(raw)
    above = np.zeros(raw.shape[1], np.int64)
    for y, (kind, row) in enumerate(zip(kinds, raw.astype(np.int64), strict=True)):
        if kind == 2:
            row = row + above
        elif kind in (1, 3, 4):
            row = row.copy()
            for x in range(len(row)):
                a = row[x - step] & 255 if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) >> 1
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (row[x] + add) & 255
        elif kind:
            raise FormatError("unknown PNG filter")
        above = row & 255
        out[y] = above
    return out


def png_decode(data: bytes) -> np.ndarray:
    """8-bit gray, colour, palette, with or without alpha (which is dropped); not interlaced."""
    if not data.startswith(PNG_MAGIC):
        raise FormatError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None:
        raise FormatError("no header")
    w, h, bits, color, _, _, laced = head
    if bits != 8 or laced or color not in (0, 2, 3, 4, 6):
        raise FormatError("only 8-bit PNGs that aren't interlaced are read")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    p = _unfilter(rows[:, 1:], rows[:, 0], step).reshape(h, w, step).astype(np.uint8)
    return palette[p[:, :, 0]] if color == 3 else np.repeat(p[:, :, :1], 3, axis=2) if step < 3 else p[:, :, :3]


def bmp_encode(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    body = dib_encode(image)
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + _dib_header(w, h, len(body)) + body


def _dib_header(w: int, h: int, size: int) -> bytes:
    return struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 0, 0, 0, 0)


def dib_encode(image: np.ndarray) -> bytes:
    """Bottom-up rows of b, g, r, each padded to four bytes."""
    h, w, _ = image.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, -1)
    return rows.tobytes()


def dib_decode(data: bytes, w: int, h: int, bits: int = 24, masks: tuple[int, int, int] | None = None) -> np.ndarray:
    """24- or 32-bit rows, or 16-bit ones with bit masks (5-5-5 by default); negative heights are top-down."""
    rows = abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows).reshape(rows, stride)[:, : w * bits // 8]
    if bits == 16:
        v = raw.copy().view("<u2").astype(np.int64)
        planes = []
        for m in masks or (0x7C00, 0x3E0, 0x1F):
            low = (m & -m).bit_length() - 1
            planes.append((v & m) >> low if m >> low == 255 else ((v & m) >> low) * 255 // (m >> low))
        image = np.stack(planes, axis=2).astype(np.uint8)
    elif bits in (24, 32):
        image = raw.reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        raise FormatError(f"{bits}-bit images aren't read")
    return image[::-1] if h > 0 else image


def bmp_decode(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise FormatError("not a BMP")
    offset = struct.unpack_from("<I", data, 10)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    masks = struct.unpack_from("<III", data, 54) if packing == 3 else None
    return dib_decode(data[offset:], w, h, bits, masks)


def tga_encode(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 24, 0) + image[::-1, :, ::-1].tobytes()


def tga_decode(data: bytes) -> np.ndarray:
    """True colour, 24 or 32 bits, plain or run-length coded."""
    skip, _, kind, _, _, _, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    step, at = bits // 8, 18 + skip
    if kind not in (2, 10) or step not in (3, 4):
        raise FormatError("only true-colour TGAs are read")
    if kind == 2:
        raw = data[at : at + w * h * step]
    else:
        out = bytearray()
        while len(out) < w * h * step:
            n = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1 : at + 1 + step] * n
                at += 1 + step
            else:
                out += data[at + 1 : at + 1 + n * step]
                at += 1 + n * step
        raw = bytes(out)
    image = np.frombuffer(raw, np.uint8).reshape(h, w, step)[:, :, 2::-1]
    return image if flags & 32 else image[::-1]


DECODERS = {"png": png_decode, "bmp": bmp_decode, "tga": tga_decode}
ENCODERS = {"png": png_encode, "bmp": bmp_encode, "tga": tga_encode}


W64_RIFF, W64_WAVE = (uuid.UUID(x).bytes_le for x in ("66666972-912e-11cf-a5d6-28db04c10000", "65766177-acf3-11d3-8cd1-00c04f8edb8a"))

#: Kinds of files with how sure their first (or last) bytes make it, from 0 to 1; the surest is taken.
SIGNS = {
    "png": lambda d: 1.0 * d.startswith(PNG_MAGIC),
    "jpg": lambda d: 0.9 * d.startswith(b"\xff\xd8\xff"),
    "bmp": lambda d: (0.8 if len(d) > 18 and d[14:18] in (b"\x28\0\0\0", b"\x6c\0\0\0", b"\x7c\0\0\0") else 0.3) * (d[:2] == b"BM"),
    "avi": lambda d: 1.0 * (d[:4] == b"RIFF" and d[8:12] == b"AVI "),
    "wav": lambda d: 1.0 * (d[:4] == b"RIFF" and d[8:12] == b"WAVE"),
    "w64": lambda d: 1.0 * (d[:16] == W64_RIFF and d[24:40] == W64_WAVE),
    "riff": lambda d: 0.2 * (d[:4] == b"RIFF"),
    "gif": lambda d: 1.0 * (d[:4] == b"GIF8"),
    "filmstrip": lambda d: 0.9 * (d[-36:-32] == b"Rand"),
}


def sniff(data: bytes) -> str:
    """What a file is, by its content."""
    sure, kind = max(((sign(data), kind) for kind, sign in SIGNS.items()), key=lambda x: x[0])
    return kind if sure > 0 else "unknown"


def gif_encode(frames: list[np.ndarray], delay: int = 10) -> bytes:
    """An endless animation; colours in a 6 x 6 x 6 cube, frames coded by LZW."""
    h, w, _ = frames[0].shape
    cube = np.array([[r, g, b] for r in range(6) for g in range(6) for b in range(6)] + [[0, 0, 0]] * 40, np.uint8)
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + (cube * 51).astype(np.uint8).tobytes())
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    for f in frames:
        six = (f.astype(np.int64) + 25) // 51
        codes = _lzw((six[:, :, 0] * 36 + six[:, :, 1] * 6 + six[:, :, 2]).reshape(-1).tolist(), 8)
        out += b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08"
        for i in range(0, len(codes), 255):
            part = codes[i : i + 255]
            out += bytes([len(part)]) + part
        out += b"\x00"
    return bytes(out + b"\x3b")


def _lzw(symbols: list[int], bits: int) -> bytes:
    clear, size, acc, held = 1 << bits, bits + 1, 0, 0
    out = bytearray()
    table: dict[tuple, int] = {}

    def put(code: int) -> None:
        nonlocal acc, held
        acc |= code << held
        held += size
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    put(clear)
    following, prefix = clear + 2, None
    for s in symbols:
        if prefix is None:
            prefix = s
        elif (prefix, s) in table:
            prefix = table[prefix, s]
        else:
            put(prefix)
            if following < 4096:
                table[prefix, s] = following
                if following == 1 << size and size < 12:
                    size += 1
                following += 1
            else:
                put(clear)
                table.clear()
                following, size = clear + 2, bits + 1
            prefix = s
    if prefix is not None:
        put(prefix)
    if following == 1 << size and size < 12:
        size += 1
    put(clear + 1)
    if held:
        out.append(acc & 255)
    return bytes(out)


def apng_encode(frames: list[np.ndarray], delay: int = 10) -> bytes:
    """An animated PNG; each frame after the first holds only the rectangle that changed."""
    h, w, _ = frames[0].shape
    out = PNG_MAGIC + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _png_chunk(b"acTL", struct.pack(">II", len(frames), 0))
    turn = 0
    for i, f in enumerate(frames):
        x0, y0, x1, y1 = 0, 0, w, h
        if i:
            changed = (f != frames[i - 1]).any(axis=2)
            ys, xs = np.flatnonzero(changed.any(axis=1)), np.flatnonzero(changed.any(axis=0))
            x0, y0, x1, y1 = (xs[0], ys[0], xs[-1] + 1, ys[-1] + 1) if len(ys) else (0, 0, 1, 1)
        out += _png_chunk(b"fcTL", struct.pack(">IIIIIHHBB", turn, x1 - x0, y1 - y0, x0, y0, delay, 100, 0, 0))
        turn += 1
        body = zlib.compress(_png_rows(f[y0:y1, x0:x1]))
        if i:
            out += _png_chunk(b"fdAT", struct.pack(">I", turn) + body)
            turn += 1
        else:
            out += _png_chunk(b"IDAT", body)
    return out + _png_chunk(b"IEND", b"")


# --- audio -----------------------------------------------------------------


class Wave(NamedTuple):
    rate: int
    channels: int
    bits: int
    samples: np.ndarray  # (samples, channels)


def wav_encode(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    n = samples.shape[1]
    body = samples.astype("<i2" if bits == 16 else np.uint8).tobytes()
    head = struct.pack("<HHIIHH", 1, n, rate, rate * n * bits // 8, n * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def riff_chunks(data: bytes, at: int, end: int):
    """(id, first byte, size) of the chunks in a range; a chunk that is cut off ends there."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def _w64_chunks(data: bytes):
    """(first four bytes of the id, first byte, size) of a Wave64 file's chunks, which lie at multiples of eight."""
    at = 40
    while at + 24 <= len(data):
        (size,) = struct.unpack_from("<Q", data, at + 16)
        if size < 24:
            return
        yield data[at : at + 4], at + 24, min(size - 24, len(data) - at - 24)
        at += (size + 7) // 8 * 8


def w64_encode(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """The same sound as `wav_encode` writes, with 64-bit sizes."""
    plain = wav_encode(samples, rate, bits)
    tail = bytes.fromhex("f3acd3118cd100c04f8edb8a")  # of the ids of chunks
    part = lambda name, body: name + tail + struct.pack("<Q", 24 + len(body)) + body + b"\0" * (-len(body) % 8)
    body = W64_WAVE + part(b"fmt ", plain[20:36]) + part(b"data", plain[44:])
    return W64_RIFF + struct.pack("<Q", 24 + len(body)) + body


def wav_decode(data: bytes) -> Wave:
    """8- or 16-bit PCM of a WAV or Wave64 file."""
    long = data[:16] == W64_RIFF and data[24:40] == W64_WAVE
    if not long and (data[:4] != b"RIFF" or data[8:12] != b"WAVE"):
        raise FormatError("not a WAV")
    form = body = None
    for kind, at, size in _w64_chunks(data) if long else riff_chunks(data, 12, len(data)):
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at)
        elif kind == b"data":
            body = data[at : at + size]
    if form is None or body is None or form[0] != 1 or form[5] not in (8, 16):
        raise FormatError("only 8- and 16-bit PCM is read")
    _, channels, rate, _, _, bits = form
    flat = np.frombuffer(body[: len(body) // (channels * bits // 8) * (channels * bits // 8)], "<i2" if bits == 16 else np.uint8)
    return Wave(rate, channels, bits, flat.astype(np.int32).reshape(-1, channels))


# --- containers ------------------------------------------------------------

FLM_TRAILER = ">4siHHHHHH16s"


def filmstrip_encode(frames: list[np.ndarray], rate: int = 30) -> bytes:
    h, w, _ = frames[0].shape
    body = b"".join(np.concatenate((f, np.full((h, w, 1), 255, np.uint8)), axis=2).tobytes() for f in frames)
    return body + struct.pack(FLM_TRAILER, b"Rand", len(frames), 0, 0, w, h, 0, rate, b"")


def filmstrip_decode(data: bytes) -> list[np.ndarray]:
    mark, n, _, _, w, h, lead, _, _ = struct.unpack_from(FLM_TRAILER, data, len(data) - 36)
    if mark != b"Rand":
        raise FormatError("not a filmstrip")
    step = w * (h + lead) * 4
    return [np.frombuffer(data, np.uint8, w * h * 4, i * step).reshape(h, w, 4)[:, :, :3] for i in range(n)]


class Chunk(NamedTuple):
    stream: int
    offset: int
    size: int
    is_key: bool


class Avi(NamedTuple):
    rate: tuple[int, int]
    width: int
    height: int
    bits: int
    audio: tuple[int, int, int] | None  # rate, channels, bits
    chunks: list[Chunk]
    codec: bytes = b"\0\0\0\0"


def _list(kind: bytes, body: bytes) -> bytes:
    return _riff(b"LIST", kind + body)


def _riff(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_encode(frames: list[np.ndarray], rate: tuple[int, int] = (30, 1), keys: list[bool] | None = None, audio: Wave | None = None, riff_frames: int | None = None, codec: bytes = b"DIB ") -> bytes:
    """Frames, uncompressed or by codec MJPG or YUY2, each followed by its share of the audio, and an index.

    With more than riff_frames frames the file goes on in further RIFF parts, each
    with an index of its chunks per stream, all of them named in the header.
    """
    h, w, _ = frames[0].shape
    encode = _frame_encoder(codec)
    size = len(encode(frames[0]))
    per = riff_frames or len(frames)
    parts = [_avi_part(frames, lo, min(len(frames), lo + per), rate, keys, audio, encode) for lo in range(0, len(frames), per)]
    several = len(parts) > 1
    main = struct.pack("<14I", 10**6 * rate[1] // rate[0], size * rate[0] // rate[1], 0, 0x10, min(per, len(frames)), 0, 1 + (audio is not None), size, w, h, 0, 0, 0, 0)
    video = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", codec, 0, 0, 0, 0, rate[1], rate[0], 0, len(frames), size, -1, 0, 0, 0, w, h)
    form = _dib_header(w, h, size)
    if codec != b"DIB ":
        form = form[:14] + struct.pack("<H", 16 if codec == b"YUY2" else 24) + codec + form[20:]
    heads = [_riff(b"strh", video) + _riff(b"strf", form)]
    if audio is not None:
        block = audio.channels * audio.bits // 8
        head = struct.pack("<4s4sIHHIIIIIIiI4H", b"auds", b"\0\0\0\0", 0, 0, 0, 0, block, audio.rate * block, 0, len(audio.samples), audio.rate * block, -1, block, 0, 0, 0, 0)
        form = struct.pack("<HHIIHHH", 1, audio.channels, audio.rate, audio.rate * block, block, audio.bits, 0)
        heads.append(_riff(b"strh", head) + _riff(b"strf", form))

    def header(places: list[list[tuple[int, int, int]]]) -> bytes:
        """Stream headers; places: for each stream the offset, size and number of chunks of each part's index."""
        lists = []
        for i, head in enumerate(heads):
            super_index = struct.pack("<HBBI4s12x", 4, 0, 0, len(parts), f"{i:02d}{'wb' if i else 'db'}".encode())
            super_index += b"".join(struct.pack("<QII", *p) for p in places[i])
            lists.append(_list(b"strl", head + (_riff(b"indx", super_index) if several else b"")))
        more = _list(b"odml", _riff(b"dmlh", struct.pack("<I", len(frames)))) if several else b""
        return _list(b"hdrl", _riff(b"avih", main) + b"".join(lists) + more)

    places = [[(0, 0, 0)] * len(parts) for _ in heads]
    at = 12 + len(header(places))
    bodies = []
    for k, (movi, index) in enumerate(parts):
        base = at + 8  # of the list's kind, from which chunks are counted
        indexes = b""
        for i in range(len(heads) if several else 0):
            own = [e for e in index if int(e[0][:2]) == i]
            entries = b"".join(struct.pack("<II", place + 8, n | (0 if key else 1 << 31)) for _, place, n, key in own)
            chunk = _riff(f"ix{i:02d}".encode(), struct.pack("<HBBI4sQI", 2, 0, 1, len(own), own[0][0] if own else b"", base, 0) + entries)
            places[i][k] = base + 4 + len(movi) + len(indexes), len(chunk), len(own)
            indexes += chunk
        body = _list(b"movi", movi + indexes)
        if k == 0:
            body += _riff(b"idx1", b"".join(kind + struct.pack("<III", 0x10 if key else 0, place, n) for kind, place, n, key in index))
        bodies.append(body)
        at += len(body) + 12  # the next part's own head
    first = _riff(b"RIFF", b"AVI " + header(places) + bodies[0])
    return first + b"".join(_riff(b"RIFF", b"AVIX" + b) for b in bodies[1:])


def _frame_encoder(codec: bytes):
    if codec == b"MJPG":
        from framelake.sources import jpeg

        return lambda f: jpeg.encode(f, 0)
    if codec == b"YUY2":
        from framelake.sources import yuv

        return lambda f: yuv.pack(*yuv.from_rgb(f), "yuy2")
    return dib_encode


def _avi_part(frames: list[np.ndarray], lo: int, hi: int, rate: tuple[int, int], keys: list[bool] | None, audio: Wave | None, encode) -> tuple[bytes, list[tuple[bytes, int, int, bool]]]:
    """The chunks of frames [lo, hi) with their audio, and (kind, place, size, is_key) of each, counted from the list's kind."""
    movi, index = [], []
    at = 4

    def put(kind: bytes, body: bytes, key: bool) -> None:
        nonlocal at
        index.append((kind, at, len(body), key))
        movi.append(_riff(kind, body))
        at += len(movi[-1])

    for i in range(lo, hi):
        put(b"00db", encode(frames[i]), keys[i] if keys else True)
        if audio is not None:
            upto = lambda k: min(len(audio.samples), -(-k * audio.rate * rate[1] // rate[0]))
            part = audio.samples[upto(i) : upto(i + 1) if i + 1 < len(frames) else len(audio.samples)]
            put(b"01wb", part.astype("<i2" if audio.bits == 16 else np.uint8).tobytes(), True)
    return b"".join(movi), index


def _avi_riffs(data: bytes):
    """(start, end) of what is in each RIFF part; a part whose size makes no sense takes the rest."""
    at = 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        (size,) = struct.unpack_from("<I", data, at + 4)
        end = at + 8 + size if 4 < size <= len(data) - at - 8 else len(data)
        if data[end + end % 2 :][:4] not in (b"RIFF", b"") and data[end + end % 2 + 8 :][:4] != b"AVIX":
            end = len(data)
        yield at + 12, end
        at = end + end % 2


def _part_chunks(data: bytes, movi: tuple[int, int], index: bytes, rebuild: bool) -> list[Chunk]:
    """The chunks of a part: by its index, by the indexes within it, or as they lie there."""
    chunks: list[Chunk] = []
    if index and not rebuild:
        for i in range(0, len(index) - 15, 16):
            kind, flags, offset, size = struct.unpack_from("<4sIII", index, i)
            place = movi[0] + offset
            if data[place : place + 4] != kind:
                return _part_chunks(data, movi, b"", True)
            chunks.append(Chunk(int(kind[:2]), place + 8, size, bool(flags & 0x10)))
        return chunks
    found = list(riff_chunks(data, movi[0] + 4, movi[1]))
    for kind, at, size in found if not rebuild else ():
        if kind[:2] == b"ix" and size >= 24:
            words, _, what, n, name, base, _ = struct.unpack_from("<HBBI4sQI", data, at)
            for k in range(n if (words, what) == (2, 1) and size >= 24 + 8 * n else 0):
                place, length = struct.unpack_from("<II", data, at + 24 + 8 * k)
                if data[base + place - 8 : base + place - 4] != name:
                    return _part_chunks(data, movi, b"", True)
                chunks.append(Chunk(int(name[:2]), base + place, length & 0x7FFFFFFF, not length >> 31))
    return sorted(chunks, key=lambda c: c.offset) or [Chunk(int(k[:2]), at, size, True) for k, at, size in found if k[:2].isdigit()]


def avi_parse(data: bytes, rebuild: bool = False) -> Avi:
    """Header and chunk index of all RIFF parts; where an index is missing or damaged, or rebuild is set, the chunks themselves are walked."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise FormatError("not an AVI")
    rate, width, height, bits, audio, codec = (30, 1), 0, 0, 24, None, b"\0\0\0\0"
    chunks: list[Chunk] = []
    for start, end in _avi_riffs(data):
        movi, index = (0, 0), b""
        for kind, at, size in riff_chunks(data, start, end):
            what = data[at : at + 4]
            if kind == b"LIST" and what == b"hdrl":
                for k, a, s in riff_chunks(data, at + 4, at + size):
                    if k == b"LIST" and data[a : a + 4] == b"strl":
                        parts = {x: (y, z) for x, y, z in riff_chunks(data, a + 4, a + s)}
                        head, form = parts[b"strh"][0], parts[b"strf"][0]
                        if data[head : head + 4] == b"vids":
                            scale, hz = struct.unpack_from("<II", data, head + 20)
                            rate = (hz, scale)
                            width, height, _, bits = struct.unpack_from("<iiHH", data, form + 4)
                            codec = data[form + 16 : form + 20]
                        elif data[head : head + 4] == b"auds":
                            _, channels, hz, _, _, depth = struct.unpack_from("<HHIIHH", data, form)
                            audio = (hz, channels, depth)
            elif kind == b"LIST" and what == b"movi":
                movi = (at, at + size)
            elif kind == b"idx1":
                index = data[at : at + size]
        if movi[1]:
            chunks += _part_chunks(data, movi, index, rebuild)
    return Avi(rate, width, height, bits, audio, chunks, codec)


def avi_frame(data: bytes, avi: Avi, chunk: Chunk) -> np.ndarray:
    """A frame: uncompressed, Motion JPEG or packed YCbCr; of other codecs none is read."""
    raw = data[chunk.offset : chunk.offset + chunk.size]
    name = avi.codec.lower()
    if name in (b"mjpg", b"jpeg"):
        from framelake.sources import jpeg

        return jpeg.decode(raw)
    if name in (b"yuy2", b"uyvy", b"yv12", b"i420"):
        from framelake.sources import yuv

        return yuv.to_rgb(*yuv.unpack(raw, name.decode(), avi.width, abs(avi.height)))
    if name.strip(b"\0") not in (b"", b"dib ", b"rgb "):
        raise FormatError(f"{avi.codec!r} is of no known codec")
    return dib_decode(raw, avi.width, avi.height, avi.bits)
