"""Baseline JPEG images, as files and as the frames of Motion JPEG.

Blocks are gathered while the bit stream is read; dequantisation, transform,
upsampling and colour run on all of them at once in NumPy. Images that are
written define their own Huffman tables, in which all codes are of one length.
"""

from __future__ import annotations

import struct

import numpy as np

from framelake.sources.codecs import FormatError

#: Natural position of each coefficient of the scan: diagonals, alternately up and down.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.125**0.5 if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: (run, size) symbols of the table that images are written with: any run of zeros before a value, the end, sixteen zeros.
_AC = [0x00, 0xF0, *((run << 4) | size for run in range(16) for size in range(1, 11))]
_DC = list(range(12))


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead, the symbol that they begin with and its length; 0 for none."""
    what, long = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            lo, hi = code << (16 - size), (code + 1) << (16 - size)
            what[lo:hi], long[lo:hi] = symbols[k], size
            code, k = code + 1, k + 1
        code <<= 1
    return what, long


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left, self.data, self.at = 0, 0, data, 0

    def ahead(self, n: int) -> int:
        while self.left < n:
            chunk = self.data[self.at : self.at + 32]
            self.at += 32
            self.value = (self.value << 256) | int.from_bytes(chunk.ljust(32, b"\xff"), "big")
            self.left += 256
        return (self.value >> (self.left - n)) & ((1 << n) - 1)

    def drop(self, n: int) -> None:
        self.left -= n
        self.value &= (1 << self.left) - 1

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        look = self.ahead(16)
        size = int(table[1][look])
        if not size:
            raise FormatError("a code that no table has")
        self.drop(size)
        return int(table[0][look])

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.ahead(size)
        self.drop(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) of a baseline image with one or three components; others raise FormatError."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("not a JPEG")
    quant: dict[int, np.ndarray] = {}
    huffman: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    parts, restart, at = [], 0, 2
    width = height = 0
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if data[at : at + 1] != b"\xff":
            raise FormatError("no marker where one belongs")
        mark = data[at + 1]
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise FormatError("only 8-bit images of one or three components are read")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
            raise FormatError("only baseline images are read")
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif mark == 0xDA:
            if not parts or body[0] != len(parts):
                raise FormatError("components come in several scans")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif mark == 0xD9:
            raise FormatError("an image without a scan")
    tables = []
    for name, _, _, q in parts:
        t = chosen.get(name, 0)
        if t >> 4 not in huffman or 0x10 | (t & 15) not in huffman or q not in quant:
            raise FormatError("a table is missing")
        tables.append((huffman[t >> 4], huffman[0x10 | (t & 15)], quant[q]))
    return _picture(_scan(data[at:], parts, tables, width, height, restart), parts, tables, width, height)


def _runs(data: bytes) -> list[bytes]:
    """The scan's bytes between restarts, without stuffing, up to the next marker."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            break
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            at += 2
            start = at
        else:
            out.append(data[start:at])
            break
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _scan(data: bytes, parts: list, tables: list, width: int, height: int, restart: int) -> list[np.ndarray]:
    """Coefficients (rows of blocks, blocks, 64) of each component, in scan order within a block."""
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    one = len(parts) == 1  # a single component isn't interleaved
    across, down = (-(-width // 8), -(-height // 8)) if one else (-(-width // (8 * most_h)), -(-height // (8 * most_v)))
    steps = [(1, 1)] if one else [(p[1], p[2]) for p in parts]
    planes = [np.zeros((down * v, across * h, 64), np.int64) for h, v in steps]
    runs = iter(_runs(data))
    bits, last = _Bits(next(runs)), [0] * len(parts)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            bits, last = _Bits(next(runs, b"")), [0] * len(parts)
        row, column = divmod(unit, across)
        for c, (h, v) in enumerate(steps):
            dc, ac, _ = tables[c]
            for y in range(v):
                for x in range(h):
                    block = planes[c][row * v + y, column * h + x]
                    last[c] += bits.signed(bits.symbol(dc))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            if k > 63:
                                raise FormatError("more values than a block has")
                            block[k] = bits.signed(s & 15)
                        k += 1
    return planes


def _picture(planes: list[np.ndarray], parts: list, tables: list, width: int, height: int) -> np.ndarray:
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    full = []
    for plane, (_, h, v, _), (_, _, q) in zip(planes, parts, tables, strict=True):
        natural = np.zeros(plane.shape)
        natural[..., ZIGZAG] = plane * q
        blocks = np.einsum("uy,rcuv,vx->rycx", _BASIS, natural.reshape(*plane.shape[:2], 8, 8), _BASIS)
        samples = np.clip(np.floor(blocks.reshape(8 * plane.shape[0], 8 * plane.shape[1]) + 128.5), 0, 255)
        if len(parts) > 1:
            samples = samples.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)
        full.append(samples[:height, :width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


def encode(image: np.ndarray, step: int = 1) -> bytes:
    """A baseline image without subsampling; coefficients are divided by 1 + step * (u + v) / 4, so that 0 keeps all but rounding."""
    h, w, _ = image.shape
    r, g, b = (image[:, :, i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    q = np.array([1 + step * (i // 8 + i % 8) // 4 for i in range(64)])
    down, across = -(-h // 8), -(-w // 8)
    coded = []
    for p in planes:
        padded = np.pad(p, ((0, 8 * down - h), (0, 8 * across - w)), "edge") - 128
        blocks = np.einsum("uy,rycx,vx->rcuv", _BASIS, padded.reshape(down, 8, across, 8), _BASIS).reshape(down * across, 64)
        coded.append(np.floor(blocks / q + 0.5).astype(np.int64)[:, ZIGZAG])
    dc_code, ac_code = {s: i for i, s in enumerate(_DC)}, {s: i for i, s in enumerate(_AC)}
    bits: list[str] = []

    def put(v: int) -> str:
        size = int(abs(v)).bit_length()
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    last = [0, 0, 0]
    for i in range(down * across):
        for c in range(3):
            block = coded[c][i].tolist()
            delta, last[c] = block[0] - last[c], block[0]
            bits.append(format(dc_code[abs(delta).bit_length()], "04b") + put(delta))
            run = 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    bits.append(format(ac_code[0xF0], "08b"))
                    run -= 16
                bits.append(format(ac_code[run << 4 | abs(block[k]).bit_length()], "08b") + put(block[k]))
                run = 0
            if run:
                bits.append(format(ac_code[0], "08b"))
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""

    def part(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, 2 + len(body)) + body

    lengths = lambda size, n: bytes(n if i + 1 == size else 0 for i in range(16))
    return b"".join((
        b"\xff\xd8",
        part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        part(0xDB, b"\0" + bytes(q[ZIGZAG].tolist())),
        part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        part(0xC4, b"\0" + lengths(4, len(_DC)) + bytes(_DC) + b"\x10" + lengths(8, len(_AC)) + bytes(_AC)),
        part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        scan,
        b"\xff\xd9",
    ))
