"""Vectorised word arithmetic on Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those
bytes never occur inside a longer character, so words can be cut from bytes.

Words and runs of words are named by polynomials modulo the prime 2**61 - 1 at
bases that a run draws at random. No text can be written so that it collides: of
texts fixed before the draw, two that differ in n blocks of seven bytes agree
with a probability of at most (n + 1) / 2**61, and where 64 bits are too few, two
polynomials at independent bases are taken together.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that part words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Folds A-Z to a-z and leaves all other bytes alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PRIME = (1 << 61) - 1
#: Rows of arithmetic at once: few enough for the processor's cache.
_BLOCK = 1 << 16
#: Words of more bytes than this are hashed one by one.
_LONG = 256
_POWERS: dict[int, np.ndarray] = {}


class Bases(NamedTuple):
    """Where the polynomials are evaluated: those of words' bytes and those of runs of words."""

    word: int
    run: int


def draw() -> Bases:
    """Bases for one run; drawn on the driver, so that all tasks and their repetitions agree."""
    return Bases(*((1 << 32) + secrets.randbelow(PRIME - (1 << 33)) for _ in range(2)))


#: Bases of hashes that models are fitted on, where a collision merges two features.
FIXED = Bases(0x1E3779B97F4A7C15, 0x16E8FEB86659FD93)


class Words(NamedTuple):
    data: np.ndarray  # uint8, the texts one after another
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per document, the index of its first word; one more at the end

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its tasks, and its executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def cut_words(data: np.ndarray, offs: np.ndarray) -> Words:
    solid = ~SPACES[data]
    n = len(data)
    inner = offs[(offs > 0) & (offs < n)]
    before = np.empty(n, bool)
    before[1:] = ~solid[:-1]
    before[:1] = True
    before[inner] = True
    starts = np.flatnonzero(solid & before)
    after = np.empty(n, bool)
    after[:-1] = ~solid[1:]
    after[-1:] = True
    after[inner - 1] = True
    ends = np.flatnonzero(solid & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    a0, a1, b0, b1 = a & U64(0xFFFFFFFF), a >> U64(32), b & U64(0xFFFFFFFF), b >> U64(32)
    low, mid = a0 * b0, a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << U64(3)) + (mid >> U64(29)) + ((mid & U64((1 << 29) - 1)) << U64(32)) + (low >> U64(61)) + (low & U64(PRIME)))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n modulo PRIME, at least."""
    found = _POWERS.get(base, np.ones(1, U64))
    if len(found) <= n:
        while len(found) <= max(n, 2 * _BLOCK):
            found = np.concatenate((found, _times(found, np.full(1, pow(base, len(found), PRIME), U64))))
        if len(_POWERS) > 16:  # a worker outlives the runs whose bases it has seen
            _POWERS.clear()
        _POWERS[base] = found
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _bytes_left(sizes: np.ndarray, begin: int, width: int) -> np.ndarray:
    """A mask of the bytes of a lane of `width` bytes from `begin` on that belong to words of these sizes."""
    return (U64(1) << (U64(8) * np.clip(sizes - begin, 0, width).astype(U64))) - U64(1)


def word_hashes(words: Words, base: int) -> np.ndarray:
    """A number below PRIME for each word: its length and its bytes, seven at a time, as a polynomial at `base`."""
    lanes = _lanes(words.data)
    out = np.empty(len(words.starts), U64)
    key, r = base.to_bytes(8, "little"), np.full(1, base, U64)
    for lo in range(0, len(out), _BLOCK):
        starts = words.starts[lo : lo + _BLOCK]
        sizes = words.ends[lo : lo + _BLOCK] - starts
        h = sizes.astype(U64)
        long = np.flatnonzero(sizes > _LONG)
        live, begin = np.flatnonzero(sizes <= _LONG), 0
        while len(live):
            lane = lanes[starts[live] + begin] & _bytes_left(sizes[live], begin, 7)
            h[live] = _reduced(_times(h[live], r) + lane)
            begin += 7
            live = live[sizes[live] > begin]
        for i in long:  # by a keyed cryptographic hash
            raw = hashlib.blake2b(words.data[starts[i] : starts[i] + sizes[i]], digest_size=8, key=key).digest()
            h[i] = int.from_bytes(raw, "little") % PRIME
        out[lo : lo + _BLOCK] = h
    return out


def same_words(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a_starts on in a are those from b_starts on in b, for sizes bytes each."""
    same = np.ones(len(sizes), bool)
    a_lanes, b_lanes = _lanes(a), _lanes(b)
    for i in np.flatnonzero(sizes > _LONG):
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + sizes[i]], b[b_starts[i] : b_starts[i] + sizes[i]])
    live, begin = np.flatnonzero(sizes <= _LONG), 0
    while len(live):
        differ = (a_lanes[a_starts[live] + begin] ^ b_lanes[b_starts[live] + begin]) & _bytes_left(sizes[live], begin, 7)
        same[live[differ != 0]] = False
        begin += 7
        live = live[(sizes[live] > begin) & same[live]]
    return same


def runs_of(hashes: np.ndarray, first: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all runs of `size` consecutive words (numbers below PRIME) within a document, and the index of each run's first word."""
    n = len(hashes)
    begins = np.ones(n, bool)
    for back in range(1, size):
        stop = first[1:] - back
        begins[stop[(stop >= first[:-1]) & (stop < n)]] = False
    at = np.flatnonzero(begins)
    at = at[at + size <= n]
    out = np.empty(len(at), U64)
    inverse = pow(base, -1, PRIME)
    for lo in range(0, len(at), _BLOCK):
        begin = at[lo : lo + _BLOCK]
        part = hashes[begin[0] : begin[-1] + size]
        terms = _times(part, _powers(base, len(part))[: len(part)])
        s = begin - begin[0]
        sums = []
        for half in (terms & U64(0xFFFFFFFF), terms >> U64(32)):
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(half, dtype=U64, out=total[1:])
            sums.append(total[s + size] - total[s])
        low, high = sums
        value = _reduced((high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32)) + low)
        out[lo : lo + _BLOCK] = mix(_times(value, _powers(inverse, len(part))[s]))
    return out, at


def whole_text_keys(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """64-bit keys of rows of k words each, apart from those of runs of another number of words."""
    value = np.zeros(len(hashes), U64)
    for column in hashes.T:
        value = _reduced(_times(value, np.full(1, base, U64)) + column)
    return mix(value) ^ mix(np.full(1, k, U64))


def doc_of(positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The document of each word index."""
    return np.searchsorted(first, positions, "right") - 1


def join_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes and offsets."""
    kept = np.flatnonzero(keep)
    starts, sizes = words.starts[kept], words.ends[kept] - words.starts[kept]
    doc = doc_of(kept, words.first)
    last = np.ones(len(kept), bool)
    last[:-1] = doc[1:] != doc[:-1]
    room = sizes + ~last
    ends = np.cumsum(room)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total, dtype=np.int64) - np.repeat(ends - room - starts, room)
    out = words.data[np.minimum(source, max(len(words.data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[(ends - 1)[~last]] = 0x20
    per_doc = np.bincount(doc, weights=room, minlength=len(words.first) - 1).astype(np.int64) if len(kept) else np.zeros(len(words.first) - 1, np.int64)
    return out, np.concatenate(([0], np.cumsum(per_doc)))


def to_strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
