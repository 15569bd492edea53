"""A count-min sketch that is partitioned by cell range and kept sparse.

A dense sketch per task doesn't scale: its width has to follow the number of
distinct keys, and every task would send all of it. Here each chunk of
documents sends, for each sketch row and range of cells, only the cells that
it touched (sorted, as differences, about two bytes each). One task adds up a
range of all chunks and answers each chunk with the level of its own cells.
Neither a task nor the driver ever holds the whole sketch, nothing is broadcast,
and the width grows with the input, so that collisions stay as rare as before.

Levels are bit lengths of the summed counts: 1 for one, 2 for two or three, and
so on. A cell's sum is never below the count of a key in it, so the least level
over the rows never underestimates.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from framelake.llm.textops import U64, give_back, mix

#: Offsets that make the rows' cells of one key independent.
ROW_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
SENT = "slot int, chunk long, payload binary"
ANSWERED = "chunk long, slot int, payload binary"


#: Input bytes up to which chunks and ranges have their least size.
SCALE_BYTES = 500_000_000
#: A range's counts stop here.
MOST = (1 << 16) - 1


class SketchPlan(NamedTuple):
    depth: int
    ranges: int
    width: int  # cells of a range


def scale_of(input_bytes: int, executor_bytes: int) -> int:
    """How many times their least size chunks and ranges have.

    A chunk sends one message to each range, so with sizes that stay, messages
    would grow with the square of the input. Both sizes grow with its root, and
    messages with the input, until a worker's memory (about 35 MB for each unit)
    is at its bound; at 32, a message at 100 TB still carries thirty cells.
    """
    return int(max(1, min(32, executor_bytes // 200_000_000, (input_bytes / SCALE_BYTES) ** 0.5)))


def plan_sketch(keys: int, depth: int = 2, scale: int = 1, room: int = 5, range_keys: int = 1_500_000) -> SketchPlan:
    """Width: `room` cells for each key expected, in ranges of about range_keys * scale keys."""
    ranges = max(1, -(-keys // (range_keys * scale)))
    return SketchPlan(depth, ranges, min(max(1 << 12, room * -(-keys // ranges)), 1 << 31))


def messages(plan: SketchPlan, chunks: int) -> int:
    """How many rows of SENT there are at most."""
    return plan.depth * plan.ranges * chunks


class _Cells(NamedTuple):
    order: np.ndarray  # of the keys, by cell
    head: np.ndarray  # where a new cell begins, in that order
    cells: np.ndarray  # distinct, ascending
    edges: np.ndarray  # of the ranges, in cells


def _cells(keys: np.ndarray, plan: SketchPlan, row: int) -> _Cells:
    h = mix(keys ^ U64(ROW_SEEDS[row]))
    # The upper half names the range, the lower half the place in it.
    cell = (((h >> U64(32)) * U64(plan.ranges)) >> U64(32)) * U64(plan.width) + (((h & U64(0xFFFFFFFF)) * U64(plan.width)) >> U64(32))
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    head = np.flatnonzero(new)
    cells = cell[head]
    return _Cells(order, head, cells, np.searchsorted(cells, np.arange(plan.ranges + 1).astype(U64) * U64(plan.width)))


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """A message: cells as places in their range, ascending, as differences."""
    gaps = np.diff(cells)
    kind = np.uint16 if gaps.max(initial=0) < 1 << 16 else np.uint32
    more = np.flatnonzero(counts > 1).astype(np.uint32)
    head = np.array([len(cells), len(more), np.dtype(kind).itemsize, int(cells[0])], np.uint32)
    return head.tobytes() + gaps.astype(kind).tobytes() + more.tobytes() + np.minimum(counts[more], 255).astype(np.uint8).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, size, start = (int(x) for x in np.frombuffer(raw, np.uint32, 4))
    cells = np.empty(n, np.int64)
    cells[0] = start
    cells[1:] = np.frombuffer(raw, np.uint16 if size == 2 else np.uint32, n - 1, 16)
    np.cumsum(cells, out=cells)
    counts = np.ones(n, np.int64)
    at = 16 + size * (n - 1)
    counts[np.frombuffer(raw, np.uint32, m, at)] = np.frombuffer(raw, np.uint8, m, at + 4 * m)
    return cells, counts


def send(chunk: int, keys: np.ndarray, counts: np.ndarray, plan: SketchPlan) -> pa.Table:
    """Rows of SENT for a chunk's distinct keys and their counts."""
    slots, payloads = [], []
    for row in range(plan.depth if len(keys) else 0):
        c = _cells(keys, plan, row)
        sums = np.add.reduceat(counts[c.order], c.head)
        for r in np.flatnonzero(np.diff(c.edges)):
            lo, hi = c.edges[r], c.edges[r + 1]
            slots.append(row * plan.ranges + int(r))
            payloads.append(_pack(c.cells[lo:hi] - U64(int(r) * plan.width), sums[lo:hi]))
    return pa.table({"slot": pa.array(slots, pa.int32()), "chunk": pa.array([chunk] * len(slots), pa.int64()), "payload": pa.array(payloads, pa.binary())})


def merge(table: pa.Table, width: int) -> pa.Table:
    """All chunks' rows of one slot to rows of ANSWERED: the level of each cell sent, in the order sent.

    The range's counts are one array of two bytes a cell; messages are read one
    after another, so memory doesn't follow their number.
    """
    give_back()
    total = np.zeros(width, np.uint16)
    payloads = table.column("payload")
    for raw in payloads:
        cells, counts = _unpack(raw.as_py())  # distinct, so each is added to once
        total[cells] = np.minimum(total[cells] + counts, MOST)
    level_of = np.frexp(np.arange(MOST + 1, dtype=np.float32))[1].astype(np.uint8)
    answers = [zlib.compress(level_of[total[_unpack(raw.as_py())[0]]].tobytes(), 1) for raw in payloads]
    return pa.table({"chunk": table.column("chunk"), "slot": table.column("slot"), "payload": pa.array(answers, pa.binary())})


def levels(keys: np.ndarray, answers: dict[int, bytes], plan: SketchPlan) -> np.ndarray:
    """The level of each key: the least over the sketch's rows."""
    out = np.full(len(keys), 255, np.uint8)
    for row in range(plan.depth if len(keys) else 0):
        c = _cells(keys, plan, row)
        parts = [np.frombuffer(zlib.decompress(answers[row * plan.ranges + int(r)]), np.uint8) for r in np.flatnonzero(np.diff(c.edges))]
        per_cell = np.concatenate(parts)
        per_key = np.empty(len(keys), np.uint8)
        per_key[c.order] = np.repeat(per_cell, np.diff(c.head, append=len(keys)))
        np.minimum(out, per_key, out=out)
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)
