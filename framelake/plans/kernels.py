"""Running NumPy kernels over frames, per frame or over stretches of time.

A frame's planes are arrays of its row, so a spatial kernel is a narrow map of
Arrow batches: no shuffle, whatever the neighbourhood. A temporal kernel gets
stretches of consecutive frames with as many neighbours on both sides as it
looks at; the frames at a stretch's edges are sent to both, so that a stream of
any length is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Planes = dict[str, np.ndarray]  # name -> (frames, height, width)
Kernel = Callable[[Planes], Planes]
PLANES = ("r", "g", "b")


def _planes(batch: pa.RecordBatch | pa.Table, size: tuple[int, int]) -> Planes:
    out = {}
    for name in PLANES:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out[name] = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size[1], size[0])
    return out


def _arrays(planes: Planes) -> list[pa.Array]:
    out = []
    for name in PLANES:
        p = planes[name]
        n, area = len(p), int(np.prod(p.shape[1:]))
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * area, pa.int32()), pa.array(p.reshape(-1).astype(np.int32))))
    return out


def map_frames(frames: DataFrame, kernel: Kernel, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """frames with planes r, g, b replaced by the kernel's; other columns stay. size is (width, height)."""
    others = [c for c in frames.columns if c not in PLANES]

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *_arrays(kernel(_planes(b, size)))], names=[*others, *PLANES])

    return frames.select(*others, *PLANES).mapInArrow(run, frames.select(*others, *PLANES).schema)


def over_time(frames: DataFrame, kernel: Callable[[Planes, int, int], Planes], before: int, after: int, size: tuple[int, int] = (8, 8), stretch: int = 64, order: str = "frame") -> DataFrame:
    """(frame, r, g, b) from stretches of `stretch` frames with `before` and `after` neighbours.

    kernel(planes, start, stop) gets the frames of a stretch and its neighbours
    in order, edge frames repeated where the stream has none, and returns planes
    for the frames [start, stop). Frames must be numbered without gaps; each
    stretch finds its ends in its own rows, so that nothing is computed beforehand.
    """
    home = F.floor(F.col(order) / stretch)
    homes = F.sequence(F.floor((F.col(order) - after) / stretch), F.floor((F.col(order) + before) / stretch))
    spread = frames.select(order, *PLANES, F.explode(homes).alias("stretch_")) if before or after else frames.select(order, *PLANES, home.alias("stretch_"))
    kinds = [to_arrow_type(frames.schema[c].dataType) for c in (order, *PLANES)]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        numbers = table.column(order).to_numpy()
        own = numbers[numbers // stretch == key[0].as_py()]
        if not len(own):
            return pa.table([pa.array([], k) for k in kinds], names=[order, *PLANES])
        first, end = int(own[0]), int(own[-1]) + 1
        wanted = np.clip(np.arange(first - before, end + after), numbers[0], numbers[-1])
        at = np.searchsorted(numbers, wanted)
        planes = {k: v[at] for k, v in _planes(table, size).items()}
        out = kernel(planes, before, before + end - first)
        return pa.table([pa.array(np.arange(first, end), kinds[0]), *_arrays(out)], names=[order, *PLANES])

    return spread.groupBy("stretch_").applyInArrow(run, frames.select(order, *PLANES).schema)
