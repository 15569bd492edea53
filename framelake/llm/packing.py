"""Best-fit packing by the configuration linear program over the length histogram.

Documents become pieces of at most `capacity` tokens. All that the plan needs is
how many pieces have each length: at most `capacity` numbers, whatever the
corpus. On them the driver solves the configuration program (variables: how
often to use each multiset of lengths that fits) by multiplicative weights: the
weight of a length falls exponentially with the share of its demand already
covered, and a knapsack dynamic program prices the best configuration of lengths
that aren't covered yet, until all are. Uses are rounded down and limited by
demand; what is left is packed by best fit into the same kind of configurations,
in whole multiples. Where best fit of everything needs fewer sequences than the
rounded program, it is the plan.

The plan says, for each length and rank among equals, which sequence and place
it gets. Ranks come from windows over (length, bucket). A length of n pieces has
sqrt(n) buckets, so that neither a bucket nor the list of a length's buckets is
large, and a length that a third of all pieces have is ranked in many tasks.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.wordpiece import encode, slices
from framelake.llm.workspace import settle

#: A configuration that leaves no room is preferred to the best if it is worth this share of it.
NEARLY = 0.98
#: A round uses a configuration for at most this part of all sequences.
STEPS = 1_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids): each text's token ids and end_id, cut into pieces of at most capacity.

    ids are little-endian unsigned 32-bit numbers. A null or empty text is
    end_id alone. Rows that repeat are cut as often. Other columns aren't carried.
    """

    def cut(batches):
        for batch in batches:
            for lo, part in slices(batch.column("text")):
                ids, offs = encode(part, tokenizer_path)
                ids = np.insert(ids, offs[1:], end_id).astype("<u4")
                offs = offs + np.arange(len(offs))
                sizes = np.diff(offs)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                # Pieces of a document follow one another, so all pieces tile ids.
                raw = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * np.concatenate(([0], np.cumsum(length)))), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc + lo)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw], names=["id", "piece", "start", "length", "ids"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


class Plan(NamedTuple):
    capacity: int
    sequences: int
    key: np.ndarray  # length * span + first rank, ascending
    span: int  # above every rank
    per_copy: np.ndarray  # how many of the length each sequence takes
    sequence: np.ndarray  # the first one
    offset: np.ndarray  # of the first of the length in a sequence


def _best_configuration(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: a multiset of lengths within capacity whose values sum to the most, a full one if nearly as good."""
    best = np.full(capacity + 1, -np.inf)  # of multisets that sum to exactly c
    best[0] = 0
    choice = np.full(capacity + 1, -1)
    if 4 * len(lengths) > capacity:  # so many that whole slices are quicker than picking them
        worth, index = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
        worth[lengths], index[lengths] = values, np.arange(len(lengths))
        gains, backwards = np.empty(capacity), best[::-1]
        for c in range(int(lengths[0]), capacity + 1):
            part = np.add(backwards[capacity - c + 1 :], worth[1 : c + 1], out=gains[:c])
            i = part.argmax()
            best[c], choice[c] = part[i], index[i + 1]
    else:
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for c in range(int(lengths[0]), capacity + 1):
            k = fits[c]
            gains = best[c - lengths[:k]] + values[:k]
            i = int(gains.argmax())
            best[c], choice[c] = gains[i], i
    c = int(best.argmax())
    if best[capacity] >= NEARLY * best[c]:
        c = capacity
    found: dict[int, int] = {}
    while c > 0:
        i = int(choice[c])
        found[i] = found.get(i, 0) + 1
        c -= int(lengths[i])
    return found


def _fill(left: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Best fit: the longest length that is left, then again and again the longest that still fits."""
    found: dict[int, int] = {}
    room = capacity
    live = np.flatnonzero(left)
    while room > 0 and len(live):
        k = int(np.searchsorted(lengths[live], room, "right"))
        if not k:
            break
        i = int(live[k - 1])
        take = min(int(left[i]), room // int(lengths[i]))
        found[i] = take
        room -= take * int(lengths[i])
        live = live[: k - 1]
    return found


def _fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int | None = None) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often to use each, most used first: multiplicative weights on the covering program.

    Ends when every length is covered, each just so far as is asked, or after so
    many rounds. A round covers the rest of one length or uses its configuration,
    more than half full, for 1 / STEPS of the sequences that the tokens fill: at
    most 2 * STEPS rounds and one for each length.
    """
    live = np.flatnonzero(demand)
    lengths, demand = lengths[live], demand[live]
    step_most = max(1.0, float((lengths * demand).sum()) / capacity / STEPS)
    left, uses = demand.astype(float), {}
    steep = np.log(max(2, len(lengths)))
    for _ in count() if rounds is None else range(rounds):
        asked = np.flatnonzero(left)
        if not len(asked):
            break
        share = 1 - left[asked] / demand[asked]
        found = _best_configuration(lengths[asked], np.exp(-steep * (share - share.min())) * lengths[asked], capacity)
        i, a = asked[list(found)], np.array(list(found.values()))
        most = left[i] / a
        step = min(step_most, float(most.min()))
        left[i] = np.where(most <= step * (1 + 1e-9), 0, left[i] - step * a)
        name = tuple(sorted(zip(live[i].tolist(), a.tolist(), strict=True)))
        uses[name] = uses.get(name, 0.0) + step
    return [(dict(name), x) for name, x in sorted(uses.items(), key=lambda u: -u[1])]


def _rounded(lengths: np.ndarray, demand: np.ndarray, capacity: int, program: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    """Configurations with their uses that cover the demand exactly: the program's rounded down, then best fit."""
    left = demand.copy()
    chosen: list[tuple[dict[int, int], int]] = []
    for found, times in program:
        times = min(int(times), *(int(left[i]) // a for i, a in found.items()))
        if times:
            chosen.append((found, times))
            for i, a in found.items():
                left[i] -= times * a
    while left.any():
        found = _fill(left, lengths, capacity)
        times = min(int(left[i]) // a for i, a in found.items())
        chosen.append((found, times))
        for i, a in found.items():
            left[i] -= times * a
    return chosen


def plan_sequences(histogram: dict[int, int], capacity: int = 2048, rounds: int | None = None) -> Plan:
    """The plan for so many pieces of each length (1 to capacity); the program ends after so many rounds, or when it covers all."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    short = np.where(lengths < capacity, demand, 0)  # full pieces have one configuration only, which best fit gives them
    program = _fractional(lengths, short, capacity, rounds) if short.any() else []
    chosen = min((_rounded(lengths, demand, capacity, x) for x in (program, [])), key=lambda plan: sum(times for _, times in plan))
    rank, sequence = np.zeros(len(lengths), np.int64), 0
    rows = []
    for found, times in chosen:
        offset = 0
        for i, a in sorted(found.items(), reverse=True):
            rows.append((int(lengths[i]), int(rank[i]), a, sequence, offset))
            rank[i] += a * times
            offset += a * int(lengths[i])
        sequence += times
    span = int(demand.max(initial=0)) + 1
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.argsort(table[:, 0] * span + table[:, 1])]
    return Plan(capacity, sequence, table[:, 0] * span + table[:, 1], span, table[:, 2], table[:, 3], table[:, 4])


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with the sequence_id and offset of each, sequences at most capacity long and gapless from 0.

    Keeps all columns. Pieces alike in length and order_by may swap places.
    Lengths must be from 1 to capacity. An empty table gives an empty result.
    """
    pieces = settle(pieces, "pieces")
    histogram = {r[length_col]: r["n"] for r in pieces.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity)
    counts = pieces.sparkSession.createDataFrame([(int(k), int(n**0.5) + 1) for k, n in histogram.items()], "l_ long, buckets_ long")  # at most `capacity` rows
    dealt = pieces.join(F.broadcast(counts), F.col(length_col) == F.col("l_")).drop("l_").withColumn("bucket_", F.pmod(F.xxhash64(*order_by), F.col("buckets_"))).drop("buckets_")
    sums = dealt.groupBy(length_col, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(length_col).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(length_col, "bucket_", F.coalesce(before, F.lit(0)).alias("before_"))
    local = F.row_number().over(Window.partitionBy(length_col, "bucket_").orderBy(*order_by))
    ranked = dealt.withColumn("local_", local).join(starts, [length_col, "bucket_"]).withColumn("rank_", F.col("before_") + F.col("local_") - 1)

    def place(batches):
        for b in batches:
            length, rank = b.column(length_col).to_numpy(), b.column("rank_").to_numpy()
            at = np.searchsorted(plan.key, length * plan.span + rank, "right") - 1
            into = rank - (plan.key[at] - length * plan.span)
            each = plan.per_copy[at]
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(plan.sequence[at] + into // each), pa.array(plan.offset[at] + into % each * length)], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "rank_").mapInArrow(place, schema)
