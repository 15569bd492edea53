"""Filter chains: schemas are negotiated before any DataFrame is built, then the chain is composed lazily.

A filter says which colour models it takes and what becomes of the frame's size,
rate and count; where it refuses what comes, a converter goes in between.
Disabled filters, and those whose opacity is nothing wherever they act, aren't
built; a terminal filter ends the chain. A filter that looks at several frames
declares which (`needs`); the planner lists these dependencies, explodes and
joins them, and computes each distinct set of source frames once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.fraction import Fraction
from framelake.operators.point import rgb_to_ycbcr, ycbcr_to_rgb
from framelake.plans.kernels import PLANES, Kernel, Planes, _arrays, _planes, map_frames


@dataclass(frozen=True)
class FrameSchema:
    width: int
    height: int
    model: str = "rgb"  # or ycbcr; planes keep the names r, g, b
    rate: Fraction = Fraction(30)
    count: int = 0


class NotSupported(Exception):
    """A filter takes none of the models that its input can be converted to."""


@dataclass
class Filter:
    """A video filter: what it takes and makes of a schema, and how it runs.

    kernel works on planes of whole batches; needs, with combine, on the frames
    that it names for each output frame, as (input, frame) pairs; frames on the
    whole stream.
    """

    name: str
    kernel: Kernel | None = None
    models: tuple[str, ...] = ("rgb",)
    output: Callable[[FrameSchema], FrameSchema] = lambda s: s
    needs: Callable[[int], list[tuple[str, int]]] | None = None
    combine: Callable[[list[Planes]], Planes] | None = None
    terminal: bool = False
    frames: Callable[[DataFrame, tuple[int, int]], DataFrame] | None = None  # over time, from frames and their size


@dataclass
class Entry:
    filter: Filter
    enabled: bool = True
    frames: tuple[int, int] | None = None  # acts on [start, end)
    opacity: list[tuple[float, float, bool]] | None = None  # curve points
    inputs: tuple[str, ...] = ("$prev",)
    output_name: str | None = None


@dataclass
class Stream:
    frames: DataFrame
    schema: FrameSchema


@dataclass
class Chain:
    entries: list[Entry] = field(default_factory=list)

    def add(self, filter_: Filter, **settings) -> Chain:
        return Chain([*self.entries, Entry(filter_, **settings)])

    def plan(self, source: FrameSchema) -> list[tuple[Entry, list[str], FrameSchema]]:
        """Entries that will be built, the converters before each, and the schema after it."""
        known = {"$input": source, "$prev": source}
        steps = []
        for e in self.entries:
            if not e.enabled or e.opacity and _never(e.opacity, e.frames, known["$prev"].count):
                continue
            came = known[e.inputs[0]]
            converters = []
            if came.model not in e.filter.models:
                if not set(e.filter.models) & {"rgb", "ycbcr"}:
                    raise NotSupported(f"{e.filter.name} takes {e.filter.models}, not {came.model}")
                came = replace(came, model=e.filter.models[0])
                converters = [came.model]
            after = e.filter.output(came)
            if (e.opacity or e.frames) and (after.width, after.height, after.count) != (came.width, came.height, came.count):
                raise NotSupported(f"{e.filter.name} changes the frame, so it can't fade or act on a range")
            steps.append((e, converters, after))
            known["$prev"] = after
            if e.output_name:
                known[e.output_name] = after
            if e.filter.terminal:
                break
        return steps

    def run(self, source: Stream) -> Stream:
        streams = {"$input": source, "$prev": source}
        for e, converters, after in self.plan(source.schema):
            ins = []
            for name in e.inputs:
                s = streams[name]
                want = converters[0] if converters else s.schema.model if s.schema.model in e.filter.models else e.filter.models[0]
                ins.append(s if s.schema.model == want else Stream(convert(s.frames, s.schema, want), replace(s.schema, model=want)))
            out = _apply(e.filter, ins, after)
            if e.opacity or e.frames:
                out = _fade(ins[0].frames, out, e)
            streams["$prev"] = Stream(out, after)
            if e.output_name:
                streams[e.output_name] = streams["$prev"]
        return streams["$prev"]


def _never(points: list, frames: tuple[int, int] | None, count: int) -> bool:
    return all(y < 0.5 / 255 for _, y, _ in points)


def alias(stream: Stream, model: str) -> Stream:
    """The same planes said to be of another model; no value changes."""
    return Stream(stream.frames, replace(stream.schema, model=model))


def convert(frames: DataFrame, schema: FrameSchema, model: str) -> DataFrame:
    """The other colour model, by expressions on the planes' arrays."""
    turn = rgb_to_ycbcr if model == "ycbcr" else ycbcr_to_rgb
    zipped = F.transform(F.arrays_zip(*PLANES), lambda p: F.struct(*(c.cast("int").alias(n) for c, n in zip(turn((p["r"], p["g"], p["b"])), PLANES, strict=True))))
    others = [c for c in frames.columns if c not in PLANES]
    return frames.select(*others, zipped.alias("p_")).select(*others, *(F.col(f"p_.{n}").alias(n) for n in PLANES))


def _apply(filter_: Filter, ins: list[Stream], after: FrameSchema) -> DataFrame:
    first = ins[0]
    size = (first.schema.width, first.schema.height)
    if filter_.frames:
        return filter_.frames(first.frames.select("frame", *PLANES), size).select("frame", *PLANES)
    if filter_.needs is None:
        return map_frames(first.frames.select("frame", *PLANES), filter_.kernel, size)
    return by_dependencies(filter_, {f"${i}": s for i, s in enumerate(ins)}, after.count, size)


def by_dependencies(filter_: Filter, inputs: dict[str, Stream], count: int, size: tuple[int, int]) -> DataFrame:
    """Output frames from the frames they need: listed, reduced to distinct sets, exploded, joined, combined.

    Frames before a stream's start or after its end are its first or last one.
    Equal sets of source frames (a held frame, say) are computed once.
    """
    spark = next(iter(inputs.values())).frames.sparkSession
    needs, lasts = filter_.needs, {k: s.schema.count - 1 for k, s in inputs.items()}

    def listed(batches):
        for b in batches:
            rows = [[(k, min(max(f, 0), lasts[k])) for k, f in needs(i)] for i in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([",".join(f"{k}:{f}" for k, f in r) for r in rows])], names=["frame", "wanted"])

    wanted = spark.range(count).mapInArrow(listed, "frame long, wanted string")
    distinct = wanted.select("wanted").distinct()
    parts = distinct.select("wanted", F.posexplode(F.split("wanted", ",")).alias("slot", "part")).select("wanted", "slot", F.split_part("part", F.lit(":"), F.lit(1)).alias("input"), F.split_part("part", F.lit(":"), F.lit(2)).cast("long").alias("frame"))
    sources = None
    for k, s in inputs.items():
        one = s.frames.select(F.lit(k).alias("input"), "frame", *PLANES)
        sources = one if sources is None else sources.unionByName(one)

    def combine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        planes = _planes(table, size)
        out = filter_.combine([{k: p[i : i + 1] for k, p in planes.items()} for i in range(len(table))])
        return pa.table([pa.array([key[0].as_py()]), *_arrays(out)], names=["wanted", *PLANES])

    done = parts.join(sources, ["input", "frame"]).groupBy("wanted").applyInArrow(combine, "wanted string, r array<int>, g array<int>, b array<int>")
    return wanted.join(done, "wanted").select("frame", *PLANES)


def _fade(before: DataFrame, after: DataFrame, e: Entry) -> DataFrame:
    """Where the filter acts, blended by its curve; elsewhere the frame as it was."""
    from framelake.functions.curve import evaluate

    alpha: Column = evaluate(e.opacity, F.col("frame").cast("double")) if e.opacity else F.lit(1.0)
    if e.frames:
        alpha = F.when(F.col("frame").between(e.frames[0], e.frames[1] - 1), alpha).otherwise(0.0)
    joined = before.select("frame", *PLANES).join(after.select("frame", *(F.col(p).alias(f"{p}_f") for p in PLANES)), "frame").withColumn("a_", alpha)
    k = F.floor(F.col("a_") * 256 + 0.5).cast("int")
    mixed = lambda p: F.zip_with(p, f"{p}_f", lambda x, y: (x + F.shiftright((y - x) * k + 128, 8)).cast("int"))
    pick = lambda p: F.when(F.col("a_") < 0.5 / 255, F.col(p)).when(F.col("a_") >= 254.5 / 255, F.col(f"{p}_f")).otherwise(mixed(p))
    return joined.select("frame", *(pick(p).alias(p) for p in PLANES))


# --- filters with dependencies ---------------------------------------------


def nearest_rate(factor: float) -> Filter:
    """Frame-rate conversion by the nearest source frame."""
    return Filter("nearest rate", needs=lambda i: [("$0", int(np.floor((i + 0.5) / factor)))], combine=lambda parts: parts[0], output=lambda s: replace(s, rate=s.rate * Fraction(round(factor * 1000), 1000), count=int(s.count * factor + 0.5)))


def mean_of(before: int, after: int) -> Filter:
    """The mean of a frame and its neighbours in time."""
    def combine(parts: list[Planes]) -> Planes:
        return {k: (sum(p[k] for p in parts) + len(parts) // 2) // len(parts) for k in PLANES}

    return Filter("mean", needs=lambda i: [("$0", f) for f in range(i - before, i + after + 1)], combine=combine)


def difference() -> Filter:
    """Of two inputs, frame by frame."""
    return Filter("difference", needs=lambda i: [("$0", i), ("$1", i)], combine=lambda parts: {k: abs(parts[0][k] - parts[1][k]) for k in PLANES})


def interpolate(frames: DataFrame, count: int, factor: float, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Frame-rate conversion with each output frame between two source frames, weighted in 1/256.

    Two joins on frame numbers; the weight is a column, so nothing leaves the JVM.
    """
    from framelake.plans.timeline import interpolation_map

    last = F.lit(count - 1)
    m = interpolation_map(count, factor, frames.sparkSession)
    m = m.select("frame", F.greatest(F.lit(0), F.least(last, F.col("src"))).alias("a_"), F.greatest(F.lit(0), F.least(last, F.col("src") + 1)).alias("b_"), "alpha")
    a = frames.select(F.col("frame").alias("a_"), *(F.col(p).alias(f"{p}_a") for p in PLANES))
    b = frames.select(F.col("frame").alias("b_"), *(F.col(p).alias(f"{p}_b") for p in PLANES))
    mixed = lambda p: F.zip_with(f"{p}_a", f"{p}_b", lambda x, y: (x + F.shiftright((y - x) * F.col("alpha") + 128, 8)).cast("int"))
    return m.join(a, "a_").join(b, "b_").select("frame", *(mixed(p).alias(p) for p in PLANES))
