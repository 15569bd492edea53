"""Edit timelines: ordered intervals (stream, ord, start, len, masked, source) that select and reorder frames.

`EditList` is one timeline on the driver, as scripts build it. The functions on
DataFrames do the same for any number of streams at once; every window is
partitioned by stream.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Span(NamedTuple):
    start: int
    len: int
    masked: bool = False
    source: int = 0

    @property
    def end(self) -> int:
        return self.start + self.len


def joins(a: Span, b: Span) -> bool:
    return a.end == b.start and a.masked == b.masked and a.source == b.source


class EditList:
    def __init__(self, spans=()):
        self.spans = [Span(*s) for s in spans]

    @classmethod
    def whole(cls, length: int) -> EditList:
        return cls([Span(0, length)])

    def __eq__(self, other) -> bool:
        return self.spans == other.spans

    def __len__(self) -> int:
        return sum(s.len for s in self.spans)

    def add(self, start: int, length: int, masked: bool = False, source: int = 0) -> EditList:
        """Appends; frames may repeat and run backwards."""
        return EditList([*self.spans, Span(start, length, masked, source)])

    def merge(self, start: int, length: int, masked: bool = False, source: int = 0) -> EditList:
        """Sorted union: what is there already wins over the new span, touching spans alike become one."""
        pieces, at = [], start
        for s in sorted(self.spans):
            if s.end <= at or s.start >= start + length:
                continue
            if s.start > at:
                pieces.append(Span(at, s.start - at, masked, source))
            at = max(at, s.end)
        if at < start + length:
            pieces.append(Span(at, start + length - at, masked, source))
        return EditList(_coalesced(sorted([*self.spans, *pieces])))

    def lookup(self, at: int) -> tuple[int, bool, int]:
        """(frame, masked, source) at a place; a masked one shows the last frame before it that isn't; -1 outside."""
        shown, before = None, 0
        for s in self.spans:
            if before <= at < before + s.len:
                if not s.masked:
                    return s.start + at - before, False, s.source
                return (shown.end - 1, True, shown.source) if shown else (self.spans[0].start, True, self.spans[0].source)
            shown = shown if s.masked else s
            before += s.len
        return -1, False, -1

    def find(self, frame: int) -> int:
        """The first place that shows a frame, or -1."""
        before = 0
        for s in self.spans:
            if s.start <= frame < s.end:
                return before + frame - s.start
            before += s.len
        return -1

    def _split(self, at: int) -> tuple[list[Span], list[Span]]:
        left, right, before = [], [], 0
        for s in self.spans:
            cut = max(0, min(s.len, at - before))
            if cut:
                left.append(s._replace(len=cut))
            if cut < s.len:
                right.append(s._replace(start=s.start + cut, len=s.len - cut))
            before += s.len
        return left, right

    def delete(self, at: int, length: int) -> EditList:
        return EditList(self._split(at)[0] + self._split(at + length)[1])

    def delete_input(self, start: int, length: int) -> EditList:
        """Removes source frames wherever they show."""
        out = []
        for s in self.spans:
            for lo, hi in ((s.start, min(s.end, start)), (max(s.start, start + length), s.end)):
                if lo < hi:
                    out.append(s._replace(start=lo, len=hi - lo))
        return EditList(out)

    def mask(self, at: int, length: int, masked: bool = True) -> EditList:
        left, rest = self._split(at)
        middle, right = EditList(rest)._split(length)
        return EditList(_coalesced([*left, *(s._replace(masked=masked) for s in middle), *right]))

    def clip(self, at: int, length: int) -> EditList:
        return EditList(EditList(self._split(at)[1])._split(length)[0])

    def offset(self, by: int) -> EditList:
        return EditList(s._replace(start=s.start + by) for s in self.spans)

    def trim_input(self, limit: int) -> EditList:
        return EditList(s._replace(len=min(s.end, limit) - s.start) for s in self.spans if s.start < limit)

    def insert(self, at: int, other: EditList) -> EditList:
        left, right = self._split(at)
        return EditList(_coalesced([*left, *other.spans, *right]))

    def rescale(self, ratio: float, new_length: int) -> EditList:
        """Both ends scaled and rounded half down; the last ends at new_length."""
        from math import ceil

        out = []
        for i, s in enumerate(self.spans):
            lo, hi = ceil(s.start * ratio - 0.5), ceil(s.end * ratio - 0.5)
            hi = new_length if i == len(self.spans) - 1 else hi
            if hi > lo:
                out.append(s._replace(start=lo, len=hi - lo))
        return EditList(out)

    def direct(self, is_key) -> EditList:
        """Each unmasked span grown back to the key frame that its first frame needs, joined with the one before where they meet."""
        out: list[Span] = []
        for s in self.spans:
            start = s.start
            while start > 0 and not is_key(start):
                start -= 1
            s = s._replace(start=start, len=s.end - start)
            if out and not s.masked and out[-1].source == s.source and out[-1].start <= start <= out[-1].end <= s.end:
                out[-1] = out[-1]._replace(len=s.end - out[-1].start)
            else:
                out.append(s)
        return EditList(out)

    def rows(self) -> list[tuple]:
        return [(i, *s) for i, s in enumerate(self.spans)]


def _coalesced(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if s.len <= 0:
            continue
        if out and joins(out[-1], s):
            out[-1] = out[-1]._replace(len=out[-1].len + s.len)
        else:
            out.append(s)
    return out


# --- on DataFrames ---------------------------------------------------------

COLUMNS = ("stream", "ord", "start", "len", "masked", "source")


def _by_ord():
    return Window.partitionBy("stream").orderBy("ord")


def placed(timeline: DataFrame) -> DataFrame:
    """With dst0, the place of each span's first frame."""
    return timeline.withColumn("dst0", F.sum("len").over(_by_ord()) - F.col("len"))


def total_frames(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("stream").agg(F.sum("len").alias("n_frames"))


def shown(timeline: DataFrame) -> DataFrame:
    """placed, with what a masked span shows: the last frame of the nearest unmasked span before it, else the first span's first."""
    past = _by_ord().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("masked"), F.struct((F.col("start") + F.col("len") - 1).alias("f"), F.col("source").alias("s"))), ignorenulls=True).over(past)
    first = F.first(F.struct(F.col("start").alias("f"), F.col("source").alias("s"))).over(past)
    return placed(timeline).withColumn("held", F.coalesce(last, first))


def lookup(timeline: DataFrame, places: DataFrame, cell: int = 256) -> DataFrame:
    """(stream, place, frame, masked, source) for places (stream, place); outside, frame and source are -1.

    A range join as an equi-join: spans are listed under every cell of `cell`
    places that they touch, so a stream of millions of spans isn't compared in full.
    """
    spans = shown(timeline).where("len > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("dst0") / cell), F.floor((F.col("dst0") + F.col("len") - 1) / cell))))
    asked = places.withColumn("cell", F.floor(F.col("place") / cell))
    on = (asked["stream"] == spans["stream"]) & (asked["cell"] == spans["cell"]) & (asked["place"] >= spans["dst0"]) & (asked["place"] < spans["dst0"] + spans["len"])
    found = asked.join(spans, on, "left")
    frame = F.when(F.col("masked"), F.col("held.f")).otherwise(F.col("start") + F.col("place") - F.col("dst0"))
    source = F.when(F.col("masked"), F.col("held.s")).otherwise(F.col("source"))
    return found.select(asked["stream"], "place", F.coalesce(frame, F.lit(-1)).cast("long").alias("frame"), F.coalesce("masked", F.lit(False)).alias("masked"), F.coalesce(source, F.lit(-1)).cast("int").alias("source"))


def reverse_lookup(timeline: DataFrame, wanted: DataFrame, cell: int = 256) -> DataFrame:
    """(stream, frame, place): the first place that shows a frame of (stream, frame), or -1. A join on cells of source frames, as in lookup."""
    spans = placed(timeline).where("len > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("len") - 1) / cell))))
    wanted = wanted.withColumn("cell", F.floor(F.col("frame") / cell))
    on = (wanted["stream"] == spans["stream"]) & (wanted["cell"] == spans["cell"]) & (wanted["frame"] >= spans["start"]) & (wanted["frame"] < spans["start"] + spans["len"])
    return wanted.join(spans, on, "left").groupBy(wanted["stream"], wanted["frame"]).agg(F.coalesce(F.min_by(F.col("dst0") + F.col("frame") - F.col("start"), "ord"), F.lit(-1)).alias("place"))


def union_spans(timeline: DataFrame) -> DataFrame:
    """(stream, masked, source, start, len): overlapping and touching spans alike become one (gaps and islands)."""
    w = Window.partitionBy("stream", "masked", "source").orderBy("start", "len")
    reach = F.max(F.col("start") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = timeline.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = opened.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = island.groupBy("stream", "masked", "source", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"))
    return ends.select("stream", "masked", "source", "start", (F.col("end") - F.col("start")).alias("len"))


def _renumbered(pieces: DataFrame) -> DataFrame:
    order = Window.partitionBy("stream").orderBy("ord", "piece")
    return pieces.where("len > 0").withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select(*COLUMNS)


def _pieces(spans: DataFrame, *bounds) -> DataFrame:
    """One row for each (lo, hi, masked) of a span in source frames, in order."""
    rows = F.array(*(F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), m.alias("m")) for lo, hi, m in bounds))
    cut = spans.select("stream", "ord", "source", F.posexplode(rows).alias("piece", "p"))
    return cut.select("stream", "ord", "piece", F.col("p.lo").alias("start"), (F.col("p.hi") - F.col("p.lo")).alias("len"), F.col("p.m").alias("masked"), "source")


def delete_range(timeline: DataFrame, at: int, length: int) -> DataFrame:
    s = placed(timeline)
    end = F.col("start") + F.col("len")
    left = F.least(end, F.greatest(F.col("start"), F.col("start") + at - F.col("dst0")))
    right = F.least(end, F.greatest(F.col("start"), F.col("start") + at + length - F.col("dst0")))
    return _renumbered(_pieces(s, (F.col("start"), left, F.col("masked")), (right, end, F.col("masked"))))


def delete_input_range(timeline: DataFrame, start: int, length: int) -> DataFrame:
    end = F.col("start") + F.col("len")
    return _renumbered(_pieces(timeline, (F.col("start"), F.least(end, F.lit(start)), F.col("masked")), (F.greatest(F.col("start"), F.lit(start + length)), end, F.col("masked"))))


def set_range(timeline: DataFrame, at: int, length: int, masked: bool = True) -> DataFrame:
    """Marks places; neighbours that come to be alike are joined."""
    s = placed(timeline)
    end = F.col("start") + F.col("len")
    lo = F.least(end, F.greatest(F.col("start"), F.col("start") + at - F.col("dst0")))
    hi = F.least(end, F.greatest(F.col("start"), F.col("start") + at + length - F.col("dst0")))
    return coalesce_neighbours(_renumbered(_pieces(s, (F.col("start"), lo, F.col("masked")), (lo, hi, F.lit(masked)), (hi, end, F.col("masked")))))


def coalesce_neighbours(timeline: DataFrame) -> DataFrame:
    w = _by_ord()
    same = (F.lag(F.col("start") + F.col("len")).over(w) == F.col("start")) & (F.lag("masked").over(w) == F.col("masked")) & (F.lag("source").over(w) == F.col("source"))
    run = timeline.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = run.groupBy("stream", "run").agg(F.min_by("start", "ord").alias("start"), F.sum("len").alias("len"), F.first("masked").alias("masked"), F.first("source").alias("source"))
    return joined.withColumn("ord", (F.col("run") - 1).cast("long")).select(*COLUMNS)


def clip(timeline: DataFrame, at: int, length: int) -> DataFrame:
    s = placed(timeline)
    lo = F.greatest(F.lit(0), F.lit(at) - F.col("dst0"))
    hi = F.least(F.col("len"), F.lit(at + length) - F.col("dst0"))
    return _renumbered(_pieces(s, (F.col("start") + lo, F.col("start") + hi, F.col("masked"))))


def offset(timeline: DataFrame, by: int) -> DataFrame:
    return timeline.withColumn("start", F.col("start") + by)


def trim_input(timeline: DataFrame, limit: int) -> DataFrame:
    return timeline.where(F.col("start") < limit).withColumn("len", F.least("len", F.lit(limit) - F.col("start")))


def insert(timeline: DataFrame, at: int, other: DataFrame) -> DataFrame:
    """Another timeline of the same streams spliced in at a place."""
    s = placed(timeline)
    cut = F.least(F.col("start") + F.col("len"), F.greatest(F.col("start"), F.col("start") + at - F.col("dst0")))
    left = _pieces(s, (F.col("start"), cut, F.col("masked"))).withColumn("side", F.lit(0))
    right = _pieces(s, (cut, F.col("start") + F.col("len"), F.col("masked"))).withColumn("side", F.lit(2))
    middle = other.withColumn("piece", F.lit(0)).withColumn("side", F.lit(1)).select(*left.columns)
    order = Window.partitionBy("stream").orderBy("side", "ord", "piece")
    rows = left.unionByName(middle).unionByName(right).where("len > 0").withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select(*COLUMNS)
    return coalesce_neighbours(rows)


def rescale(timeline: DataFrame, ratio: float, new_length: int) -> DataFrame:
    timeline = timeline.withColumn("last_", F.max("ord").over(Window.partitionBy("stream")))
    last = F.col("last_") == F.col("ord")
    lo = F.ceil(F.col("start") * ratio - 0.5)
    hi = F.when(last, F.lit(new_length)).otherwise(F.ceil((F.col("start") + F.col("len")) * ratio - 0.5))
    return _renumbered(_pieces(timeline, (lo, hi, F.col("masked"))))


# --- frame maps ------------------------------------------------------------


def previous_key(frames: DataFrame, order: str = "frame", key: str = "is_key", by: tuple[str, ...] = ("stream",), block: int = 4096) -> DataFrame:
    """With prev_key and next_key, the nearest key frames at or before and at or after each frame.

    Windows run within blocks of frames; blocks without a key look at the nearest
    block that has one, through one row per block.
    """
    b = frames.withColumn("block_", F.floor(F.col(order) / block))
    within = Window.partitionBy(*by, "block_").orderBy(order)
    marked = F.when(F.col(key), F.col(order))
    local = b.withColumn("p_", F.last(marked, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_", F.first(marked, ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing)))
    edges = b.groupBy(*by, "block_").agg(F.min(marked).alias("lo_"), F.max(marked).alias("hi_"))
    across = Window.partitionBy(*by).orderBy("block_")
    edges = edges.select(*by, "block_", F.last("hi_", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"), F.first("lo_", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after_"))
    out = local.join(edges, [*by, "block_"])
    return out.withColumn("prev_key", F.coalesce("p_", "before_")).withColumn("next_key", F.coalesce("n_", "after_")).drop("block_", "p_", "n_", "before_", "after_")


def rate_map(n_source: int, source_rate: tuple[int, int], target_rate: tuple[int, int], spark, start: int = 0) -> DataFrame:
    """(frame, timeline): which timeline frame each output frame shows, by truncation."""
    num, den = source_rate[0] * target_rate[1], source_rate[1] * target_rate[0]
    n = n_source * den // num
    return spark.range(n).select(F.col("id").alias("frame"), (F.floor(F.col("id") * num / den) + start).cast("long").alias("timeline"))


def interpolation_map(n_source: int, factor: float, spark, lerp: bool = True) -> DataFrame:
    """(frame, src, alpha): source frame and weight (of 256) of the next one for each output frame."""
    factor = min(1000.0, max(0.001, factor))
    place = F.floor((F.col("id") + 0.5) / factor * 256 + 0.5) - (128 if lerp else 0)
    return spark.range(int(n_source * factor + 0.5)).select(F.col("id").alias("frame"), F.shiftright(place, 8).alias("src"), place.bitwiseAND(255).alias("alpha"))


def direct_map(frame_map: DataFrame, keys: DataFrame) -> DataFrame:
    """(stream, frame, src, needs): the first source frame to decode for each output frame: its key, or on from the frame before."""
    keyed = previous_key(keys.select("stream", F.col("frame").alias("src"), "is_key"), "src")
    w = Window.partitionBy("stream").orderBy("frame")
    joined = frame_map.join(keyed.select("stream", "src", "prev_key"), ["stream", "src"])
    last = F.lag("src").over(w)
    needs = F.when((last < F.col("src")) & (last >= F.col("prev_key")), last + 1).when(last == F.col("src"), F.col("src") + 1).otherwise(F.col("prev_key"))
    return joined.select("stream", "frame", "src", F.greatest(needs, F.col("prev_key")).alias("needs"))


def interleave(n_frames: int, samples_per_frame: float, preload: int, block: int, spark) -> DataFrame:
    """(frame, samples): how many audio samples follow each video frame, in blocks, the preload ahead of the first."""
    target = lambda f: F.ceil((F.ceil(f * samples_per_frame) + preload) / block) * block
    return spark.range(n_frames).select(F.col("id").alias("frame"), (target(F.col("id") + 1) - F.when(F.col("id") > 0, target(F.col("id"))).otherwise(0)).cast("long").alias("samples"))
