"""A project's sound: its settings, its filter graph, and the script objects of both.

Filters of the graph take and give streams of samples: stereo (pos, l, r) or, after
a split, one channel (pos, v). Parameters are set by number, as scripts do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import audio
from framelake.plans.timeline import EditList
from framelake.script.language import ScriptError


@dataclass
class Sound:
    """Samples of one rate."""

    samples: DataFrame
    rate: int


def _each(f: Callable[[Column], Column]):
    """A filter without memory, on whatever channels there are."""
    return lambda s: Sound(s.samples.select("pos", *(f(F.col(c)).cast("int").alias(c) for c in s.samples.columns if c != "pos")), s.rate)


def _stereo(f: Callable[[DataFrame], DataFrame], rate: Callable[[int], int] = lambda r: r):
    """A filter of stereo samples, on one channel by doubling it."""

    def run(s: Sound) -> Sound:
        one = "v" in s.samples.columns
        out = f(s.samples.select("pos", F.col("v").alias("l"), F.col("v").alias("r")) if one else s.samples)
        return Sound(out.select("pos", F.col("l").alias("v")) if one else out, rate(s.rate))

    return run


def _split(s: Sound) -> tuple[Sound, Sound]:
    left, right = audio.stereo_split(s.samples)
    return Sound(left, s.rate), Sound(right, s.rate)


def _center_cut(s: Sound) -> tuple[Sound, Sound]:
    out = audio.center_cut(s.samples)
    return Sound(out.select("pos", "l", "r"), s.rate), Sound(out.select("pos", F.col("c").alias("v")), s.rate)


def _butterfly(s: Sound) -> Sound:
    return Sound(s.samples.select("pos", *(c.alias(n) for c, n in zip(audio.butterfly(F.col("l"), F.col("r")), "lr", strict=True))), s.rate)


def _to_8_and_back(bits: int):
    return _each((lambda v: audio.to_16(audio.to_8(v))) if bits == 8 else lambda v: v)


def _resample(frequency: int):
    return lambda s: _stereo(lambda x: audio.resample(x, frequency / s.rate), lambda _: frequency)(s)


#: name -> (input pins, output pins, parameters' values at first, how it runs with them).
FILTERS: dict[str, tuple[int, int, list, Callable[..., Callable]]] = {
    "gain": (1, 1, [1.0], lambda ratio: _each(lambda v: audio.gain(v, ratio))),
    "mix": (2, 1, [], lambda: lambda a, b: Sound(audio.mix(a.samples, b.samples), a.rate)),
    "split": (1, 2, [], lambda: lambda s: (s, s)),
    "stereo split": (1, 2, [], lambda: _split),
    "stereo merge": (2, 1, [], lambda: lambda a, b: Sound(audio.stereo_merge(a.samples, b.samples), a.rate)),
    "butterfly": (1, 1, [], lambda: _butterfly),
    "center cut": (1, 2, [], lambda: _center_cut),
    "center mix": (2, 1, [], lambda: lambda a, b: Sound(audio.center_mix(a.samples, b.samples), a.rate)),
    "stereo chorus": (1, 1, [], lambda: lambda s: Sound(audio.chorus(s.samples, s.rate), s.rate)),
    "lowpass": (1, 1, [10_000, 64], lambda cutoff, taps: lambda s: _stereo(lambda x: audio.low_pass(x, cutoff, s.rate, taps // 2))(s)),
    "highpass": (1, 1, [10_000, 64], lambda cutoff, taps: lambda s: _stereo(lambda x: audio.high_pass(x, cutoff, s.rate, taps // 2))(s)),
    "resample": (1, 1, [44_100, 64], lambda frequency, _: _resample(frequency)),
    "stretch": (1, 1, [1.0], lambda ratio: _stereo(lambda x: audio.resample(x, ratio))),
    "new rate": (1, 1, [44_100], lambda frequency: lambda s: Sound(s.samples, frequency)),
    "format convert": (1, 1, [16], _to_8_and_back),
    "pitch shift": (1, 1, [1.0], lambda ratio: _stereo(lambda x: audio.pitch_shift(x, ratio))),
    "ratty pitch shift": (1, 1, [1.0], lambda ratio: _stereo(lambda x: audio.pitch_shift(x, ratio))),
    "time stretch": (1, 1, [1.0], lambda ratio: _stereo(lambda x: audio.time_stretch(x, ratio))),
}
#: Ends of a graph: what it reads, what becomes of it, what is only heard, what is dropped.
ENDS = {"input": (0, 1), "output": (1, 0), "playback": (1, 0), "discard": (1, 0)}


@dataclass
class Node:
    name: str
    values: list


@dataclass
class Audio:
    """What a script says about sound."""

    source: Sound | None = None
    on: bool = True
    mode: int = 0  # 0 direct, 1 full processing
    volume: int | None = None  # in 1/256
    conversion: tuple[int, int, int] = (0, 0, 0)  # rate, precision (1: 8 bits, 2: 16), channels (1: one, 2: two); 0 as it comes
    interleave: tuple[int, ...] = (1, 500, 1, 0, 0)
    clip: tuple[int, int] = (1, 1)
    edit: int = 1  # whether the video's timeline cuts the sound
    graph_on: bool = False
    nodes: list[Node] = field(default_factory=list)
    wires: list[tuple[int, int, int, int]] = field(default_factory=list)

    def add(self, name: str) -> int:
        if name in FILTERS:
            self.nodes.append(Node(name, list(FILTERS[name][2])))
        elif name in ENDS:
            self.nodes.append(Node(name, []))
        else:
            raise ScriptError(f"no audio filter is called {name}")
        return len(self.nodes) - 1

    def connect(self, source: int, source_pin: int, target: int, target_pin: int) -> None:
        if not 0 <= source < target < len(self.nodes):
            raise ScriptError("a filter can only feed one that was added after it")
        pins = lambda i, side: ENDS[self.nodes[i].name][side] if self.nodes[i].name in ENDS else FILTERS[self.nodes[i].name][side]
        if not (0 <= source_pin < pins(source, 1) and 0 <= target_pin < pins(target, 0)):
            raise ScriptError("there is no such pin")
        self.wires.append((source, source_pin, target, target_pin))

    def set(self, i: int, parameter: int, value: Any) -> None:
        values = self.nodes[i].values
        if not 0 <= parameter < len(values):
            raise ScriptError(f"{self.nodes[i].name} has no parameter {parameter}")
        values[parameter] = value

    def _through_graph(self, sound: Sound) -> Sound:
        graph = audio.AudioGraph()
        for node in self.nodes:
            if node.name == "input":
                graph.add(node.name, lambda: sound)
            elif node.name in ENDS:
                graph.add(node.name, lambda s: s)
            else:
                graph.add(node.name, FILTERS[node.name][3](*node.values))
        for wire in self.wires:
            graph.connect(*wire)
        done = graph.run()
        ends = [i for i, n in enumerate(self.nodes) if n.name == "output"]
        if len(ends) != 1:
            raise ScriptError("a graph has one output")
        return done[ends[0]][0]

    def result(self, timeline: EditList, frame_rate: float) -> Sound:
        """The sound as it is saved: cut by the timeline, through the graph, at its volume, converted."""
        if self.source is None:
            raise ScriptError("there is no sound")
        sound = self.source
        if self.edit and timeline.spans:
            spans = sound.samples.sparkSession.createDataFrame([(0, *r) for r in timeline.rows()], "stream int, ord int, start long, len long, masked boolean, source int")
            sound = Sound(audio.subset(sound.samples, spans, sound.rate / frame_rate), sound.rate)
        if self.mode == 0:
            return sound
        if self.graph_on:
            sound = self._through_graph(sound)
        if self.volume is not None:
            sound = _each(lambda v: audio.amplify_16(v, self.volume / 256))(sound)
        rate, precision, channels = self.conversion
        if rate and rate != sound.rate:
            sound = _resample(rate)(sound)
        if channels == 1 and "l" in sound.samples.columns:
            sound = Sound(sound.samples.select("pos", *(audio.mono_16(F.col("l"), F.col("r")).alias(c) for c in "lr")), sound.rate)
        return _to_8_and_back(8)(sound) if precision == 1 else sound


def objects(settings: Audio, make: Callable[..., Any]) -> Any:
    """The script object of the settings; make(methods, properties) builds one."""

    def change(**values) -> None:
        for k, v in values.items():
            setattr(settings, k, v)

    def instance(i: int) -> Any:
        if not 0 <= i < len(settings.nodes):
            raise ScriptError(f"no audio filter {i}")
        put = lambda k, v: settings.set(i, int(k), v)
        whole = lambda k, hi, lo: put(k, (hi << 32) | (lo & 0xFFFFFFFF))
        return make({"SetInt": [("0ii", put)], "SetLong": [("0iii", whole), ("0il", put)], "SetDouble": [("0id", put)], "SetString": [("0is", put)]}, {})

    def clear() -> None:
        settings.nodes.clear()
        settings.wires.clear()

    filters = make({"Clear": [("0", clear)], "Add": [("is", settings.add)], "Connect": [("0iiii", settings.connect)]}, {"instance": lambda: make({"[]": [("vi", instance)]}, {})})
    convert = lambda rate, precision, channels: change(conversion=(rate, precision, channels))
    return make(
        {
            "GetMode": [("i", lambda: settings.mode)],
            "SetMode": [("0i", lambda m: change(mode=m))],
            "GetInterleave": [("ii", lambda i: settings.interleave[i])],
            "SetInterleave": [("0iiiii", lambda *a: change(interleave=a))],
            "GetClipMode": [("ii", lambda i: settings.clip[i])],
            "SetClipMode": [("0ii", lambda a, b: change(clip=(a, b)))],
            "GetEditMode": [("i", lambda: settings.edit)],
            "SetEditMode": [("0i", lambda m: change(edit=m))],
            "GetConversion": [("ii", lambda i: settings.conversion[i])],
            "SetConversion": [("0iii", convert), ("0iiiii", lambda a, b, c, *_: convert(a, b, c))],
            "SetSource": [("0i", lambda on: change(on=bool(on)))],
            "SetCompressionPCM": [("0iii", lambda rate, channels, bits: convert(rate, 1 if bits == 8 else 2, channels))],
            "SetCompression": [("0", lambda: None)],
            "SetVolume": [("0", lambda: change(volume=None)), ("0i", lambda v: change(volume=v))],
            "GetVolume": [("i", lambda: settings.volume or 0)],
            "EnableFilterGraph": [("0i", lambda on: change(graph_on=bool(on)))],
        },
        {"filters": lambda: filters, "samplerate": lambda: settings.source.rate if settings.source else 0, "length": lambda: _length(settings)},
    )


def _length(settings: Audio) -> int:
    if settings.source is None:
        return 0
    last = settings.source.samples.agg(F.max("pos").alias("m")).first()["m"]
    return 0 if last is None else last + 1
